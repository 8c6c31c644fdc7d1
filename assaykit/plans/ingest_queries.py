"""Queries over annotation tables, model tables, findings generators and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions import columns as C
from assaykit.functions.hashing import sha256
from assaykit.operators import findings as fnd, generators, models, provenance, report, sources, validation
from assaykit.plans import derived as D
from assaykit.plans.log_queries import _R, _REASONS, _statuses, _verified
from assaykit.plans.registry import Tables, query, rounded
from assaykit.sources import coco

# --- annotations: orders as images, line items as boxes, parts as categories ------------


def _images(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(
        F.lit("d").alias("dataset_id"), key.alias("ordinal"), key.alias("image_id"),
        F.concat(F.lit("images/img_"), key, F.lit(".png")).alias("file_name"), F.lit(64).alias("width"), F.lit(64).alias("height"),
        F.when(key % 3 == 0, F.concat(F.lit("s"), F.col("o_custkey") % 10)).alias("source"),
        F.when(key % 3 == 1, "sid").alias("source_id"), F.lit(None).cast("string").alias("contributor_id"),
        F.col("o_orderstatus").alias("batch_id"), F.lit(None).cast("string").alias("contributor"))


def _annotations(t: Tables):
    return t.lineitem.select(
        F.lit("d").alias("dataset_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("annotation_id"),
        F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"),
        F.array(F.col("l_quantity") - 25, F.col("l_linenumber") * 10.0, F.col("l_tax") * 1000 - 10, F.col("l_discount") * 1000).alias("bbox"),
        (F.col("l_tax") * F.col("l_discount")).alias("area"))


def _categories(t: Tables):
    rows = t.part.where("p_size <= 40")
    return rows.select(F.lit("d").alias("dataset_id"), F.col("p_partkey").alias("category_id"), F.col("p_name").alias("class_name"))


_BOXES = """
boxes AS (SELECT l_orderkey AS image_id, l_quantity - 25 AS x, l_linenumber * 10.0::DOUBLE AS y, l_tax * 1000 - 10 AS w, l_discount * 1000 AS h,
    coalesce(p_name, 'unknown') AS class_name
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey)
"""


@query("coco_samples", f"""WITH {_BOXES}, per AS (SELECT image_id, string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS labels, COUNT(*) AS n FROM boxes GROUP BY image_id)
SELECT o_orderkey AS image_id, 'img_' || o_orderkey AS sample_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_custkey % 10 WHEN o_orderkey % 3 = 1 THEN 'sid' ELSE 'source_coco' END AS source_id,
  o_orderstatus AS batch_id, 'unknown' AS contributor, coalesce(labels, '') AS labels, coalesce(n, 0) AS annotation_count
FROM orders LEFT JOIN per ON image_id = o_orderkey""")
def coco_samples(t: Tables):
    named = coco.named_annotations(_annotations(t), _categories(t))
    rows = coco.samples_from_tables(_images(t), named)
    return rows.select("image_id", "sample_id", "source_id", "batch_id", "contributor", F.array_join("labels", ",").alias("labels"), "annotation_count")


@query("coco_annotations", f"WITH {_BOXES} SELECT class_name, COUNT(*) AS boxes, round(SUM(x), 4) AS sum_x FROM boxes GROUP BY class_name")
def coco_annotations(t: Tables):
    named = coco.named_annotations(_annotations(t), _categories(t))
    return named.groupBy("class_name").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.sum(F.get("bbox", F.lit(0))), 4).alias("sum_x"))


@query("nested_annotations", f"WITH {_BOXES} SELECT image_id, COUNT(*) AS boxes, string_agg(class_name, ',' ORDER BY class_name) AS classes FROM boxes GROUP BY image_id")
def nested_annotations(t: Tables):
    nested = coco.nested_annotations(coco.named_annotations(_annotations(t), _categories(t)))
    classes = F.array_sort(F.transform("annotations", lambda a: a["class_name"]))
    return nested.select("image_id", F.size("annotations").cast("bigint").alias("boxes"), F.array_join(classes, ",").alias("classes"))


@query("dataset_totals", """SELECT 'd' AS dataset_id, (SELECT COUNT(*) FROM orders) AS total_images, (SELECT COUNT(*) FROM lineitem) AS total_annotations,
  (SELECT COUNT(DISTINCT p_name) FROM part WHERE p_size <= 40) AS categories_count""")
def dataset_totals(t: Tables):
    return coco.dataset_totals(_images(t), _annotations(t), _categories(t))


_ISSUES = _BOXES + """, issues AS (SELECT image_id, CASE WHEN w <= 0 OR h <= 0 THEN 'INVALID_BBOX_SIZE'
    WHEN x < -5 OR y < -5 OR x + w > 74 OR y + h > 74 THEN 'OUT_OF_BOUNDS_BBOX' END AS issue_type FROM boxes)"""


@query("box_issues", f"""WITH {_ISSUES} SELECT image_id AS sample_id, issue_type,
  CASE issue_type WHEN 'INVALID_BBOX_SIZE' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM issues WHERE issue_type IS NOT NULL""")
def box_issues(t: Tables):
    return _box_issues(t).select("sample_id", "issue_type", "severity")


def _box_issues(t: Tables):
    rows = _annotations(t).select(F.col("image_id").alias("sample_id"), "bbox", F.lit(64).alias("width"), F.lit(64).alias("height"))
    return validation.box_issues(rows)


@query("issue_counts", f"""WITH {_ISSUES} SELECT issue_type, CASE issue_type WHEN 'INVALID_BBOX_SIZE' THEN 'MEDIUM' ELSE 'LOW' END AS severity, COUNT(*) AS issues
FROM issues WHERE issue_type IS NOT NULL GROUP BY issue_type""")
def issue_counts(t: Tables):
    return validation.issue_counts(_box_issues(t))


@query("corner_boxes", f"""SELECT l_orderkey, l_linenumber, {rounded("(l_discount * 5 - l_quantity / 50 / 2) * 64", 1)} AS x,
  {rounded("(l_tax * 5 - 0.5::DOUBLE / 2) * 64", 1)} AS y, {rounded("l_quantity / 50 * 64", 1)} AS w, {rounded("0.5::DOUBLE * 64", 1)} AS h FROM lineitem""")
def corner_boxes(t: Tables):
    box = C.corner_box(F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity") / 50, F.lit(0.5), F.lit(64), F.lit(64))
    return t.lineitem.select("l_orderkey", "l_linenumber", box.alias("b")).select(
        "l_orderkey", "l_linenumber", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate("xywh")])


@query("primary_labels", """SELECT page_id, coalesce(list_filter(string_split(url, '/'), lambda p: p = 'en' OR p = 'fr')[1], 'unlabelled') AS label,
  array_to_string(list_sort(list_distinct(string_split(url, '/'))), '|') AS label_set FROM pages""")
def primary_labels(t: Tables):
    parts = F.split("url", "/")
    return t.pages.select("page_id", C.primary_label(F.filter(parts, lambda p: p.isin("en", "fr"))).alias("label"),
                          F.array_join(C.label_set(parts), "|").alias("label_set"))


# --- models: embeddings as weights, logits and activations ------------------------------


def _tensors(t: Tables):
    return t.embeddings.select(
        F.concat(F.lit("m"), F.col("vec_id") % 5).alias("model_id"), F.concat(F.lit("l"), "label").alias("layer"), F.col("embedding").alias("values"))


_TENSORS = """
vals AS (SELECT 'm' || vec_id % 5 AS model_id, 'l' || label AS layer, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
stats AS (SELECT model_id, layer, COUNT(*) AS parameters, AVG(v) AS mean, stddev_pop(v) AS std, sqrt(SUM(v * v)) AS l2_norm,
    COUNT(*) FILTER (WHERE v = 0) / COUNT(*)::DOUBLE AS sparsity, MAX(v) AS top FROM vals GROUP BY model_id, layer),
prints AS (SELECT model_id, SUM(parameters)::BIGINT AS parameter_count, COUNT(*) AS layers, AVG(l2_norm) AS mean_l2_norm FROM stats GROUP BY model_id)
"""


@query("tensor_statistics", f"WITH {_TENSORS} SELECT model_id, layer, parameters, round(mean, 6) AS mean, round(std, 6) AS std, round(l2_norm, 5) AS l2_norm, round(sparsity, 6) AS sparsity FROM stats")
def tensor_statistics(t: Tables):
    s = models.tensor_statistics(_tensors(t))
    return s.select("model_id", "layer", "parameters", *[F.round(c, d).alias(c) for c, d in (("mean", 6), ("std", 6), ("l2_norm", 5), ("sparsity", 6))])


@query("activation_statistics", f"WITH {_TENSORS} SELECT model_id, layer, round(mean, 6) AS mean_activation, round(top, 6) AS max_activation, round(sparsity, 6) AS inactive_neuron_ratio FROM stats")
def activation_statistics(t: Tables):
    s = models.activation_statistics(_tensors(t))
    return s.select("model_id", "layer", *[F.round(c, 6).alias(c) for c in ("mean_activation", "max_activation", "inactive_neuron_ratio")])


@query("model_fingerprints", f"WITH {_TENSORS} SELECT model_id, parameter_count, layers, round(mean_l2_norm, 5) AS mean_l2_norm FROM prints")
def model_fingerprints(t: Tables):
    return models.model_fingerprints(models.tensor_statistics(_tensors(t))).withColumn("mean_l2_norm", F.round("mean_l2_norm", 5))


@query("fingerprint_comparison", f"""WITH {_TENSORS}, cmp AS (SELECT model_id, CASE WHEN model_id = 'm0' THEN 'MATCH' WHEN model_id = 'm1' THEN 'SUBSTITUTION_DETECTED'
    WHEN model_id = 'm3' THEN 'WEIGHT_MODIFICATION_DETECTED' ELSE 'MINOR_DEVIATION' END AS status,
  {rounded("CASE WHEN model_id = 'm1' THEN abs(parameter_count - 2 * parameter_count) / greatest(1, parameter_count)::DOUBLE ELSE 0::DOUBLE END", 4)} AS pr,
  {rounded("CASE WHEN model_id = 'm3' THEN abs(mean_l2_norm - mean_l2_norm * 1.1::DOUBLE) / greatest(1e-5::DOUBLE, mean_l2_norm) ELSE 0::DOUBLE END", 4)} AS nr FROM prints)
SELECT model_id, status, status = 'MATCH' AS is_exact_match, CASE status WHEN 'MATCH' THEN 'LOW' WHEN 'SUBSTITUTION_DETECTED' THEN 'CRITICAL' WHEN 'MINOR_DEVIATION' THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  CASE status WHEN 'MATCH' THEN 1.0 WHEN 'SUBSTITUTION_DETECTED' THEN 0.95 WHEN 'MINOR_DEVIATION' THEN 0.75 ELSE 0.88 END::DOUBLE AS confidence,
  pr AS parameter_difference_ratio, nr AS weight_norm_difference_ratio,
  CASE status WHEN 'MATCH' THEN 'ACCEPT' WHEN 'SUBSTITUTION_DETECTED' THEN 'QUARANTINE' ELSE 'REVIEW' END AS recommendation FROM cmp""")
def fingerprint_comparison(t: Tables):
    return _comparison(t)


def _comparison(t: Tables):
    prints = models.model_fingerprints(models.tensor_statistics(_tensors(t))).withColumn("framework", F.lit("ONNX"))
    reference = prints.withColumn("sha256", sha256(F.col("model_id")))
    model = F.col("model_id")
    candidate = reference.select(
        "model_id", "framework", F.when(model == "m0", F.col("sha256")).otherwise(sha256(F.concat("sha256", F.lit("x")))).alias("sha256"),
        F.when(model == "m1", F.col("parameter_count") * 2).otherwise(F.col("parameter_count")).alias("parameter_count"),
        F.when(model == "m3", F.col("mean_l2_norm") * 1.1).otherwise(F.col("mean_l2_norm")).alias("mean_l2_norm"))
    return models.compare_fingerprints(reference, candidate, "model_id")


@query("operator_histogram", "SELECT p_brand AS model_id, p_type AS op_type, COUNT(*) AS nodes FROM part GROUP BY p_brand, p_type")
def operator_histogram(t: Tables):
    return models.operator_histogram(t.part.select(F.col("p_brand").alias("model_id"), F.col("p_type").alias("op_type")))


def _predictions(t: Tables):
    first, second = F.slice("embedding", 1, 10), F.slice("embedding", 11, 10)
    reference = t.embeddings.select(F.col("vec_id").alias("item_id"), first.alias("logits"))
    candidate = t.embeddings.select(F.col("vec_id").alias("item_id"), F.when(F.col("vec_id") % 3 == 0, second).otherwise(first).alias("logits"))
    return reference, candidate


_PREDICTIONS = """
logits AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS r,
    list_transform(CASE WHEN vec_id % 3 = 0 THEN embedding[11:20] ELSE embedding[1:10] END, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings),
pairs AS (SELECT vec_id AS item_id, label, CAST(list_position(r, list_max(r)) - 1 AS INTEGER) AS reference_class, CAST(list_position(c, list_max(c)) - 1 AS INTEGER) AS candidate_class,
    1 / list_sum(list_transform(c, lambda x: exp(x - list_max(c)))) AS confidence FROM logits),
agree AS (SELECT COUNT(*) AS n, AVG(CASE WHEN reference_class = candidate_class THEN 1 ELSE 0 END) AS rate, COUNT(*) FILTER (WHERE reference_class <> candidate_class) AS bad, AVG(confidence) AS conf FROM pairs),
counts AS (SELECT label % 2 AS location, candidate_class, COUNT(*) AS n FROM pairs GROUP BY ALL),
tops AS (SELECT location, arg_max(candidate_class, n * 100 - candidate_class) AS target_class, MAX(n) / SUM(n)::DOUBLE AS ratio FROM counts GROUP BY location)
"""


@query("prediction_disagreements", f"WITH {_PREDICTIONS} SELECT item_id, reference_class, candidate_class, round(confidence, 6) AS candidate_confidence FROM pairs WHERE reference_class <> candidate_class")
def prediction_disagreements(t: Tables):
    rows = models.disagreements(models.prediction_pairs(*_predictions(t)))
    return rows.select("item_id", "reference_class", "candidate_class", F.round("candidate_confidence", 6).alias("candidate_confidence"))


@query("prediction_agreement", f"""WITH {_PREDICTIONS} SELECT n AS total_battery_tests, {rounded("rate", 3)} AS behavioural_agreement_rate,
  bad AS anomalous_inputs_count, round(conf, 3) AS mean_confidence FROM agree""")
def prediction_agreement(t: Tables):
    return models.agreement(models.prediction_pairs(*_predictions(t)))


@query("class_collapse", f"""WITH {_PREDICTIONS} SELECT location, target_class, {rounded("ratio", 3)} AS collapse_ratio, {rounded("ratio", 3)} >= 0.85 AS is_suspicious FROM tops""")
def class_collapse(t: Tables):
    return models.class_collapse(_located(t))


def _located(t: Tables):
    _, candidate = _predictions(t)
    locations = t.embeddings.select(F.col("vec_id").alias("item_id"), (F.col("label") % 2).alias("location"))
    return models.predicted(candidate).join(locations, "item_id")


@query("collapse_verdict", f"""WITH {_PREDICTIONS}, f AS (SELECT bool_or({rounded("ratio", 3)} >= 0.85) AS found FROM tops)
SELECT found AS high_vulnerability_detected, CASE WHEN found THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN found THEN 0.82 ELSE 0.45 END::DOUBLE AS confidence FROM f""")
def collapse_verdict(t: Tables):
    return models.collapse_verdict(models.class_collapse(_located(t)))


@query("linear_scores", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total,
  round(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))), 4) AS first_half FROM embeddings""")
def linear_scores(t: Tables):
    def predict(rows):
        import numpy as np

        weights = np.ones((rows.shape[1], 2))
        weights[32:, 1] = 0.0
        return rows @ weights

    scored = models.score(t.embeddings.select("vec_id", "embedding"), "embedding", predict)
    return scored.select("vec_id", *[F.round(F.get("logits", F.lit(i)), 4).alias(n) for i, n in enumerate(("total", "first_half"))])


@query("perturbed_vectors", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (
  SELECT vec_id, 'NORMAL' AS perturbation, v FROM p
  UNION ALL SELECT vec_id, 'BRIGHTNESS_HIGH', list_transform(v, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x * 1.4::DOUBLE))) FROM p
  UNION ALL SELECT vec_id, 'BRIGHTNESS_LOW', list_transform(v, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x * 0.5::DOUBLE))) FROM p
  UNION ALL SELECT vec_id, 'HIGH_CONTRAST', list_transform(v, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - 0.5::DOUBLE) * 1.8::DOUBLE + 0.5::DOUBLE))) FROM p)
SELECT vec_id, perturbation, round(list_sum(v), 4) AS total FROM q""")
def perturbed_vectors(t: Tables):
    rows = models.perturbed(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding").where("perturbation <> 'NOISE_GAUSSIAN'")
    return rows.select("vec_id", "perturbation", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("noisy_vectors")
def noisy_vectors(t: Tables):
    rows = models.perturbed(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding")
    return rows.where("perturbation = 'NOISE_GAUSSIAN'")


@query("registered_models", """SELECT event_id, sha256(event_type) AS model_sha256, CASE WHEN event_type IN ('click', 'view') THEN 'ONNX' END AS framework FROM events""")
def registered_models(t: Tables):
    registry = t.events.where("event_type IN ('click', 'view')").select(sha256(F.col("event_type")).alias("model_sha256")).distinct()
    records = t.events.select("event_id", sha256(F.col("event_type")).alias("model_sha256"))
    return models.model_of(records, registry.withColumn("framework", F.lit("ONNX")))


# --- generated findings and reports -----------------------------------------------------


def _summary(t: Tables):
    flagged = sources.flag_samples(D.samples(t), D.anomalies(t))
    per = flagged.groupBy(F.col("batch_id").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("population"), F.count_if("duplicate").alias("dup_samples"), F.count_if("label").alias("label_suspects"),
        F.count_if("ood").alias("ood_samples"), F.count_if("trigger").alias("trigger_samples"), F.count_distinct("source_id").alias("sources"))
    return per.select(
        "*", F.col("dup_samples").alias("dup_clusters"), (F.col("dup_samples") > 10).cast("bigint").alias("dup_flooding"),
        F.lit(1.5).alias("imbalance_ratio"), F.lit(0.75).alias("ood_confidence"), F.col("trigger_samples").alias("trigger_clusters"),
        F.lit(0).alias("trigger_high"), (F.col("sources") / 4).cast("bigint").alias("bad_sources"))


def _score(severity: str, category: str, confidence: str, affected: str, population: str) -> str:
    from assaykit.functions.risk import CATEGORY_WEIGHTS

    weight = CATEGORY_WEIGHTS[category]
    return rounded(f"""greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE {severity} WHEN 'LOW' THEN 1.0 WHEN 'MEDIUM' THEN 2.5 WHEN 'HIGH' THEN 6.0 ELSE 10.0 END::DOUBLE * 7.0::DOUBLE
      * ({weight}::DOUBLE / 2.0::DOUBLE) * ({confidence}::DOUBLE * 0.6::DOUBLE + 0.4::DOUBLE)
      * (greatest(0.05::DOUBLE, least(1.0::DOUBLE, {affected} / greatest(1, {population})::DOUBLE)) * 0.3::DOUBLE + 0.7::DOUBLE)))""", 1)


_GENERATED = f"""WITH {D.SAMPLES_SQL},
per AS (SELECT batch_id AS dataset_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE duplicate) AS dup, COUNT(*) FILTER (WHERE label) AS lab,
    COUNT(*) FILTER (WHERE ood) AS ood, COUNT(*) FILTER (WHERE trigger_hit) AS trg, COUNT(DISTINCT source_id) AS src FROM flagged GROUP BY batch_id),
raw AS (
  SELECT dataset_id, 1 AS pos, 'NEAR_DUPLICATE' AS category, CASE WHEN dup > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 0.94 AS confidence, dup AS affected, n AS population FROM per WHERE dup > 0
  UNION ALL SELECT dataset_id, 2, 'LABEL_FLIP', CASE WHEN lab >= 5 THEN 'HIGH' ELSE 'MEDIUM' END, 0.86, lab, n FROM per WHERE lab > 0
  UNION ALL SELECT dataset_id, 3, 'OOD', CASE WHEN ood < 10 THEN 'MEDIUM' ELSE 'HIGH' END, 0.75, ood, n FROM per WHERE ood > 0
  UNION ALL SELECT dataset_id, 4, 'TRIGGER', 'HIGH', 0.89, trg, n FROM per WHERE trg > 0
  UNION ALL SELECT dataset_id, 5, 'SOURCE_POISONING', 'HIGH', 0.85, src // 4, src FROM per WHERE src // 4 > 0),
scored AS (SELECT *, CASE category {" ".join(f"WHEN '{c}' THEN " + _score("severity", c, "confidence", "affected", "population") for c in ("NEAR_DUPLICATE", "LABEL_FLIP", "OOD", "TRIGGER", "SOURCE_POISONING"))} END AS risk_score FROM raw),
generated AS (SELECT 'F-' || dataset_id || '-' || lpad(CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY pos) AS VARCHAR), 3, '0') AS finding_id,
    dataset_id AS asset_id, category, severity, confidence::DOUBLE AS confidence, affected::BIGINT AS affected, risk_score,
    CASE WHEN category = 'TRIGGER' OR risk_score >= 75 THEN 'QUARANTINE' WHEN risk_score >= 40 THEN 'REVIEW' ELSE 'ACCEPT' END AS recommendation FROM scored)
"""


@query("dataset_findings", _GENERATED + "SELECT finding_id, asset_id, category, severity, confidence, affected, risk_score, recommendation FROM generated")
def dataset_findings(t: Tables):
    return generators.dataset_findings(_summary(t)).select(
        "finding_id", "asset_id", "category", "severity", "confidence", "affected", "risk_score", "recommendation")


@query("dataset_status", _GENERATED + """, w AS (SELECT asset_id, SUM(risk_score * sw * cw * confidence) / greatest(1.0::DOUBLE, SUM(sw * cw * confidence)) AS base,
    COUNT(*) FILTER (WHERE severity = 'CRITICAL') AS crit, COUNT(*) FILTER (WHERE severity = 'HIGH') AS high
  FROM (SELECT *, CASE severity WHEN 'LOW' THEN 1.0 WHEN 'MEDIUM' THEN 2.5 WHEN 'HIGH' THEN 6.0 ELSE 10.0 END::DOUBLE AS sw,
    CASE category WHEN 'NEAR_DUPLICATE' THEN 1.2 WHEN 'LABEL_FLIP' THEN 2.0 WHEN 'OOD' THEN 1.5 WHEN 'TRIGGER' THEN 3.0 ELSE 2.8 END::DOUBLE AS cw FROM generated) GROUP BY asset_id)
SELECT dataset_id, 'ANALYZED' AS status, """ + f"""least(100.0::DOUBLE, {rounded("base + crit * 15.0::DOUBLE + high * 5.0::DOUBLE", 1)}) AS risk_score, n AS population
FROM per JOIN w ON asset_id = dataset_id""")
def dataset_status(t: Tables):
    summary = _summary(t)
    risks = fnd.asset_risk(generators.dataset_findings(summary)).select("asset_id", "risk_score", "disposition")
    versions = t.documents.groupBy(F.col("lang").alias("dataset_id")).agg(F.lit("UPLOADED").alias("status"), F.max("doc_id").alias("version"))
    rows = report.dataset_status(summary, risks, versions)
    return rows.select("dataset_id", "status", "risk_score", "population")


@query("model_findings", f"""WITH {_TENSORS}, {_PREDICTIONS}, f AS (SELECT bool_or({rounded("ratio", 3)} >= 0.85) AS found FROM tops),
cmp AS (SELECT model_id, CASE model_id WHEN 'm1' THEN 'CRITICAL' WHEN 'm3' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE model_id WHEN 'm1' THEN 0.95 WHEN 'm3' THEN 0.88 ELSE 0.75 END AS confidence FROM prints WHERE model_id <> 'm0'),
raw AS (SELECT model_id, 1 AS pos, 'MODEL_SUBSTITUTION' AS category, severity, confidence, {_score("severity", "MODEL_SUBSTITUTION", "confidence", "1", "1")} AS risk_score FROM cmp
  UNION ALL SELECT model_id, 2, 'BACKDOOR_BEHAVIOUR', CASE WHEN floor({rounded("rate", 3)} * 100) < 65 THEN 'HIGH' ELSE 'MEDIUM' END, 0.85,
    {_score("CASE WHEN floor(" + rounded("rate", 3) + " * 100) < 65 THEN 'HIGH' ELSE 'MEDIUM' END", "BACKDOOR_BEHAVIOUR", "0.85", "bad", "n")} FROM prints, agree WHERE {rounded("rate", 3)} < 0.85
  UNION ALL SELECT model_id, 3, 'TRIGGER', 'HIGH', 0.82, {_score("'HIGH'", "TRIGGER", "0.82", "1", "1")} FROM prints, f WHERE found)
SELECT 'F-' || model_id || '-' || lpad(CAST(row_number() OVER (PARTITION BY model_id ORDER BY pos) AS VARCHAR), 3, '0') AS finding_id, category, severity, confidence::DOUBLE AS confidence, risk_score FROM raw""")
def model_findings(t: Tables):
    battery = models.agreement(models.prediction_pairs(*_predictions(t)))
    verdict = models.collapse_verdict(models.class_collapse(_located(t))).select("high_vulnerability_detected")
    # the battery and the verdict are one-row tables
    summary = _comparison(t).join(F.broadcast(battery), how="cross").join(F.broadcast(verdict), how="cross")
    return generators.model_findings(summary).select("finding_id", "category", "severity", "confidence", "risk_score")


@query("inference_findings", f"""{_R}, {_REASONS}, flags AS (SELECT DISTINCT arrival FROM reasons),
v AS (SELECT l.arrival, l.record_id, f.arrival IS NOT NULL AS replayed FROM log l LEFT JOIN flags f USING (arrival) WHERE f.arrival IS NOT NULL OR l.arrival % 101 = 0)
SELECT 'F-' || record_id || '@' || arrival || '-001' AS finding_id, CASE WHEN replayed THEN 'REPLAY' ELSE 'TAMPERING' END AS category,
  CASE WHEN replayed THEN {_score("'HIGH'", "REPLAY", "0.95", "1", "1")} ELSE {_score("'CRITICAL'", "TAMPERING", "1.0", "1", "1")} END AS risk_score FROM v""")
def inference_findings(t: Tables):
    return generators.inference_findings(_verified(t)).select("finding_id", "category", "risk_score")


@query("executive_summary", f"""WITH {D.FINDINGS_SQL}, c AS (SELECT COUNT(*) AS findings, COUNT(*) FILTER (WHERE severity = 'CRITICAL') AS critical_findings,
  COUNT(*) FILTER (WHERE severity = 'HIGH') AS high_findings, COUNT(*) FILTER (WHERE severity = 'MEDIUM') AS medium_findings, COUNT(*) FILTER (WHERE severity = 'LOW') AS low_findings,
  COUNT(*) FILTER (WHERE category IN ('NEAR_DUPLICATE', 'LABEL_FLIP', 'OOD', 'TRIGGER')) AS dataset_anomalies, COUNT(*) FILTER (WHERE category = 'DISTRIBUTION_SHIFT') AS shift_events_recorded,
  bool_or(category = 'MODEL_SUBSTITUTION') AS model_substituted FROM findings)
SELECT *, CASE WHEN dataset_anomalies > 0 THEN 'EVALUATED_ANOMALIES_DETECTED' ELSE 'PASS' END AS dataset_integrity,
  CASE WHEN model_substituted THEN 'SUBSTITUTION_DETECTED' ELSE 'PASS' END AS model_integrity FROM c""")
def executive_summary(t: Tables):
    return report.executive_summary(D.findings(t))


@query("report_header", f"""WITH {D.FINDINGS_SQL}, e AS (SELECT COUNT(*) AS findings, COUNT(*) FILTER (WHERE severity = 'CRITICAL') AS crit,
    COUNT(*) FILTER (WHERE category = 'DISTRIBUTION_SHIFT') AS shifts, arg_max('shift of asset ' || asset_id, ord) FILTER (WHERE category = 'DISTRIBUTION_SHIFT') AS recent FROM findings),
d AS (SELECT COUNT(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS classes FROM documents),
r AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE event_type = 'error') AS tampered, COUNT(*) FILTER (WHERE event_type = 'click') AS replayed FROM events)
SELECT CASE WHEN crit > 0 THEN 'QUARANTINE' END AS assessment_verdict, least(100.0::DOUBLE, crit * 15.0::DOUBLE) AS risk_score, findings, crit AS critical_findings,
  'SELECTED' AS dataset_status, 'documents' AS dataset_name, d.n AS sample_count, classes, 'NO_MODEL_SELECTED' AS model_status, CAST(NULL AS VARCHAR) AS model_name,
  shifts AS shift_events_recorded, coalesce(recent, 'NORMAL') AS recent_shift, r.total AS records, r.tampered, r.replayed FROM e, d, r""")
def report_header(t: Tables):
    """The header of a report on all findings: a dataset is chosen, of the models none has the id asked for."""
    found = D.findings(t).withColumn("description", F.concat(F.lit("shift of asset "), "asset_id"))
    dataset = t.documents.agg(F.lit("documents").alias("name"), F.count(F.lit(1)).alias("sample_count"),
                              F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("classes"))
    model = t.part.where("p_partkey < 0").select(F.col("p_name").alias("name"))
    overall = fnd.asset_risk(found.withColumn("asset_id", F.lit("ALL")))
    header = report.report_header(found, overall, provenance.status_counts(_statuses(t)), dataset, model, "ord")
    return header.select(
        "assessment_verdict", "overall.risk_score", "executive_summary.findings", "executive_summary.critical_findings",
        "dataset_status", F.col("dataset.name").alias("dataset_name"), "dataset.sample_count", "dataset.classes",
        "model_status", F.col("model.name").alias("model_name"), "distribution.shift_events_recorded", "distribution.recent_shift",
        F.col("inference_assurance.total").alias("records"), "inference_assurance.tampered", "inference_assurance.replayed")


@query("findings_csv", _GENERATED + """SELECT finding_id AS "Finding ID", category AS "Category", severity AS "Severity",
  affected AS "Affected Samples Count" FROM generated""")
def findings_csv(t: Tables):
    rows = report.csv_rows(generators.dataset_findings(_summary(t)))
    return rows.select("Finding ID", "Category", "Severity", "Affected Samples Count")


@query("finding_samples", _GENERATED + """, hits AS (
  SELECT batch_id, sample_id, unnest([CASE WHEN duplicate THEN 'NEAR_DUPLICATE' END, CASE WHEN label THEN 'LABEL_FLIP' END,
    CASE WHEN ood THEN 'OOD' END, CASE WHEN trigger_hit THEN 'TRIGGER' END]) AS category FROM flagged)
SELECT finding_id, sample_id AS ordinal, sample_id FROM hits JOIN generated g ON g.asset_id = batch_id AND g.category = hits.category""")
def finding_samples(t: Tables):
    flagged = sources.flag_samples(D.samples(t), D.anomalies(t))
    kinds = {"duplicate": "NEAR_DUPLICATE", "label": "LABEL_FLIP", "ood": "OOD", "trigger": "TRIGGER"}
    hits = F.array_compact(F.array(*[F.when(F.col(k), F.lit(c)) for k, c in kinds.items()]))
    affected = flagged.select(
        F.col("batch_id").alias("asset_id"), F.explode(hits).alias("category"), F.col("sample_id").alias("ordinal"), "sample_id")
    return generators.finding_samples(generators.dataset_findings(_summary(t)), affected)


@query("findings_with_assets", f"""WITH {D.FINDINGS_SQL} SELECT finding_id, findings.asset_id, c_name AS name FROM findings
LEFT JOIN (SELECT 'A' || c_custkey AS asset_id, c_name FROM customer WHERE c_acctbal > 0) a ON a.asset_id = findings.asset_id""")
def findings_with_assets(t: Tables):
    assets = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("A"), "c_custkey").alias("asset_id"), F.col("c_name").alias("name"))
    return report.findings_with_assets(D.findings(t), assets).select("finding_id", "asset_id", "name")


@query("risk_chart", """WITH a AS (SELECT ['DATASET', 'MODEL', 'SOURCE'][1 + s_suppkey % 3] AS asset_type, s_name AS name, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal / 100, 1) ELSE 0 END AS score FROM supplier)
SELECT asset_type, name, CASE WHEN score = 0 THEN CASE asset_type WHEN 'DATASET' THEN 45.0 WHEN 'MODEL' THEN 85.0 ELSE 65.0 END ELSE score END::DOUBLE AS risk_score
FROM a QUALIFY row_number() OVER (PARTITION BY asset_type ORDER BY s_suppkey) <= 3""")
def risk_chart(t: Tables):
    kinds = F.array(F.lit("DATASET"), F.lit("MODEL"), F.lit("SOURCE"))
    assets = t.supplier.select(
        F.get(kinds, (F.col("s_suppkey") % 3).cast("int")).alias("asset_type"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"),
        F.when(F.col("s_suppkey") % 2 == 0, F.round(F.col("s_acctbal") / 100, 1)).otherwise(F.lit(0.0)).alias("risk_score"))
    return report.risk_chart(assets)


@query("audit_timeline", "SELECT event_id AS seq, event_type AS action FROM events ORDER BY event_id LIMIT 15")
def audit_timeline(t: Tables):
    return report.audit_timeline(t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("action")))
