"""Queries over findings, sources, evaluation and plain table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions import columns as C
from assaykit.functions import paths as P
from assaykit.functions import risk
from assaykit.operators import evaluate, findings as fnd, report, sources
from assaykit.plans import derived as D
from assaykit.plans.registry import ORACLES, Tables, case_map, query, rounded

# --- sources ----------------------------------------------------------------------------


@query("sample_flags", f"""WITH {D.SAMPLES_SQL}
SELECT sample_id, source_id, duplicate, label, ood, trigger_hit,
  (duplicate OR label OR ood OR trigger_hit) AS is_suspicious,
  concat_ws('; ', CASE WHEN duplicate THEN 'Near duplicate cluster' END,
    CASE WHEN label THEN 'Label disagreement with neighbors' END,
    CASE WHEN ood THEN 'Feature outlier (OOD)' END,
    CASE WHEN trigger_hit THEN 'Contains repeated localized trigger patch' END) AS reasons
FROM flagged""")
def sample_flags(t: Tables):
    flagged = sources.suspicion_reasons(sources.flag_samples(D.samples(t), D.anomalies(t)))
    return flagged.select(
        "sample_id", "source_id", "duplicate", "label", "ood", F.col("trigger").alias("trigger_hit"),
        "is_suspicious", F.array_join("anomaly_reasons", "; ").alias("reasons"),
    )


_GROUPS_SQL = """
groups AS (
  SELECT source_id, 'batch' AS level, batch_id AS member, COUNT(*) AS total,
    COUNT(*) FILTER (WHERE duplicate OR label OR ood OR trigger_hit) AS suspicious
  FROM flagged GROUP BY source_id, batch_id
  UNION ALL
  SELECT source_id, 'contributor', contributor, COUNT(*),
    COUNT(*) FILTER (WHERE duplicate OR label OR ood OR trigger_hit)
  FROM flagged GROUP BY source_id, contributor)
"""
_SCORE = rounded(
    "(1.0::DOUBLE * dup + 1.5::DOUBLE * ood + 2.5::DOUBLE * lab + 4.0::DOUBLE * trg) / n * 70.0::DOUBLE"
    " + susp / n::DOUBLE * 30.0::DOUBLE", 1)


@query("source_risk", f"""WITH {D.SAMPLES_SQL}, {_GROUPS_SQL},
agg AS (
  SELECT source_id, COUNT(*) AS n,
    COUNT(*) FILTER (WHERE duplicate OR label OR ood OR trigger_hit) AS susp,
    COUNT(*) FILTER (WHERE duplicate) AS dup, COUNT(*) FILTER (WHERE ood) AS ood,
    COUNT(*) FILTER (WHERE label) AS lab, COUNT(*) FILTER (WHERE trigger_hit) AS trg
  FROM flagged GROUP BY source_id),
scored AS (SELECT *, least(100.0::DOUBLE, {_SCORE}) AS score, susp / n::DOUBLE AS ratio FROM agg),
bad AS (
  SELECT source_id,
    COUNT(*) FILTER (WHERE level = 'batch' AND suspicious / total::DOUBLE > 0.3) AS anomalous_batches,
    COUNT(*) FILTER (WHERE level = 'contributor' AND suspicious / total::DOUBLE > 0.3) AS anomalous_contributors
  FROM groups GROUP BY source_id)
SELECT source_id, n AS sample_count, susp AS suspicious_count, dup AS duplicate_clusters, ood AS ood_count,
  lab AS label_anomalies, trg AS trigger_count, score AS risk_score,
  CASE WHEN score >= 70 OR trg >= 3 THEN 'CRITICAL' WHEN score >= 35 OR ratio >= 0.15 THEN 'HIGH'
    WHEN score >= 15 OR ratio >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN score >= 70 OR trg >= 3 THEN 'QUARANTINE' WHEN score >= 15 OR ratio >= 0.05 THEN 'REVIEW'
    ELSE 'ACCEPT' END AS disposition,
  anomalous_batches, anomalous_contributors
FROM scored JOIN bad USING (source_id)""")
def source_risk(t: Tables):
    return sources.source_risk(sources.flag_samples(D.samples(t), D.anomalies(t)))


@query("source_chart", f"""SELECT source_id, CASE WHEN risk_score = 0 THEN 20.0::DOUBLE ELSE risk_score END AS risk_score, suspicious_count
FROM ({ORACLES["source_risk"]})""")
def source_chart(t: Tables):
    return report.source_chart(source_risk(t))


@query("source_group_risk", f"""WITH {D.SAMPLES_SQL}, {_GROUPS_SQL}
SELECT source_id, level, member, total, suspicious, suspicious / total::DOUBLE AS ratio,
  suspicious / total::DOUBLE > 0.3 AS is_anomalous FROM groups""")
def source_group_risk(t: Tables):
    return sources.group_risk(sources.flag_samples(D.samples(t), D.anomalies(t)))


@query("anomalous_members", f"""WITH {D.SAMPLES_SQL}, {_GROUPS_SQL}
SELECT source_id, level, string_agg(member, ',' ORDER BY member) AS members
FROM groups WHERE suspicious / total::DOUBLE > 0.3 GROUP BY source_id, level""")
def anomalous_members(t: Tables):
    lists = sources.anomalous_members(sources.flag_samples(D.samples(t), D.anomalies(t)))
    return lists.select("source_id", "level", F.array_join("members", ",").alias("members"))


@query("anomaly_union", f"WITH {D.SAMPLES_SQL} SELECT DISTINCT sample_id FROM anomalies")
def anomaly_union(t: Tables):
    rows = D.anomalies(t)
    kinds = ("duplicate", "label", "ood", "trigger")
    return evaluate.anomaly_union(*[rows.where(F.col("kind") == k).select("sample_id") for k in kinds])


@query("suspect_source_names", """SELECT source_id, suspect, COUNT(*) AS samples FROM (
  SELECT CASE WHEN source LIKE '%7' THEN 'Rogue_' || source ELSE source END AS source_id,
    regexp_matches(lower(CASE WHEN source LIKE '%7' THEN 'Rogue_' || source ELSE source END),
      'rogue|poison|flood|bad') AS suspect FROM documents) GROUP BY source_id, suspect""")
def suspect_source_names(t: Tables):
    named = F.when(F.col("source").like("%7"), F.concat(F.lit("Rogue_"), "source")).otherwise(F.col("source"))
    return (
        t.documents.select(named.alias("source_id"))
        .withColumn("suspect", C.suspect_source(F.col("source_id")))
        .groupBy("source_id", "suspect").agg(F.count(F.lit(1)).alias("samples"))
    )


# --- evaluation -------------------------------------------------------------------------

_EVAL_SQL = """
docs AS (SELECT d.doc_id AS sample_id, d.lang AS scenario, d.n_chars, l.quality
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
marks AS (SELECT scenario, sample_id, coalesce(quality = 0, false) AS is_true, n_chars < 800 AS is_detected,
  coalesce(quality = 1, false) AS is_clean FROM docs WHERE quality IN (0, 1) OR n_chars < 800)
"""


def _marks(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("scenario"), "n_chars")
    labelled = docs.join(t.labels.withColumnRenamed("doc_id", "sample_id"), "sample_id")
    return evaluate.marked(
        labelled.where("quality = 0"), docs.where("n_chars < 800"), labelled.where("quality = 1")
    )


@query("truth_vs_detected", f"WITH {_EVAL_SQL} SELECT scenario, sample_id, is_true, is_detected, is_clean FROM marks")
def truth_vs_detected(t: Tables):
    return _marks(t)


def _metrics_sql(negative: str) -> str:
    p = rounded("tp / greatest(1, tp + fp)::DOUBLE", 3)
    r = rounded("tp / greatest(1, tp + fn)::DOUBLE", 3)
    return f"""WITH {_EVAL_SQL},
counts AS (SELECT scenario,
    COUNT(*) FILTER (WHERE is_true AND is_detected) AS tp, COUNT(*) FILTER (WHERE {negative} AND is_detected) AS fp,
    COUNT(*) FILTER (WHERE is_true AND NOT is_detected) AS fn,
    COUNT(*) FILTER (WHERE {negative} AND NOT is_detected) AS tn FROM marks GROUP BY scenario),
pr AS (SELECT *, {p} AS precision, {r} AS recall,
    {rounded("fp / greatest(1, fp + tn)::DOUBLE", 3)} AS fpr FROM counts),
metrics AS (SELECT *, {rounded("precision * recall * 2 / greatest(1e-5::DOUBLE, precision + recall)", 3)} AS f1 FROM pr)
"""


@query("detector_metrics", _metrics_sql("is_clean")
       + "SELECT scenario, tp, fp, fn, tn, precision, recall, f1, fpr FROM metrics")
def detector_metrics(t: Tables):
    return evaluate.detector_metrics(_marks(t))


@query("detector_metrics_strict", _metrics_sql("NOT is_true")
       + "SELECT scenario, tp, fp, fn, tn, precision, recall, f1, fpr FROM metrics")
def detector_metrics_strict(t: Tables):
    return evaluate.detector_metrics(_marks(t), clean_only=False)


@query("macro_metrics", _metrics_sql("is_clean") + f"""SELECT COUNT(*) AS total_scenarios,
  COUNT(*) FILTER (WHERE recall > 0.5) AS detected_scenarios,
  {rounded("AVG(precision)", 3)} AS precision, {rounded("AVG(recall)", 3)} AS recall, {rounded("AVG(f1)", 3)} AS f1,
  {rounded("COUNT(*) FILTER (WHERE recall > 0.5) / COUNT(*)::DOUBLE", 3)} AS detection_rate FROM metrics""")
def macro_metrics(t: Tables):
    return evaluate.macro_metrics(evaluate.detector_metrics(_marks(t)))


@query("truth_set_operations", f"""WITH {_EVAL_SQL}
SELECT 'hit' AS part, sample_id FROM marks WHERE is_true AND is_detected
UNION ALL SELECT 'missed', sample_id FROM marks WHERE is_true AND NOT is_detected
UNION ALL SELECT 'false_alarm', sample_id FROM marks WHERE is_clean AND is_detected
UNION ALL SELECT 'quiet', sample_id FROM marks WHERE is_clean AND NOT is_detected""")
def truth_set_operations(t: Tables):
    true = t.labels.where("quality = 0").select(F.col("doc_id").alias("sample_id"))
    clean = t.labels.where("quality = 1").select(F.col("doc_id").alias("sample_id"))
    found = t.documents.where("n_chars < 800").select(F.col("doc_id").alias("sample_id"))
    parts = {
        "hit": evaluate.intersection(true, found),
        "missed": evaluate.difference(true, found),
        "false_alarm": evaluate.intersection(clean, found),
        "quiet": evaluate.difference(clean, found),
    }
    out = None
    for name, ids in parts.items():
        part = ids.select(F.lit(name).alias("part"), "sample_id")
        out = part if out is None else out.unionAll(part)
    return out


# --- findings ---------------------------------------------------------------------------

_F = f"WITH {D.FINDINGS_SQL} "


@query("finding_risk", _F + f"""SELECT finding_id, {rounded("risk_score", 1)} AS risk_score,
  CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH'
    WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN risk_score >= 75 THEN 'QUARANTINE' WHEN risk_score >= 40 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition
FROM findings""")
def finding_risk(t: Tables):
    score = F.col("risk_score")
    return D.findings(t).select(
        "finding_id", F.round(score, 1).alias("risk_score"),
        risk.risk_level(score).alias("level"), risk.disposition(score).alias("disposition"),
    )


_AW = "(sw * cw * confidence)"
_ASSET_SQL = _F + f""",
per AS (SELECT asset_id, COUNT(*) AS findings, SUM(risk_score * {_AW}) AS sc, SUM({_AW}) AS wt,
    COUNT(*) FILTER (WHERE severity = 'CRITICAL') AS crit, COUNT(*) FILTER (WHERE severity = 'HIGH') AS high
  FROM findings GROUP BY asset_id),
asset AS (SELECT *, least(100.0::DOUBLE, {rounded("sc / greatest(1.0::DOUBLE, wt) + crit * 15.0::DOUBLE + high * 5.0::DOUBLE", 1)}) AS risk_score
  FROM per),
leveled AS (SELECT *, CASE WHEN risk_score >= 75 OR crit > 0 THEN 'CRITICAL'
    WHEN (risk_score >= 40 OR high > 0) AND risk_score >= 60 THEN 'HIGH'
    WHEN risk_score >= 40 OR high > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN risk_score >= 75 OR crit > 0 THEN 'QUARANTINE' WHEN risk_score >= 40 OR high > 0 THEN 'REVIEW'
    ELSE 'ACCEPT' END AS disposition FROM asset)
"""


@query("asset_risk", _ASSET_SQL + """SELECT asset_id, findings, crit AS critical_findings, high AS high_findings,
  risk_score, risk_level, disposition,
  'Overall risk evaluated as ' || risk_level || ' (' || CAST(risk_score AS VARCHAR) || '/100) across ' || findings
    || ' findings. Critical findings: ' || crit || ', High findings: ' || high || '.' AS explanation
FROM leveled""")
def asset_risk(t: Tables):
    return fnd.asset_risk(D.findings(t))


@query("contributing_factors", _F + f"""SELECT asset_id, category, severity, {rounded("risk_score", 6)} AS finding_score,
  confidence, {rounded(_AW, 6)} AS contribution_weight FROM findings""")
def contributing_factors(t: Tables):
    rows = fnd.contributing_factors(D.findings(t))
    return rows.withColumn("finding_score", F.round("finding_score", 6)).withColumn(
        "contribution_weight", F.round("contribution_weight", 6))


@query("findings_filter", _F + """SELECT finding_id, asset_id, category, severity FROM findings
WHERE category = 'OOD' AND severity = 'HIGH'""")
def findings_filter(t: Tables):
    return fnd.filter_findings(D.findings(t), category="OOD", severity="HIGH").select(
        "finding_id", "asset_id", "category", "severity")


@query("findings_search", _F + """SELECT finding_id, asset_id FROM findings
WHERE contains(lower(asset_id), 'a12') AND severity = 'CRITICAL'""")
def findings_search(t: Tables):
    return fnd.search_findings(D.findings(t), asset_text=" A12 ", severity="CRITICAL").select("finding_id", "asset_id")


@query("findings_for_assets", _F + "SELECT finding_id, asset_id FROM findings WHERE asset_id = 'A7' OR asset_id = 'A11'")
def findings_for_assets(t: Tables):
    return fnd.for_assets(D.findings(t), "A7", "A11").select("finding_id", "asset_id")


@query("findings_by_keys", _F + """SELECT finding_id, severity FROM findings
WHERE asset_id IN (SELECT 'A' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def findings_by_keys(t: Tables):
    keys = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("A"), "c_custkey").alias("asset_id"))
    return fnd.by_keys(D.findings(t), keys, "asset_id").select("finding_id", "severity")


@query("findings_deletion", _F + """SELECT finding_id FROM findings
WHERE NOT (asset_id IN ('A1', 'A2', 'A3') OR finding_id LIKE 'F-1%' OR asset_type = 'INFERENCE')""")
def findings_deletion(t: Tables):
    return fnd.without(D.findings(t), ["A1", "A2", "A3"], "F-1", "INFERENCE").select("finding_id")


@query("finding_numbers", _F + """SELECT ord,
  'F-' || asset_id || '-' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS finding_id
FROM (SELECT ord, asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY ord) AS rn FROM findings)""")
def finding_numbers(t: Tables):
    return fnd.finding_ids(D.findings(t).select("ord", "asset_id"), "ord").select("ord", "finding_id")


@query("severity_counts", _F + "SELECT severity, COUNT(*) AS findings FROM findings GROUP BY severity")
def severity_counts(t: Tables):
    return fnd.severity_counts(D.findings(t))


@query("category_counts", _F + "SELECT category, COUNT(*) AS findings FROM findings GROUP BY category")
def category_counts(t: Tables):
    return fnd.category_counts(D.findings(t))


@query("top_findings", _F + """SELECT finding_id, round(risk_score, 6) AS risk_score FROM findings
ORDER BY findings.risk_score DESC, finding_id LIMIT 5""")
def top_findings(t: Tables):
    return fnd.top_by_risk(D.findings(t), 5).select("finding_id", F.round("risk_score", 6).alias("risk_score"))


@query("findings_page", _F + "SELECT ord, finding_id FROM findings ORDER BY ord LIMIT 50 OFFSET 100")
def findings_page(t: Tables):
    return fnd.page(D.findings(t), "ord", 50, offset=100).select("ord", "finding_id")


@query("findings_newest_first", _F + "SELECT finding_id, created_us FROM findings ORDER BY created_us DESC, ord DESC")
def findings_newest_first(t: Tables):
    return fnd.latest_first(D.findings(t), "created_us", "ord").select("finding_id", "created_us")


@query("first_per_asset_type", _F + """SELECT asset_type, finding_id, position FROM (
  SELECT asset_type, finding_id, row_number() OVER (PARTITION BY asset_type ORDER BY findings.risk_score DESC, ord) AS position
  FROM findings) WHERE position <= 3""")
def first_per_asset_type(t: Tables):
    rows = fnd.first_per_group(D.findings(t), "asset_type", [F.col("risk_score").desc(), F.col("ord")], 3)
    return rows.select("asset_type", "finding_id", F.col("position").cast("bigint").alias("position"))


@query("latest_order_state", """SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_order_state(t: Tables):
    changes = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return fnd.latest_version(changes, ["o_custkey"], "o_orderkey")


@query("affected_samples", _F + """SELECT asset_id, category, COUNT(*) AS affected,
  string_agg(finding_id, ',' ORDER BY finding_id) AS affected_samples FROM findings GROUP BY asset_id, category""")
def affected_samples(t: Tables):
    rows = fnd.affected_lists(D.findings(t), ["asset_id", "category"], "finding_id")
    return rows.select("asset_id", "category", F.size("affected_samples").cast("bigint").alias("affected"),
                       F.array_join("affected_samples", ",").alias("affected_samples"))


@query("members_except_self", """SELECT page_id, len(others) AS others, array_to_string(others[1:3], ',') AS shown
FROM (SELECT page_id, list_filter(string_split(url, '/'),
  lambda x: x <> regexp_extract(url, '([^/]*)$', 1)) AS others FROM pages)""")
def members_except_self(t: Tables):
    others = fnd.members_except_self(F.split("url", "/"), P.basename(F.col("url")))
    return t.pages.select("page_id", F.size(others).cast("bigint").alias("others"),
                          F.array_join(fnd.truncated(others, 3), ",").alias("shown"))


@query("finding_weights", f"""SELECT n_name, {case_map("sev", risk.SEVERITY_WEIGHTS, 2.0)}::DOUBLE AS severity_weight,
  {case_map("cat", risk.CATEGORY_WEIGHTS, 1.5)}::DOUBLE AS category_weight
FROM (SELECT n_name, upper(['low','Medium','HIGH','critical','other'][1 + n_nationkey % 5]) AS sev,
  upper(['ood','Trigger','REPLAY','tampering','NOVEL'][1 + n_nationkey % 5]) AS cat FROM nation)""")
def finding_weights(t: Tables):
    pick = (F.col("n_nationkey") % 5).cast("int")
    sev = F.get(F.array(*map(F.lit, ["low", "Medium", "HIGH", "critical", "other"])), pick)
    cat = F.get(F.array(*map(F.lit, ["ood", "Trigger", "REPLAY", "tampering", "NOVEL"])), pick)
    return t.nation.select("n_name",
        risk.weight_of(F.upper(sev), risk.SEVERITY_WEIGHTS, 2.0).alias("severity_weight"),
        risk.weight_of(F.upper(cat), risk.CATEGORY_WEIGHTS, 1.5).alias("category_weight"))


@query("check_status_summary", f"""SELECT o_orderpriority, COUNT(*) AS total,
  COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS passed, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS partial,
  COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
  {rounded("COUNT(*) FILTER (WHERE o_orderstatus = 'O') / greatest(1, COUNT(*))::DOUBLE * 100", 1)} AS score,
  CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS overall_status
FROM orders GROUP BY o_orderpriority""")
def check_status_summary(t: Tables):
    status = F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("FAIL")
    return fnd.status_summary(t.orders.select("o_orderpriority", status.alias("status")), "o_orderpriority")


@query("status_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def status_filter(t: Tables):
    return fnd.with_status(t.orders.withColumnRenamed("o_orderstatus", "status"), "F").select("o_orderkey")


# --- labels, paths, JSON ----------------------------------------------------------------


@query("class_balance", f"""WITH c AS (SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label)
SELECT label, n AS samples, SUM(n) OVER ()::BIGINT AS total_samples,
  {rounded("MAX(n) OVER () / greatest(1, MIN(n) OVER ())::DOUBLE", 2)} AS imbalance_ratio,
  MAX(n) OVER () / greatest(1, MIN(n) OVER ())::DOUBLE > 8 AS is_heavily_imbalanced FROM c""")
def class_balance(t: Tables):
    from assaykit.operators.labels import class_balance as balance

    return balance(t.embeddings, "label")


@query("language_balance", f"""WITH c AS (SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang)
SELECT lang, n AS samples, SUM(n) OVER ()::BIGINT AS total_samples,
  {rounded("MAX(n) OVER () / greatest(1, MIN(n) OVER ())::DOUBLE", 2)} AS imbalance_ratio,
  MAX(n) OVER () / greatest(1, MIN(n) OVER ())::DOUBLE > 8 AS is_heavily_imbalanced FROM c""")
def language_balance(t: Tables):
    from assaykit.operators.labels import class_balance as balance

    return balance(t.documents, "lang")


@query("path_parts", """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base,
  CASE WHEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^a-zA-Z0-9_.\\-]', '_', 'g') = '' THEN 'unnamed_asset'
    ELSE regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^a-zA-Z0-9_.\\-]', '_', 'g') END AS safe,
  coalesce(list_filter(string_split(url, '/'), lambda x: contains(lower(x), 'example'))[-1], 'default_source') AS source_id,
  url LIKE '/%' AS escapes
FROM pages""")
def path_parts(t: Tables):
    url = F.col("url")
    return t.pages.select(
        "page_id", P.basename(url).alias("base"), P.safe_name(url).alias("safe"),
        P.last_component(url, ("example",), "default_source").alias("source_id"), P.escapes_root(url).alias("escapes"))


@query("event_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS encoded FROM events""")
def event_props(t: Tables):
    parsed = F.from_json("props", "k BIGINT")
    return t.events.select("event_id", parsed["k"].alias("k"),
                           C.encode_json(F.struct("event_type", "user_id")).alias("encoded"))


@query("decoded_lists", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END::INTEGER AS items FROM events""")
def decoded_lists(t: Tables):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('","x"]'))).otherwise("[broken")
    return t.events.select("event_id", F.size(C.decode_list(text)).alias("items"))


@query("path_origins", """WITH p AS (SELECT page_id, 'data/' || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Source_' || page_id % 3 || '/' END
    || CASE WHEN page_id % 4 = 0 THEN '' ELSE 'old_batch_0/batch_' || page_id % 4 || '/' END
    || regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) || ['.png', '.JPG', '.exe', '', '.tar.gz'][page_id % 5 + 1] AS path FROM pages)
SELECT page_id, path,
  coalesce(list_filter(string_split(path, '/'), lambda x: contains(lower(x), 'source_') OR contains(lower(x), 'contributor_'))[-1], 'default_source') AS source_id,
  coalesce(list_filter(string_split(path, '/'), lambda x: contains(lower(x), 'batch_'))[-1], 'batch_0') AS batch_id,
  page_id % 5 NOT IN (2, 3) AND NOT regexp_matches(path, '/[.][^./]*$') AS is_allowed FROM p""")
def path_origins(t: Tables):
    """Source and batch named in a file's path, and whether its extension is accepted.

    A name of an extension alone, such as ``.png``, has none.
    """
    key = F.col("page_id")
    folders = F.concat(
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Source_"), key % 3, F.lit("/"))),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("old_batch_0/batch_"), key % 4, F.lit("/"))),
    )
    endings = F.array(*map(F.lit, (".png", ".JPG", ".exe", "", ".tar.gz")))
    name = P.basename(F.regexp_replace("url", "[?#].*$", ""))
    path = F.concat(F.lit("data/"), folders, name, F.element_at(endings, (key % 5 + 1).cast("int")))
    files = t.pages.select("page_id", path.alias("path"))
    return files.select(
        "page_id", "path", P.source_of(F.col("path")).alias("source_id"), P.batch_of(F.col("path")).alias("batch_id"),
        P.extension_allowed(F.col("path")).alias("is_allowed"),
    )
