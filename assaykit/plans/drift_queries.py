"""Queries over distribution drift, quantiles and score cut-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import drift, outliers, scan
from assaykit.plans.registry import Tables, query, rounded

FEATURES = ["quantity", "extendedprice", "discount", "tax"]


def _sides(t: Tables):
    """Line items before and after a day; the later quantities are inflated by 30 %."""
    rows = t.lineitem.select(
        (F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ'1998-07-01 00:00:00'")).alias("is_ref"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    later = rows.where("NOT is_ref").withColumn("quantity", F.col("quantity") * 1.3)
    return rows.where("is_ref"), later


_COUNTS = """
base AS (
  SELECT l_shipdate < TIMESTAMP '1998-07-01' AS is_ref,
    CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN l_quantity ELSE l_quantity * 1.3::DOUBLE END AS quantity,
    l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax FROM lineitem),
long AS (
  SELECT is_ref, feature, CAST(CAST(raw AS FLOAT) AS DOUBLE) AS value
  FROM (SELECT is_ref, 'quantity' AS feature, quantity AS raw FROM base
    UNION ALL SELECT is_ref, 'extendedprice', extendedprice FROM base
    UNION ALL SELECT is_ref, 'discount', discount FROM base
    UNION ALL SELECT is_ref, 'tax', tax FROM base)),
counts AS (
  SELECT feature, value, COUNT(*) FILTER (WHERE is_ref) AS r, COUNT(*) FILTER (WHERE NOT is_ref) AS c
  FROM long GROUP BY feature, value),
cum AS (
  SELECT *, SUM(r) OVER w / SUM(r) OVER (PARTITION BY feature)::DOUBLE AS f,
    SUM(c) OVER w / SUM(c) OVER (PARTITION BY feature)::DOUBLE AS g,
    lead(value) OVER w AS next_value
  FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value)),
basic AS (
  SELECT feature, CAST(SUM(r) AS BIGINT) AS n_ref, CAST(SUM(c) AS BIGINT) AS n_cand,
    MAX(abs(f - g)) AS ks, SUM(abs(f - g) * (next_value - value)) AS w1,
    MIN(value) AS lo, MAX(value) AS hi,
    SUM(value * r) / SUM(r)::DOUBLE AS mean_ref, SUM(value * c) / SUM(c)::DOUBLE AS mean_cand
  FROM cum GROUP BY feature)
"""
_EDGES = """
quantiles AS (
  SELECT feature, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q
  FROM long WHERE is_ref GROUP BY feature),
edges AS (
  SELECT feature, list_sort(list_distinct(list_transform(q, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)))) AS e
  FROM quantiles)
"""
_PSI = _EDGES + """,
binned AS (
  SELECT c.feature, len(e) - 1 AS bins, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) - 1 AS bin, r, c
  FROM counts c JOIN edges USING (feature) WHERE value >= e[1] AND value <= e[-1]),
grid AS (SELECT feature, len(e) - 1 AS bins, unnest(range(0, len(e) - 1)) AS bin FROM edges WHERE len(e) > 2),
filled AS (
  SELECT g.feature, g.bins, g.bin, coalesce(SUM(r), 0) AS r, coalesce(SUM(c), 0) AS c
  FROM grid g LEFT JOIN binned b ON b.feature = g.feature AND b.bin = g.bin GROUP BY g.feature, g.bins, g.bin),
shares AS (
  SELECT feature, (r + 1e-4::DOUBLE) / (SUM(r) OVER p + bins * 1e-4::DOUBLE) AS pr,
    (c + 1e-4::DOUBLE) / (SUM(c) OVER p + bins * 1e-4::DOUBLE) AS pc
  FROM filled WINDOW p AS (PARTITION BY feature)),
psi AS (
  SELECT feature, least(10.0::DOUBLE, greatest(0.0::DOUBLE, SUM((pc - pr) * ln(pc / pr)))) AS psi
  FROM shares GROUP BY feature)
"""
_JS = """
jedges AS (
  SELECT feature, list_transform(range(0, 15), lambda i: CASE WHEN i = 14 THEN hi
      ELSE CAST(CAST(lo + i * ((hi - lo) / 14) AS FLOAT) AS DOUBLE) END) AS e
  FROM basic WHERE hi > lo),
jbinned AS (
  SELECT c.feature, least(len(list_filter(e, lambda x: x <= value)), 14) AS bin, r, c
  FROM counts c JOIN jedges USING (feature)),
jgrid AS (SELECT feature, e, unnest(range(1, 15)) AS bin FROM jedges),
jfilled AS (
  SELECT g.feature, g.bin, g.e[g.bin + 1] - g.e[g.bin] AS width, coalesce(SUM(r), 0) AS r, coalesce(SUM(c), 0) AS c
  FROM jgrid g LEFT JOIN jbinned b ON b.feature = g.feature AND b.bin = g.bin GROUP BY g.feature, g.bin, g.e),
dense AS (
  SELECT feature, r / width / (SUM(r) OVER w)::DOUBLE + 1e-5::DOUBLE AS p, c / width / (SUM(c) OVER w)::DOUBLE + 1e-5::DOUBLE AS q
  FROM jfilled WINDOW w AS (PARTITION BY feature)),
normal AS (SELECT feature, p / SUM(p) OVER w AS p, q / SUM(q) OVER w AS q FROM dense WINDOW w AS (PARTITION BY feature)),
js AS (
  SELECT feature, sqrt(SUM(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js
  FROM normal GROUP BY feature)
"""
_ALL = f"WITH {_COUNTS}, {_PSI}, {_JS}, metrics AS (SELECT * FROM basic JOIN psi USING (feature) JOIN js USING (feature)) "


@query("drift_metrics", _ALL + """SELECT feature, n_ref, n_cand, round(psi, 6) AS psi, round(ks, 6) AS ks_statistic,
  round(w1, 4) AS wasserstein_distance, round(js, 6) AS jensen_shannon_divergence,
  round(mean_ref, 4) AS reference_mean, round(mean_cand, 4) AS candidate_mean,
  (psi >= 0.2 OR ks >= 0.35) AS is_significant_drift FROM metrics""")
def drift_metrics(t: Tables):
    # with this many rows a KS gap of 0.35 always has p < 0.01, so the SQL leaves p out
    m = drift.drift_metrics(*_sides(t), FEATURES)
    for column, digits in (
        ("psi", 6), ("ks_statistic", 6), ("wasserstein_distance", 4),
        ("jensen_shannon_divergence", 6), ("reference_mean", 4), ("candidate_mean", 4),
    ):
        m = m.withColumn(column, F.round(column, digits))
    return m.drop("ks_p_value")


def _moved(t: Tables, factors: dict[str, float]):
    """The two sides again, with some features of the later one multiplied."""
    reference, _ = _sides(t)
    plain = t.lineitem.where(F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ'1998-07-01 00:00:00'"))
    return reference, plain.select(*[(F.col(f"l_{f}") * F.lit(factors.get(f, 1.0))).alias(f) for f in FEATURES])


def _moved_sql(factors: dict[str, float]) -> str:
    columns = ", ".join(
        f"CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN l_{f} ELSE l_{f} * {factors.get(f, 1.0)}::DOUBLE END AS {f}" for f in FEATURES
    )
    start, end = _ALL.index("base AS ("), _ALL.index("long AS (")
    return f"{_ALL[:start]}base AS (SELECT l_shipdate < TIMESTAMP '1998-07-01' AS is_ref, {columns} FROM lineitem),\n{_ALL[end:]}"


_SHIFTED = {"quantity": 3.0, "extendedprice": 2.5}


@query("drift_metrics_shifted", _moved_sql(_SHIFTED) + """SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks_statistic,
  (psi >= 0.2 OR ks >= 0.35) AS is_significant_drift FROM metrics""")
def drift_metrics_shifted(t: Tables):
    m = drift.drift_metrics(*_moved(t, _SHIFTED), FEATURES)
    return m.select("feature", F.round("psi", 6).alias("psi"), F.round("ks_statistic", 6).alias("ks_statistic"), "is_significant_drift")


@query("drift_p_values")
def drift_p_values(t: Tables):
    m = drift.drift_metrics(*_sides(t), FEATURES)
    return m.select("feature", F.round("ks_statistic", 4).alias("ks_statistic"), F.round("ks_p_value", 6).alias("ks_p_value"))


_VERDICT = """, v AS (
  SELECT COUNT(*) FILTER (WHERE psi >= 0.2 OR ks >= 0.35) AS m,
    bool_or((psi >= 0.2 OR ks >= 0.35) AND feature IN ('quantity', 'tax')) AS op FROM metrics)
SELECT 'SUCCESS' AS status,
  CASE WHEN m = 0 THEN 'NORMAL' WHEN m <= 2 AND op THEN 'OPERATIONAL_DRIFT' WHEN m <= 4 THEN 'ANOMALOUS' ELSE 'SUSPICIOUS' END AS classification,
  CASE WHEN m = 0 THEN 'LOW' WHEN m <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  CASE WHEN m = 0 THEN 0.92 WHEN m <= 2 AND op THEN 0.85 WHEN m <= 2 THEN 0.80 WHEN m <= 4 THEN 0.88 ELSE 0.91 END::DOUBLE AS confidence,
  CASE WHEN m = 0 THEN 'ACCEPT' WHEN m <= 4 THEN 'REVIEW' ELSE 'QUARANTINE' END AS recommendation,
  m > 0 AS overall_shift_detected, m AS significant_drift_features_count FROM v"""


@query("shift_class", _ALL + _VERDICT)
def shift_class(t: Tables):
    return drift.drift_report(*_sides(t), FEATURES, ("quantity", "tax"))[1]


_RUNGS = {
    "shift_class_operational": {"quantity": 3.0},
    "shift_class_anomalous": {"quantity": 3.0, "extendedprice": 3.0, "discount": 3.0},
}


def _register_rung(name: str, factors: dict[str, float]) -> None:
    @query(name, _moved_sql(factors) + _VERDICT)
    def rung(t: Tables):
        return drift.drift_report(*_moved(t, factors), FEATURES, ("quantity", "tax"))[1]


for _name, _factors in _RUNGS.items():
    _register_rung(_name, _factors)


_FOUND = """, v AS (
  SELECT COUNT(*) FILTER (WHERE psi >= 0.2 OR ks >= 0.35) AS m FROM metrics)
SELECT 'F-lineitem-001' AS finding_id, 'DISTRIBUTION_SHIFT' AS category, CASE WHEN m <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  m AS affected FROM v WHERE m > 0"""


@query("shift_findings_moved", _moved_sql(_SHIFTED) + _FOUND)
def shift_findings_moved(t: Tables):
    from assaykit.operators.generators import shift_findings as findings

    shift = drift.drift_report(*_moved(t, _SHIFTED), FEATURES, ("quantity", "tax"))[1]
    rows = findings(shift.withColumn("asset_id", F.lit("lineitem")), len(FEATURES))
    return rows.select("finding_id", "category", "severity", "affected")


@query("shift_findings", _ALL + """, v AS (
  SELECT COUNT(*) FILTER (WHERE psi >= 0.2 OR ks >= 0.35) AS m,
    bool_or((psi >= 0.2 OR ks >= 0.35) AND feature IN ('quantity', 'tax')) AS op FROM metrics)
SELECT 'F-lineitem-001' AS finding_id, 'DISTRIBUTION_SHIFT' AS category, CASE WHEN m <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  m AS affected FROM v WHERE m > 0""")
def shift_findings(t: Tables):
    from assaykit.operators.generators import shift_findings as findings

    shift = drift.drift_report(*_sides(t), FEATURES, ("quantity", "tax"))[1]
    rows = findings(shift.withColumn("asset_id", F.lit("lineitem")), len(FEATURES))
    return rows.select("finding_id", "category", "severity", "affected")


@query("psi_edges", f"WITH {_COUNTS}, {_EDGES} SELECT feature, unnest(range(0, len(e))) AS position, unnest(e) AS edge FROM edges")
def psi_edges(t: Tables):
    edges = drift.psi_edges(drift.scanned_counts(drift.value_counts(*_sides(t), FEATURES)))
    return edges.select("feature", F.posexplode("edges").alias("position", "edge")).withColumn(
        "position", F.col("position").cast("bigint"))


@query("exact_quantiles", """WITH q AS (SELECT l_returnflag,
    quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) AS v FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, unnest([0.05, 0.5, 0.95])::DOUBLE AS share, round(unnest(v), 4) AS quantile FROM q""")
def exact_quantiles(t: Tables):
    q = scan.exact_quantiles(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"],
                             "l_extendedprice", [0.05, 0.5, 0.95])
    return q.withColumn("quantile", F.round("quantile", 4))


_CENTRE = """
flat AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
moments AS (SELECT i, AVG(x) AS m, stddev_pop(x) AS s FROM flat GROUP BY i),
raw AS (SELECT vec_id, sqrt(SUM((x - m) * (x - m))) AS d FROM flat JOIN moments USING (i) GROUP BY vec_id),
scored AS (SELECT vec_id, (d - MIN(d) OVER ()) / (MAX(d) OVER () - MIN(d) OVER ()) AS score FROM raw)
"""


def _distances(t: Tables):
    flat = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    centre = flat.groupBy("i").agg(F.avg("x").alias("m"))
    # one row per vector position
    gap = F.col("x") - F.col("m")
    return flat.join(F.broadcast(centre), "i").groupBy("vec_id").agg(F.sqrt(F.sum(gap * gap)).alias("raw"))


@query("column_moments", f"""WITH {_CENTRE} SELECT CAST(i - 1 AS BIGINT) AS position, round(m, 6) AS mean,
  round(CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS std FROM moments""")
def column_moments(t: Tables):
    from assaykit.operators.knn import column_moments as moments

    return moments(t.embeddings, "embedding").select(
        F.col("position").cast("bigint").alias("position"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("min_max_scaled", f"WITH {_CENTRE} SELECT vec_id, round(score, 6) AS score FROM scored")
def min_max_scaled(t: Tables):
    return outliers.scaled(_distances(t), "raw", "score").select("vec_id", F.round("score", 6).alias("score"))


@query("score_cutoff", f"""WITH {_CENTRE}, cut AS (SELECT quantile_cont(score, 0.95) AS c FROM scored)
SELECT vec_id, round(score, 6) AS score, CASE WHEN score > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
FROM scored, cut WHERE score >= c AND score > 0.65""")
def score_cutoff(t: Tables):
    flagged = outliers.above_cutoff(outliers.scaled(_distances(t), "raw", "score"), "score", 0.95)
    return flagged.select("vec_id", F.round("score", 6).alias("score"), "confidence")


@query("isolation_outliers")
def isolation_outliers(t: Tables):
    stretched = F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: x * 5)).otherwise(F.col("embedding"))
    return outliers.outliers(t.embeddings.select("vec_id", stretched.alias("features")), "vec_id", "features")


@query("isolation_outlier_ids", "SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0")
def isolation_outlier_ids(t: Tables):
    """The stretched rows, and no others, are found."""
    return isolation_outliers(t).select("vec_id")
