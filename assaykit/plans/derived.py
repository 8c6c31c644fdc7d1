"""Assurance tables derived from the driver's tables, in Spark and as SQL CTEs.

The driver's tables hold no images, findings or inference logs, so each assurance table
is stated as a rule over a whole driver table that both engines can follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import risk
from assaykit.functions.hashing import sha256
from assaykit.functions.times import epoch_micros
from assaykit.plans.registry import Tables, case_map

CATEGORIES = list(risk.CATEGORY_WEIGHTS)

# --- samples and anomalies: documents with their labels --------------------------------


def samples(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("batch_id"),
        F.concat(F.lit("c"), F.col("doc_id") % 7).alias("contributor"),
        "n_chars",
    )


def anomalies(t: Tables) -> DataFrame:
    """Low quality is a label anomaly, toxic a trigger, tiny an outlier, huge a duplicate."""
    docs = t.documents.select(F.col("doc_id").alias("sample_id"), "n_chars")
    marks = t.labels.select(F.col("doc_id").alias("sample_id"), "quality", "toxic")
    return (
        marks.where("quality = 0").select("sample_id", F.lit("label").alias("kind"))
        .unionAll(marks.where("toxic = 1").select("sample_id", F.lit("trigger")))
        .unionAll(docs.where("n_chars < 60").select("sample_id", F.lit("ood")))
        .unionAll(docs.where("n_chars > 4000").select("sample_id", F.lit("duplicate")))
    )


SAMPLES_SQL = """
samples AS (
  SELECT doc_id AS sample_id, source AS source_id, lang AS batch_id,
         'c' || CAST(doc_id % 7 AS VARCHAR) AS contributor, n_chars
  FROM documents),
anomalies AS (
  SELECT doc_id AS sample_id, 'label' AS kind FROM labels WHERE quality = 0
  UNION ALL SELECT doc_id, 'trigger' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'ood' FROM documents WHERE n_chars < 60
  UNION ALL SELECT doc_id, 'duplicate' FROM documents WHERE n_chars > 4000),
flagged AS (
  SELECT s.*,
    EXISTS (SELECT 1 FROM anomalies a WHERE a.sample_id = s.sample_id AND kind = 'duplicate') AS duplicate,
    EXISTS (SELECT 1 FROM anomalies a WHERE a.sample_id = s.sample_id AND kind = 'label') AS label,
    EXISTS (SELECT 1 FROM anomalies a WHERE a.sample_id = s.sample_id AND kind = 'ood') AS ood,
    EXISTS (SELECT 1 FROM anomalies a WHERE a.sample_id = s.sample_id AND kind = 'trigger') AS trigger_hit
  FROM samples s)
"""

# --- findings: orders -------------------------------------------------------------------

_SEVERITY = {"1": "CRITICAL", "2": "HIGH", "3": "MEDIUM"}


def findings(t: Tables) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    severity = (
        F.when(first == "1", "CRITICAL").when(first == "2", "HIGH").when(first == "3", "MEDIUM")
    ).otherwise("LOW")
    kinds = F.array(*[F.lit(c) for c in CATEGORIES])
    key = F.col("o_orderkey")
    base = t.orders.select(
        key.alias("ord"),
        F.concat(F.lit("F-"), key).alias("finding_id"),
        F.when(key % 3 == 0, "DATASET").when(key % 3 == 1, "MODEL").otherwise("INFERENCE").alias("asset_type"),
        F.concat(F.lit("A"), F.col("o_custkey")).alias("asset_id"),
        F.get(kinds, (key % 14).cast("int")).alias("category"),
        severity.alias("severity"),
        ((key % 100) / 100).alias("confidence"),
        (F.col("o_custkey") % 100).alias("affected"),
        epoch_micros(F.col("o_orderdate")).alias("created_us"),
    )
    return base.withColumn(
        "risk_score",
        risk.finding_score(
            F.col("category"), F.col("severity"), F.col("confidence"), F.col("affected"), F.lit(100)
        ),
    )


_cats = ", ".join(f"'{c}'" for c in CATEGORIES)
FINDINGS_SQL = f"""
raw_findings AS (
  SELECT o_orderkey AS ord, 'F-' || o_orderkey AS finding_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'DATASET' WHEN 1 THEN 'MODEL' ELSE 'INFERENCE' END AS asset_type,
    'A' || o_custkey AS asset_id,
    [{_cats}][1 + CAST(o_orderkey % 14 AS INTEGER)] AS category,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH'
      WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    (o_orderkey % 100) / 100.0::DOUBLE AS confidence,
    o_custkey % 100 AS affected,
    epoch_us(o_orderdate) AS created_us
  FROM orders),
weighted AS (
  SELECT *, {case_map("severity", risk.SEVERITY_WEIGHTS, 2.0)}::DOUBLE AS sw,
    {case_map("category", risk.CATEGORY_WEIGHTS, 1.5)}::DOUBLE AS cw,
    greatest(0.05::DOUBLE, least(1.0::DOUBLE, affected / 100.0::DOUBLE)) AS share
  FROM raw_findings),
findings AS (
  SELECT ord, finding_id, asset_type, asset_id, category, severity, confidence, affected, created_us, sw, cw,
    greatest(0.0::DOUBLE, least(100.0::DOUBLE, sw * 7.0::DOUBLE * (cw / 2.0::DOUBLE)
      * (confidence * 0.6::DOUBLE + 0.4::DOUBLE) * (share * 0.3::DOUBLE + 0.7::DOUBLE))) AS risk_score
  FROM weighted)
"""

# --- inference log: events --------------------------------------------------------------


def event_micros() -> Column:
    return epoch_micros(F.col("ts"))


def value_cents() -> Column:
    return F.round(F.col("value") * 100).cast("bigint")


EVENTS_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, props, value, ts,
    epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)
"""


def replay_log(t: Tables) -> DataFrame:
    """Events as inference arrivals, with ids, nonces and sequences planted to repeat."""
    e = F.col("event_id")

    def nonce(shift: int) -> Column:
        return sha256(F.concat(F.lit("n|"), e - shift))

    return t.events.select(
        e.alias("arrival"),
        F.concat(F.lit("REC-"), F.when((e % 307 == 0) & (e >= 50), e - 50).otherwise(e)).alias("record_id"),
        F.when((e % 211 == 0) & (e >= 50), nonce(50)).otherwise(nonce(0)).alias("nonce"),
        F.when((e % 223 == 0) & (e >= 20), e - 20).otherwise(e).alias("sequence"),
        sha256(F.col("user_id").cast("string")).alias("input_sha256"),
        sha256(F.col("event_type")).alias("model_sha256"),
        sha256(value_cents().cast("string")).alias("output_sha256"),
        event_micros().alias("stamp_us"),
    )


REPLAY_SQL = EVENTS_SQL + """,
log AS (
  SELECT event_id AS arrival,
    'REC-' || CASE WHEN event_id % 307 = 0 AND event_id >= 50 THEN event_id - 50 ELSE event_id END AS record_id,
    sha256('n|' || CASE WHEN event_id % 211 = 0 AND event_id >= 50 THEN event_id - 50 ELSE event_id END) AS nonce,
    CASE WHEN event_id % 223 = 0 AND event_id >= 20 THEN event_id - 20 ELSE event_id END AS sequence,
    sha256(CAST(user_id AS VARCHAR)) AS input_sha256,
    sha256(event_type) AS model_sha256,
    sha256(CAST(cents AS VARCHAR)) AS output_sha256,
    us AS stamp_us
  FROM ev)
"""
