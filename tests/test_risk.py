"""Risk formulas against published example values."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import risk
from assaykit.operators import findings as fnd
from assaykit.operators import report

GOLDENS = [
    ("NEAR_DUPLICATE", "HIGH", 0.95, 5, 49, 17.9),
    ("LABEL_FLIP", "HIGH", 0.92, 5, 49, 29.2),
    ("OOD", "HIGH", 0.75, 4, 49, 19.4),
    ("TRIGGER", "CRITICAL", 0.95, 5, 49, 74.4),
    ("SOURCE_POISONING", "HIGH", 0.90, 2, 3, 49.7),
    ("MODEL_SUBSTITUTION", "CRITICAL", 1.0, 1, 1, 100.0),
    ("BACKDOOR_BEHAVIOUR", "HIGH", 0.90, 24, 24, 63.2),
    ("REPLAY", "HIGH", 0.95, 1, 1, 61.1),
    ("OOD", "MEDIUM", 0.75, 2, 25, 8.1),
]


@pytest.fixture
def scored(spark):
    rows = spark.createDataFrame(
        [(i, *g) for i, g in enumerate(GOLDENS)],
        "i INT, category STRING, severity STRING, confidence DOUBLE, affected INT, population INT, want DOUBLE",
    )
    columns = [F.col(c) for c in ("category", "severity", "confidence", "affected", "population")]
    return rows.withColumn("risk_score", risk.finding_risk(*columns))


def test_finding_risk_goldens(scored):
    for row in scored.collect():
        assert row["risk_score"] == row["want"], row


def test_asset_risk_golden(scored):
    five = scored.where("i < 5").withColumn("asset_id", F.lit("DS"))
    row = fnd.asset_risk(five).first()
    assert (row["risk_score"], row["risk_level"], row["disposition"]) == (85.5, "CRITICAL", "QUARANTINE")
    assert row["explanation"].startswith("Overall risk evaluated as CRITICAL (85.5/100) across 5 findings.")


def test_asset_without_findings_is_low(spark, scored):
    assets = spark.createDataFrame([("DS",), ("EMPTY",)], "asset_id STRING")
    rows = {r["asset_id"]: r for r in fnd.asset_risk(scored.withColumn("asset_id", F.lit("DS")), assets).collect()}
    assert rows["EMPTY"]["risk_level"] == "LOW" and rows["EMPTY"]["risk_score"] == 0.0
    assert rows["EMPTY"]["explanation"] == "No integrity violations or anomalies detected."


def test_unknown_weights(spark):
    row = spark.range(1).select(risk.finding_risk(F.lit("odd"), F.lit("odd"), F.lit(1.0), F.lit(1), F.lit(1)).alias("s")).first()
    assert row["s"] == round(2.0 * 7 * 1.5 / 2, 1)


def test_ladder_edges(spark):
    rows = spark.createDataFrame([(39.9,), (40.0,), (60.0,), (75.0,)], "s DOUBLE")
    got = [(r["l"], r["d"]) for r in rows.select(risk.risk_level(F.col("s")).alias("l"), risk.disposition(F.col("s")).alias("d")).collect()]
    assert got == [("LOW", "ACCEPT"), ("MEDIUM", "REVIEW"), ("HIGH", "REVIEW"), ("CRITICAL", "QUARANTINE")]


def test_page_by_key_equals_offset(spark):
    rows = spark.range(100)
    assert fnd.page(rows, "id", 10, offset=20).collect() == fnd.page(rows, "id", 10, after=19).collect()


def test_csv_projection(spark):
    row = spark.createDataFrame(
        [("F-1", "DATASET", "DS", "OOD", "LOW", 0.5, 1.0, "t", "a\nb", ["e1", "e2"], 1, "m", ["l1", "l2"], "ACCEPT")],
        "finding_id STRING, asset_type STRING, asset_id STRING, category STRING, severity STRING, confidence DOUBLE, risk_score DOUBLE, "
        "title STRING, description STRING, evidence ARRAY<STRING>, affected BIGINT, detection_method STRING, limitations ARRAY<STRING>, recommendation STRING",
    )
    out = report.csv_rows(row)
    assert len(out.columns) == 14
    first = out.first()
    assert first["Evidence"] == "e1 | e2" and first["Description"] == "a b" and first["Affected Samples Count"] == 1
