"""The driver contract, and the quick registered queries against their SQL twins.

``python tests/oracle.py`` compares all of them.
"""

import pytest
from oracle import connect, difference

import __spark_entry__ as driver
from assaykit.functions.ids import random_id

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "sample_flags", "source_risk", "source_group_risk", "anomalous_members", "detector_metrics", "macro_metrics",
    "truth_set_operations", "finding_risk", "asset_risk", "finding_numbers", "first_per_asset_type", "path_parts",
    "exact_quantiles", "score_cutoff", "canonical_objects", "ledger_verify", "tamper_check", "replay_reasons",
    "daily_status", "user_sessions", "embedding_hashes", "softmax_top", "coco_samples", "nested_annotations",
    "box_issues", "corner_boxes", "tensor_statistics", "fingerprint_comparison", "prediction_agreement",
    "dataset_findings", "stable_ids",
]


def test_contract(spark):
    queries, twins = driver.queries(), driver.oracle_sql()
    assert set(twins) <= set(queries) and len(twins) > 100
    result = driver.entry(spark)
    assert result.count() > 0 and "risk_score" in result.columns


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    assert difference(driver.queries()[name](spark, FOLDER), connect(FOLDER), driver.oracle_sql()[name]) is None


def test_random_ids(spark):
    rows = spark.range(50).select(random_id("REC").alias("i")).collect()
    assert len({r["i"] for r in rows}) == 50 and all(len(r["i"]) == 16 and r["i"].startswith("REC-") for r in rows)
