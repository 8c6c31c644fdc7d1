"""Ordered scans and quantiles against plain Python, with hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators.scan import bucket_of, exact_quantiles, ordered_scan, with_bucket
from assaykit.operators.skew import chunked_lists, salted_join


@pytest.mark.parametrize("buckets", [2, 7, 300])
def test_scan_matches_loop(spark, buckets):
    rnd = random.Random(5)
    order = rnd.sample(range(100_000), 300)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", o, rnd.randrange(50)) for o in order]
    df = spark.createDataFrame(rows, "k STRING, o BIGINT, v BIGINT")
    got = ordered_scan(
        df, ["k"], "o", sums={"s": "v"}, totals={"t": "v"}, max_before={"m": "v"}, previous={"p": "v"}, following={"f": "v"},
        index="i", buckets=buckets,
    )
    result = {(r["k"], r["o"]): (r["s"], r["t"], r["m"], r["p"], r["f"], r["i"]) for r in got.collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((o, v) for k, o, v in rows if k == key)
        values = [v for _, v in mine]
        for i, (o, _) in enumerate(mine):
            before = values[:i]
            assert result[(key, o)] == (
                sum(values[: i + 1]), sum(values), max(before) if before else None, before[-1] if before else None,
                values[i + 1] if i + 1 < len(values) else None, i,
            )


@pytest.mark.parametrize("count", [0, 1, 5, 64, 65, 200])
def test_bucket_of_counts_edges(spark, count):
    edges = [float(i * 2) for i in range(count)]
    values = [-1.0, 0.0, 1.0, 7.5, 8.0, 127.0, 128.0, 399.0, 1e9]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", bucket_of(F.col("v"), edges).alias("b"))
    assert [r["b"] for r in rows.collect()] == [sum(e <= v for e in edges) for v in values]


@pytest.mark.parametrize("count", [0, 1, 64, 65, 200, 255, 256])
def test_with_bucket_counts_edges(spark, count):
    edges = [float(i * 2) for i in range(count)]
    values = [-1.0, 0.0, 1.0, 127.0, 128.0, 399.0, 508.0, 509.0, 510.0, 1e9]
    rows = with_bucket(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), F.col("v"), edges)
    assert {r["v"]: r["_bucket"] for r in rows.collect()} == {v: sum(e <= v for e in edges) for v in values}


def test_scan_of_one_list_is_compiled_and_shuffled_once(spark):
    scanned = ordered_scan(spark.range(2000).withColumn("v", F.col("id") % 700), [], "id", max_before={"m": "v"}, buckets=200)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "SortMergeJoin" not in plan
    assert all(r["m"] == (min(r["id"] - 1, 699) if r["id"] else None) for r in scanned.collect())


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=200), "b": np.repeat([1.0, 2.0, 5.0], [1, 100, 3]), "c": np.array([4.0])}
    rows = [(k, float(v)) for k, values in data.items() for v in values]
    shares = [0.0, 0.1, 0.33, 0.5, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "k STRING, v DOUBLE"), ["k"], "v", shares)
    result = {(r["k"], r["share"]): r["quantile"] for r in got.collect()}
    for key, values in data.items():
        for share in shares:
            assert result[(key, share)] == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_salted_join_equals_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        got = sorted(salted_join(big, table, ["k"], how).select("k", "id", "v").collect(), key=str)
        assert got == sorted(big.join(table, "k", how).select("k", "id", "v").collect(), key=str)


def test_chunked_lists_are_bounded_and_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    lists = chunked_lists(rows, ["k"], "id", "ids", size=500).collect()
    assert max(len(r["ids"]) for r in lists) < 700
    assert sorted(i for r in lists for i in r["ids"]) == list(range(5000))
    assert all(r["chunk"] == 0 for r in lists if r["k"] != "hot")
