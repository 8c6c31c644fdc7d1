"""Collision-counting search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, _b int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0, 0) for i, v in rows], SCHEMA)


def brute(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-float((x * y).sum()), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(found, wanted):
    hits = sum(len({i for i, _ in w} & set(found.get(q, []))) for q, w in wanted.items())
    return hits / sum(map(len, wanted.values()))


@pytest.mark.parametrize("kind", ["random", "clustered", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 48))
    if kind == "clustered":
        x = rng.normal(size=(30, 48))[rng.integers(0, 30, 3_000)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.uniform(0.5, 2, size=(3_000, 1))
    rows = [(n, [float(v) for v in r]) for n, r in enumerate(x)]
    out = neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, block_rows=1_200, query_rows=100).collect()
    found, wanted = {}, brute(rows, 20)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(v) == 20 for v in found.values()) and set(found) == set(wanted)
    assert recall(found, wanted) >= 0.9
    score = {(r["query_id"], r["vec_id"]): r["score"] for r in out}
    for q, best in wanted.items():
        for i, s in best:
            assert (q, i) not in score or score[q, i] == pytest.approx(s, abs=1e-12)


def test_few_rows_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]),
        (100, [inf, 1.0]), (None, [1.0, 1.0]), (5, []), (7, [1.0, None]), (120, [1.0, 2.0, 3.0]), (140, [1.0, 2.0, 3.0]), (9, [-1.0, 0.5]), (2, [1.0, 0.0]),
    ]
    out = neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=4).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got[0] == [(1, 2, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 20, 0.0)]
    assert [v for _, v, _ in got[20]] == [9, 0, 2, 2] and got[120] == [(1, 140, 14.0)] and set(got) == {0, 20, 120, 140}
    assert neighbours.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_windows_widen_until_all_are_in():
    index = neighbours.Index(np.eye(3))
    assert [c.tolist() for c in index.candidates(np.array([[1.0, 0, 0]]), 3)] == [[0, 1, 2]]
