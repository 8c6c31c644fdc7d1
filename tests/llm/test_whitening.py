"""Jacobi-Davidson whitening against numpy's dense solver."""

import numpy as np
import pytest

from assaykit.llm import whitening as w

COLUMNS = "vec_id long, embedding array<float>, n string, _x int, whitened string, label int"


def rows_of(vectors, first=0):
    return [(first + i, None if v is None else [None if c is None else float(c) for c in v], "own", 1, "w", 7) for i, v in enumerate(vectors)]


def dense(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (fit * n - s) / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    apart = x * n - s
    return n, (apart.astype(object) ** 2).sum(axis=1).tolist(), apart / n @ basis / np.sqrt(values), values / np.trace(z.T @ z / n)


def same(found, vectors, k):
    n, deviation, white, explained = dense(vectors, k)
    got = np.array([r["whitened"] for r in found])
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got * sign, white, atol=1e-9)
    assert [r["deviation"] for r in found] == deviation and {r["n"] for r in found} == {n}
    assert np.allclose(found[0]["explained"], explained, rtol=1e-9) and found[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("width, kind", [(3, "plain"), (40, "plain"), (96, "falling"), (30, "equal"), (30, "flat")])
def test_pairs_of_a_matrix(width, kind):
    r = np.random.default_rng(width)
    turn = np.linalg.qr(r.standard_normal((width, width)))[0]
    values = {"plain": r.random(width), "falling": 1 / np.arange(1, width + 1), "equal": np.where(np.arange(width) < 9, 4.0, 1.0), "flat": np.where(np.arange(width) < 2, 3.0, 0.0)}[kind]
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    wanted = min(8, width)
    found, vectors = w.leading_pairs(lambda q: matrix @ q, width, wanted)
    assert np.allclose(found, np.sort(values)[::-1][:wanted], atol=1e-13 * values.max())
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-13 * values.max()
    assert np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-13)


def test_minres_solves_projected_equations():
    r = np.random.default_rng(1)
    matrix = r.standard_normal((12, 12))
    matrix += matrix.T
    own = np.linalg.qr(r.standard_normal((12, 2)))[0]
    right = r.standard_normal((12, 2))
    project = lambda b: b - own * (own * b).sum(axis=0)
    right = project(right)
    t = w.minres(lambda q: matrix @ q, np.array([0.3, -0.2]), project, right, 40)
    assert np.allclose(project(matrix @ t - t * np.array([0.3, -0.2])), right, atol=1e-8) and np.allclose((own * t).sum(axis=0), 0)


def test_whitening_of_edge_vectors(spark):
    r = np.random.default_rng(7)
    good = (r.standard_normal((120, 20)) * np.linspace(1, 3, 20)).tolist()
    good += good[:30] + [good[3]] * 40 + [[0.0] * 20]
    bad = [None, [], [float("nan")] + [1.0] * 19, [float("inf")] * 20, [None] + [0.5] * 19, [1.0, 2.0], [1e30] * 20]
    table = spark.createDataFrame(rows_of(good) + rows_of(bad, 1_000) + [(None, good[0], "own", 1, "w", 7)], COLUMNS).repartition(5)
    found = w.whiten(table)
    assert found.columns == ["vec_id", "embedding", "_x", "label", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    assert sorted(r["vec_id"] for r in rows if r["vec_id"] is not None) == list(range(len(good)))
    assert sum(r["vec_id"] is None for r in rows) == 1 and len(rows[0]["whitened"]) == 16
    same(sorted((r for r in rows if r["vec_id"] is not None), key=lambda r: r["vec_id"]), good, 16)


def test_fewer_dimensions_and_no_variance(spark):
    r = np.random.default_rng(9)
    low = np.round(r.standard_normal((50, 3)) @ r.standard_normal((3, 8)) * 8) / 8
    low[:, 3:] = low[:, :5] * 2
    table = spark.createDataFrame(rows_of(low.tolist()), COLUMNS)
    rows = w.whiten(table).orderBy("vec_id").collect()
    rank = np.linalg.matrix_rank(np.floor(64 * low) - np.floor(64 * low).mean(axis=0))
    assert len(rows[0]["whitened"]) == rank
    same(rows, low.tolist(), rank)
    for some in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None]):
        assert w.whiten(spark.createDataFrame(rows_of(some), COLUMNS)).count() == 0


def test_a_deviation_beyond_a_long_is_an_error(spark):
    table = spark.createDataFrame(rows_of([[1e12], [-1e12]]), COLUMNS)
    with pytest.raises(Exception, match="fit a long"):
        w.whiten(table).collect()
