"""Drift statistics against numpy on small populations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions.kolmogorov import two_sample_p
from assaykit.operators import drift, ecdf


def _psi(ref, cand):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)).astype(np.float32).astype(float))
    if len(edges) <= 2:
        return 0.0
    r, c = (np.histogram(x, bins=edges)[0] for x in (ref, cand))
    pr = (r + 1e-4) / (r.sum() + 1e-4 * len(r))
    pc = (c + 1e-4) / (c.sum() + 1e-4 * len(c))
    return float(np.clip(((pc - pr) * np.log(pc / pr)).sum(), 0, 10))


def _gaps(ref, cand):
    values = np.unique(np.concatenate([ref, cand]))
    gap = np.abs([(ref <= v).mean() - (cand <= v).mean() for v in values])
    return gap.max(), (gap[:-1] * np.diff(values)).sum()


def _js(ref, cand):
    low, high = min(ref.min(), cand.min()), max(ref.max(), cand.max())
    if high <= low:
        return 0.0
    edges = (low + np.arange(15) * ((high - low) / 14)).astype(np.float32).astype(float)
    edges[-1] = high
    p, q = (np.histogram(x, bins=edges, density=True)[0] + 1e-5 for x in (ref, cand))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(np.sqrt(((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2))


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(4)
    columns = {
        "same": (rng.normal(100, 15, 100), rng.normal(100, 15, 100)),
        "moved": (rng.normal(50, 10, 100), rng.normal(150, 10, 100)),
        "steps": (rng.integers(0, 4, 100).astype(float), rng.integers(1, 6, 100).astype(float)),
        "constant": (np.full(100, 3.0), np.full(100, 5.0)),
    }
    names = list(columns)
    def frame(side):
        return spark.createDataFrame([[float(columns[n][side][i]) for n in names] for i in range(100)], names)

    rows = {r["feature"]: r for r in drift.drift_metrics(frame(0), frame(1), names).collect()}
    for name, pair in columns.items():
        ref, cand = (x.astype(np.float32).astype(float) for x in pair)
        ks, w1 = _gaps(ref, cand)
        got = rows[name]
        assert got["psi"] == pytest.approx(_psi(ref, cand), abs=1e-9), name
        assert got["ks_statistic"] == pytest.approx(ks, abs=1e-12)
        assert got["wasserstein_distance"] == pytest.approx(w1, rel=1e-9)
        assert got["jensen_shannon_divergence"] == pytest.approx(_js(ref, cand), abs=1e-9)
        assert got["ks_p_value"] == pytest.approx(two_sample_p(ks, 100, 100))
    assert rows["same"]["psi"] < 1 and not rows["constant"]["psi"]
    assert rows["moved"]["is_significant_drift"] and rows["moved"]["ks_statistic"] > 0.5
    assert rows["constant"]["is_significant_drift"]  # a constant reference drifts by KS only


def test_ranges_of_uneven_columns(spark, monkeypatch):
    """A value of a third of all rows, nulls, NaNs, few values, one side shorter; many small ranges."""
    monkeypatch.setattr(ecdf, "RANGE_ROWS", 50)
    rng = np.random.default_rng(8)
    sides = []
    for n, shift in ((3_000, 0.0), (1_700, 0.4)):
        hot = np.where(rng.random(n) < 0.34, 7.0, rng.normal(shift, 3, n))
        gone = np.where(rng.random(n) < 0.3, np.nan, rng.exponential(1 + shift, n))
        sides.append({"hot": hot, "gone": gone, "few": rng.integers(0, 3, n).astype(float), "wide": rng.normal(0, 1e6 * (1 + shift), n)})
    names = list(sides[0])

    def frame(side):
        rows = [[None if name == "gone" and i % 5 == 0 else float(side[name][i]) for name in names] for i in range(len(side["hot"]))]
        return spark.createDataFrame(rows, ", ".join(f"{n} DOUBLE" for n in names)).repartition(5)

    for row in drift.drift_metrics(frame(sides[0]), frame(sides[1]), names).collect():
        kept = [side[row["feature"]][[i for i in range(len(side["hot"])) if row["feature"] != "gone" or i % 5]] for side in sides]
        ref, cand = (x[~np.isnan(x)].astype(np.float32).astype(float) for x in kept)
        ks, w1 = _gaps(ref, cand)
        assert (row["n_ref"], row["n_cand"]) == (len(ref), len(cand))
        assert row["psi"] == pytest.approx(_psi(ref, cand), abs=1e-9), row["feature"]
        assert row["ks_statistic"] == pytest.approx(ks, abs=1e-12) and row["wasserstein_distance"] == pytest.approx(w1, rel=1e-9)
        assert row["jensen_shannon_divergence"] == pytest.approx(_js(ref, cand), abs=1e-9)
        assert row["reference_mean"] == pytest.approx(ref.mean(), rel=1e-9)


def test_too_few_values(spark):
    one = spark.createDataFrame([(1.0,)], "x DOUBLE")
    row = drift.drift_metrics(one, one, ["x"]).first()
    assert (row["psi"], row["ks_statistic"], row["ks_p_value"], row["is_significant_drift"]) == (0.0, 0.0, 1.0, False)


@pytest.mark.parametrize("drifting,want", [
    ([], ("NORMAL", "LOW", 0.92, "ACCEPT")),
    (["contrast"], ("OPERATIONAL_DRIFT", "MEDIUM", 0.85, "REVIEW")),
    (["r_mean", "g_mean"], ("ANOMALOUS", "MEDIUM", 0.80, "REVIEW")),
    (["brightness", "r_mean", "g_mean"], ("ANOMALOUS", "HIGH", 0.88, "REVIEW")),
    (["brightness", "contrast", "r_mean", "g_mean", "b_mean"], ("SUSPICIOUS", "HIGH", 0.91, "QUARANTINE")),
])
def test_shift_ladder(spark, drifting, want):
    names = ["brightness", "contrast", "r_mean", "g_mean", "b_mean", "saturation"]
    metrics = spark.createDataFrame([(n, n in drifting, 10, 10) for n in names], "feature STRING, is_significant_drift BOOLEAN, n_ref BIGINT, n_cand BIGINT")
    row = drift.classify_shift(metrics).first()
    assert (row["classification"], row["severity"], row["confidence"], row["recommendation"]) == want


def test_empty_side_is_insufficient(spark):
    full = spark.createDataFrame([(1.0,), (2.0,)], "brightness DOUBLE")
    row = drift.drift_report(full, full.where("false"), ["brightness"])[1].first()
    assert (row["status"], row["classification"], row["overall_shift_detected"]) == ("INSUFFICIENT_DATA", "NORMAL", False)


@pytest.mark.parametrize("d,n,m,want", [(0.5, 3, 4, 0.6571428571), (0.6, 5, 5, 0.3571428571), (1.0, 10, 10, 2 / 184756), (0.0, 5, 5, 1.0)])
def test_small_p_values(d, n, m, want):
    assert two_sample_p(d, n, m) == pytest.approx(want, rel=1e-8)


def test_large_p_values_meet_the_limit_law():
    # the limiting distribution at z = 1.36 leaves five per cent
    n = 4_000_000
    assert two_sample_p(1.3581 / np.sqrt(n / 2), n, n) == pytest.approx(0.05, abs=2e-4)
    assert two_sample_p(0.5, n, n) < 1e-12


def test_stored_ranges_take_twelve_bytes_a_value(spark):
    both = spark.range(5_000).select((F.col("id") % 2 == 0).alias("r"), (F.col("id") / 7).cast("float").cast("double").alias("v0"))
    features = ecdf.described(both, ["x"])
    kept = ecdf.ranged(both, features).selectExpr("sum(length(values) + length(refs) + length(cands)) AS n").first()["n"]
    assert kept == 12 * 5_000
