"""Distribution drift between a reference and a candidate table.

All features are handled at once: values of both tables go to ranges of sketched quantiles
in one shuffle, and every statistic is read exactly from the ranges' sorted arrays. Values
are compared in single precision. Nulls and NaNs are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.kolmogorov import two_sample_p
from assaykit.operators.ecdf import distributions
from assaykit.operators.scan import exact_quantiles, ordered_scan
from assaykit.session import checkpointed, pinned

PSI_EPS = 1e-4
JS_BINS = 14
JS_EPS = 1e-5
OPERATIONAL = ("brightness", "contrast")


def _single(value: Column) -> Column:
    return value.cast("float").cast("double")


def value_counts(reference: DataFrame, candidate: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, n_ref, n_cand): how often each value occurs on each side."""
    sides = []
    for df, ref, cand in ((reference, 1, 0), (candidate, 0, 1)):
        typed = df.select(*[_single(F.col(f)).alias(f) for f in features])
        sides.append(
            typed.unpivot([], features, "feature", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value"))
            .select("feature", "value", F.lit(ref).alias("r"), F.lit(cand).alias("c"))
        )
    return (
        sides[0]
        .unionAll(sides[1])
        .groupBy("feature", "value")
        .agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cand"))
    )


def scanned_counts(counts: DataFrame) -> DataFrame:
    """Value counts with running counts, totals and the next larger value per feature."""
    return ordered_scan(
        counts,
        ["feature"],
        "value",
        sums={"upto_ref": "n_ref", "upto_cand": "n_cand"},
        totals={"total_ref": "n_ref", "total_cand": "n_cand"},
        following={"next_value": "value"},
    )


def psi_edges(scanned: DataFrame, bins: int = 10) -> DataFrame:
    """Distinct reference quantile edges per feature, as one short array."""
    quantiles = exact_quantiles(
        scanned,
        ["feature"],
        "value",
        [i / bins for i in range(bins + 1)],
        counted=scanned.select(
            "feature",
            "value",
            F.col("n_ref").alias("n"),
            F.col("upto_ref").alias("upto"),
            F.col("total_ref").alias("total"),
        ),
    )
    # bins + 1 values per feature
    return quantiles.groupBy("feature").agg(
        F.array_sort(F.collect_set(_single(F.col("quantile")))).alias("edges")
    )


@F.pandas_udf(T.DoubleType())
def ks_p_value(statistic: pd.Series, n_ref: pd.Series, n_cand: pd.Series) -> pd.Series:
    return pd.Series([two_sample_p(d, int(n), int(m)) for d, n, m in zip(statistic, n_ref, n_cand)])


def drift_metrics(
    reference: DataFrame, candidate: DataFrame, features: list[str], bins: int = 10
) -> DataFrame:
    """PSI, KS, Wasserstein-1, Jensen-Shannon, means and verdict: one row per feature.

    Metrics are unrounded. A feature with fewer than two values on a side gives zeros
    and p = 1.
    """
    known = distributions(reference, candidate, features)
    joint = {i: _joint_edges(f.low, f.high) for i, f in enumerate(known.features) if f.low is not None and f.high > f.low}
    distance, quantiles, equal = known.gaps([i / bins for i in range(bins + 1)], joint, JS_BINS)
    edges = {i: np.unique(q.astype(np.float32).astype(np.float64)) for i, q in quantiles.items() if known.features[i].n_ref}
    tenths = known.counts({i: e for i, e in edges.items() if len(e) > 2})
    # one row per feature name given
    rows = []
    for i, f in enumerate(known.features):
        if f.n_ref + f.n_cand == 0:
            continue
        values = (0.0, 0.0, 0.0, 0.0)
        if f.n_ref >= 2 and f.n_cand >= 2:
            values = (
                stability_index(*tenths[i]) if i in tenths else 0.0, *distance[i],
                density_distance(*equal[i], np.diff(joint[i])) if i in joint else 0.0,
            )
        rows.append((f.name, f.n_ref, f.n_cand, *map(float, values), f.mean_ref, f.mean_cand))
    schema = (
        "feature STRING, n_ref BIGINT, n_cand BIGINT, psi DOUBLE, ks_statistic DOUBLE, wasserstein_distance DOUBLE,"
        " jensen_shannon_divergence DOUBLE, reference_mean DOUBLE, candidate_mean DOUBLE"
    )
    measured = reference.sparkSession.createDataFrame(rows, schema)
    measured = measured.withColumn("ks_p_value", ks_p_value("ks_statistic", "n_ref", "n_cand"))
    return measured.withColumn("is_significant_drift", significant())


def _joint_edges(low: float, high: float) -> np.ndarray:
    """Edges of equal bins over the joint range, the inner ones in single precision."""
    edges = (low + np.arange(JS_BINS + 1) * ((high - low) / JS_BINS)).astype(np.float32).astype(np.float64)
    edges[-1] = high
    return edges


def stability_index(ref: np.ndarray, cand: np.ndarray) -> float:
    """Population stability index of two histograms, between 0 and 10."""
    share_r = (ref + PSI_EPS) / (ref.sum() + len(ref) * PSI_EPS)
    share_c = (cand + PSI_EPS) / (cand.sum() + len(cand) * PSI_EPS)
    return float(np.clip(((share_c - share_r) * np.log(share_c / share_r)).sum(), 0.0, 10.0))


def density_distance(ref: np.ndarray, cand: np.ndarray, widths: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms as densities."""
    p, q = (h / widths / (h.sum() or 1.0) + JS_EPS for h in (ref, cand))
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    return float(np.sqrt(max(0.0, (p * np.log(p / middle) + q * np.log(q / middle)).sum() / 2)))


def significant() -> Column:
    """Drift verdict from the psi, ks_statistic and ks_p_value columns."""
    return (F.col("psi") >= 0.2) | ((F.col("ks_statistic") >= 0.35) & (F.col("ks_p_value") < 0.01))


def classify_shift(metrics: DataFrame, operational: tuple[str, ...] = OPERATIONAL) -> DataFrame:
    """One row: class, severity, confidence and recommendation from the drifting features."""
    totals = metrics.agg(
        F.count_if("is_significant_drift").alias("drifting"),
        F.coalesce(
            F.bool_or(F.col("is_significant_drift") & F.col("feature").isin(*operational)), F.lit(False)
        ).alias("lighting"),
        F.coalesce(F.min(F.least("n_ref", "n_cand")), F.lit(0)).alias("smallest"),
    )
    m, lighting = F.col("drifting"), F.col("lighting")
    empty = F.col("smallest") == 0

    def ladder(none, none_found, lit_up, few, several, many):
        return (
            F.when(empty, F.lit(none))
            .when(m == 0, F.lit(none_found))
            .when((m <= 2) & lighting, F.lit(lit_up))
            .when(m <= 2, F.lit(few))
            .when(m <= 4, F.lit(several))
            .otherwise(F.lit(many))
        )

    return totals.select(
        F.when(empty, "INSUFFICIENT_DATA").otherwise("SUCCESS").alias("status"),
        ladder("NORMAL", "NORMAL", "OPERATIONAL_DRIFT", "ANOMALOUS", "ANOMALOUS", "SUSPICIOUS").alias(
            "classification"
        ),
        ladder("LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH").alias("severity"),
        ladder(0.0, 0.92, 0.85, 0.80, 0.88, 0.91).alias("confidence"),
        ladder("ACCEPT", "ACCEPT", "REVIEW", "REVIEW", "REVIEW", "QUARANTINE").alias("recommendation"),
        (~empty & (m > 0)).alias("overall_shift_detected"),
        m.alias("significant_drift_features_count"),
    )


def drift_report(
    reference: DataFrame, candidate: DataFrame, features: list[str], operational: tuple[str, ...] = OPERATIONAL
) -> tuple[DataFrame, DataFrame]:
    """Per-feature metrics and the one-row shift classification over them."""
    metrics = pinned(drift_metrics(reference, candidate, features))
    return metrics, classify_shift(metrics, operational)
