"""Detector evaluation against ground truth, per scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marked(truth: DataFrame, detected: DataFrame, clean: DataFrame) -> DataFrame:
    """One row per (scenario, sample_id) seen anywhere, with its three memberships.

    A full outer join of the three sets, done as a union and one aggregation so a large
    scenario is reduced map-side instead of being shuffled by scenario.
    """
    sides = []
    for df, name in ((truth, "is_true"), (detected, "is_detected"), (clean, "is_clean")):
        sides.append(
            df.select(
                "scenario",
                "sample_id",
                *[F.lit(name == other).alias(other) for other in ("is_true", "is_detected", "is_clean")],
            )
        )
    return (
        sides[0]
        .unionAll(sides[1])
        .unionAll(sides[2])
        .groupBy("scenario", "sample_id")
        .agg(*[F.bool_or(c).alias(c) for c in ("is_true", "is_detected", "is_clean")])
    )


def confusion(marks: DataFrame, clean_only: bool = True) -> DataFrame:
    """Counts per scenario. False positives and true negatives are counted in the clean
    set only, or, with ``clean_only=False``, over everything that is not true."""
    true, found = F.col("is_true"), F.col("is_detected")
    negative = F.col("is_clean") if clean_only else ~true
    return marks.groupBy("scenario").agg(
        F.count_if(true & found).alias("tp"),
        F.count_if(negative & found).alias("fp"),
        F.count_if(true & ~found).alias("fn"),
        F.count_if(negative & ~found).alias("tn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.round(top / F.greatest(F.lit(1), bottom), 3)


def detector_metrics(marks: DataFrame, clean_only: bool = True) -> DataFrame:
    """Precision, recall, F1 and false-positive rate per scenario, three decimals.

    F1 is computed from the rounded precision and recall.
    """
    p, r = F.col("precision"), F.col("recall")
    return (
        confusion(marks, clean_only)
        .withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", F.round(p * r * 2 / F.greatest(F.lit(1e-5), p + r), 3))
        .withColumn("fpr", _ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    )


def macro_metrics(metrics: DataFrame) -> DataFrame:
    """Means over scenarios and the share of scenarios with recall above one half."""
    return metrics.agg(
        F.count(F.lit(1)).alias("total_scenarios"),
        F.count_if(F.col("recall") > 0.5).alias("detected_scenarios"),
        F.round(F.avg("precision"), 3).alias("precision"),
        F.round(F.avg("recall"), 3).alias("recall"),
        F.round(F.avg("f1"), 3).alias("f1"),
        F.round(F.count_if(F.col("recall") > 0.5) / F.count(F.lit(1)), 3).alias("detection_rate"),
    )


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` not in ``right``."""
    return left.distinct().join(right, left.columns, "left_anti")


def anomaly_union(*id_sets: DataFrame) -> DataFrame:
    """Distinct ids over any number of id sets."""
    merged = id_sets[0]
    for other in id_sets[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()
