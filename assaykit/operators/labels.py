"""Label balance and nearest-neighbour label consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.columns import suspect_source
from assaykit.operators.skew import lookup_join

HEAVY_IMBALANCE = 8.0


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Count per class with the table-wide total and max/min imbalance ratio."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("samples"))
    overall = counts.agg(
        F.sum("samples").alias("total_samples"),
        (F.max("samples") / F.greatest(F.lit(1), F.min("samples"))).alias("_ratio"),
    )
    # one-row table
    return counts.join(F.broadcast(overall), how="cross").select(
        label,
        "samples",
        "total_samples",
        F.round("_ratio", 2).alias("imbalance_ratio"),
        (F.round("_ratio", 2) > HEAVY_IMBALANCE).alias("is_heavily_imbalanced"),
    )


def neighbour_consensus(neighbours: DataFrame) -> DataFrame:
    """Label vote of each row's neighbours.

    ``neighbours``: id, label, rank, neighbour_label. Ties go to the label of the nearest
    neighbour. One group holds at most k rows.
    """
    votes = neighbours.groupBy("id", "label", "neighbour_label").agg(
        F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first_rank")
    )
    return votes.groupBy("id", "label").agg(
        F.sum("votes").alias("k"),
        F.coalesce(F.sum(F.when(F.col("neighbour_label") == F.col("label"), F.col("votes"))), F.lit(0)).alias("own_votes"),
        F.max_by("neighbour_label", F.struct("votes", (-F.col("first_rank")).alias("near"))).alias("consensus"),
    )


def label_suspects(neighbours: DataFrame) -> DataFrame:
    """Rows whose neighbours mostly carry another label.

    Flagged at 60 % disagreement when the consensus differs, HIGH from 80 %. Rows
    labelled ``unlabelled`` vote but are never flagged. The comparisons are on integers.
    """
    other = F.col("k") - F.col("own_votes")
    return (
        neighbour_consensus(neighbours)
        .where(F.col("label").cast("string") != "unlabelled")
        .where((other * 10 >= F.col("k") * 6) & (F.col("consensus") != F.col("label")))
        .select(
            "id",
            F.col("label").alias("assigned_label"),
            F.col("consensus").alias("consensus_neighbor_label"),
            F.round(other / F.col("k"), 2).alias("disagreement_rate"),
            F.when(other * 10 >= F.col("k") * 8, "HIGH").otherwise("MEDIUM").alias("confidence"),
        )
    )


def suspect_reason(source: str, assigned: str, consensus: str, rate: str):
    """Reason text of a flagged row."""
    # Wording of the reason.
    percent = F.floor(F.round(F.col(rate) * 100, 6)).cast("int").cast("string")
    return F.concat(
        F.lit("Sample label '"), F.col(assigned).cast("string"), F.lit("' disagrees with "), percent,
        F.lit("% of feature-space nearest neighbors (consensus: '"), F.col(consensus).cast("string"), F.lit("')."),
        F.when(suspect_source(F.col(source)), " Source flagged as high-risk.").otherwise(""),
    )


def suspect_details(suspects: DataFrame, samples: DataFrame) -> DataFrame:
    """Suspects with where they come from and why. samples: id, source_id, batch_id."""
    joined = lookup_join(suspects, samples.select("id", "source_id", "batch_id"), ["id"], "inner")
    return joined.withColumn(
        "reason", suspect_reason("source_id", "assigned_label", "consensus_neighbor_label", "disagreement_rate")
    )
