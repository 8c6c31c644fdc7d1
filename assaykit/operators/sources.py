"""Roll-up of sample anomalies to batch, contributor and source risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.skew import chunked_lists, lookup_join
from assaykit.schemas import ANOMALY_KINDS
from assaykit.session import checkpointed

# Weight of each anomaly kind in the source score.
KIND_WEIGHTS = {"duplicate": 1.0, "ood": 1.5, "label": 2.5, "trigger": 4.0}
MEMBER_RATIO = 0.3


def anomaly_flags(anomalies: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Long anomaly rows (keys, kind) to one row per sample with a flag per kind."""
    flags = [F.bool_or(F.col("kind") == k).alias(k) for k in ANOMALY_KINDS]
    return anomalies.groupBy(*keys).agg(*flags)


def flag_samples(
    samples: DataFrame, anomalies: DataFrame, keys: tuple[str, ...] = ("sample_id",)
) -> DataFrame:
    """Samples with one boolean per anomaly kind and ``is_suspicious``."""
    joined = samples.join(anomaly_flags(anomalies, keys), list(keys), "left").fillna(
        False, list(ANOMALY_KINDS)
    )
    return joined.withColumn(
        "is_suspicious", F.greatest(*[F.col(k) for k in ANOMALY_KINDS])
    )


def suspicion_reasons(flagged: DataFrame) -> DataFrame:
    """Add ``anomaly_reasons``: the texts of the flags set, in fixed order."""
    # Reason text per anomaly kind, in output order.
    texts = {
        "duplicate": "Near duplicate cluster",
        "label": "Label disagreement with neighbors",
        "ood": "Feature outlier (OOD)",
        "trigger": "Contains repeated localized trigger patch",
    }
    reasons = F.array_compact(F.array(*[F.when(F.col(k), t) for k, t in texts.items()]))
    return flagged.withColumn("anomaly_reasons", reasons)


def risk_cells(flagged: DataFrame) -> DataFrame:
    """Counts per (source, batch, contributor): all that the roll-ups read."""
    return flagged.groupBy("source_id", "batch_id", "contributor").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_suspicious").alias("bad"),
        *[F.count_if(k).alias(k) for k in ANOMALY_KINDS],
    )


def _group_risk(cells: DataFrame) -> DataFrame:
    grouped = cells.groupingSets(
        [["source_id", "batch_id"], ["source_id", "contributor"]],
        "source_id",
        "batch_id",
        "contributor",
    ).agg(
        F.grouping("batch_id").alias("_no_batch"), F.sum("n").alias("total"), F.sum("bad").alias("suspicious")
    )
    ratio = F.col("suspicious") / F.col("total")
    by_contributor = F.col("_no_batch") == 1
    return grouped.select(
        "source_id",
        F.when(by_contributor, "contributor").otherwise("batch").alias("level"),
        F.when(by_contributor, F.col("contributor")).otherwise(F.col("batch_id")).alias("member"),
        "total",
        "suspicious",
        ratio.alias("ratio"),
        (ratio > MEMBER_RATIO).alias("is_anomalous"),
    )


def group_risk(flagged: DataFrame) -> DataFrame:
    """Suspicious share of every batch and contributor inside its source.

    Long form: source_id, level, member, total, suspicious, ratio, is_anomalous.
    """
    return _group_risk(risk_cells(flagged))


def source_risk(flagged: DataFrame) -> DataFrame:
    """One row per source: counts, score, level, disposition, anomalous member counts.

    The samples are reduced once, map-side first, to (source, batch, contributor); a source
    holding a third of them is spread over its batches and contributors until then.
    """
    # stored: column pruning would otherwise give the two levels below different plans
    # and read the samples twice
    cells = checkpointed(risk_cells(flagged))
    counts = cells.groupBy("source_id").agg(
        F.sum("n").alias("sample_count"),
        F.sum("bad").alias("suspicious_count"),
        F.sum("duplicate").alias("duplicate_clusters"),
        F.sum("ood").alias("ood_count"),
        F.sum("label").alias("label_anomalies"),
        F.sum("trigger").alias("trigger_count"),
    )
    members = _group_risk(cells).groupBy("source_id").agg(
        F.count_if(F.col("is_anomalous") & (F.col("level") == "batch")).alias("anomalous_batches"),
        F.count_if(F.col("is_anomalous") & (F.col("level") == "contributor")).alias(
            "anomalous_contributors"
        ),
    )
    total = F.col("sample_count")
    ratio = F.col("suspicious_count") / total
    weighted = (
        F.col("duplicate_clusters") * KIND_WEIGHTS["duplicate"]
        + F.col("ood_count") * KIND_WEIGHTS["ood"]
        + F.col("label_anomalies") * KIND_WEIGHTS["label"]
        + F.col("trigger_count") * KIND_WEIGHTS["trigger"]
    )
    score = F.least(F.lit(100.0), F.round(weighted / total * 70.0 + ratio * 30.0, 1))
    scored = counts.withColumn("risk_score", score).withColumn("_ratio", ratio)
    critical = (F.col("risk_score") >= 70) | (F.col("trigger_count") >= 3)
    high = (F.col("risk_score") >= 35) | (F.col("_ratio") >= 0.15)
    medium = (F.col("risk_score") >= 15) | (F.col("_ratio") >= 0.05)
    laddered = scored.withColumn(
        "risk_level",
        F.when(critical, "CRITICAL").when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"),
    ).withColumn(
        "disposition",
        F.when(critical, "QUARANTINE").when(high | medium, "REVIEW").otherwise("ACCEPT"),
    )
    return laddered.drop("_ratio").join(members, "source_id", "left")


def anomalous_members(flagged: DataFrame, size: int = 10_000) -> DataFrame:
    """Names of anomalous batches and contributors per source, in bounded arrays."""
    listed = group_risk(flagged).where("is_anomalous")
    return chunked_lists(listed, ["source_id", "level"], "member", "members", size)


def tag_with_source_level(samples: DataFrame, risks: DataFrame) -> DataFrame:
    """Samples with the level and disposition of their source."""
    return lookup_join(samples, risks.select("source_id", "risk_level", "disposition"), ["source_id"])
