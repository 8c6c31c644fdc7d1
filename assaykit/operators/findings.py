"""Findings: filters, asset risk, counts, paging and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions import risk
from assaykit.operators.scan import ordered_scan
from assaykit.operators.skew import chunked_lists, lookup_join

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# Categories counted as dataset anomalies in a report.
DATASET_CATEGORIES = ("NEAR_DUPLICATE", "LABEL_FLIP", "OOD", "TRIGGER")


def filter_findings(
    findings: DataFrame,
    asset_id: str | None = None,
    category: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Equality filters, AND-ed; an argument left out filters nothing."""
    for column, value in (("asset_id", asset_id), ("category", category), ("severity", severity)):
        if value:
            findings = findings.where(F.col(column) == value)
    return findings


def search_findings(
    findings: DataFrame, asset_text: str = "", severity: str = "", category: str = ""
) -> DataFrame:
    """Case-insensitive substring on the asset id plus exact severity and category."""
    found = filter_findings(findings, category=category, severity=severity)
    needle = asset_text.strip().lower()
    if needle:
        found = found.where(F.lower(F.coalesce(F.col("asset_id"), F.lit(""))).contains(needle))
    return found


def for_assets(findings: DataFrame, dataset_id: str | None = None, model_id: str | None = None) -> DataFrame:
    """Findings of the dataset or the model given, or all of them."""
    wanted = [a for a in (dataset_id, model_id) if a]
    return findings.where(F.col("asset_id").isin(*wanted)) if wanted else findings


def with_status(table: DataFrame, status: str = "ALL") -> DataFrame:
    return table if status == "ALL" else table.where(F.col("status") == status)


def by_keys(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Bulk point lookup: the rows of ``table`` whose key is listed."""
    return lookup_join(table, keys.select(on).distinct(), [on], "inner")


def without(
    findings: DataFrame, assets: list[str], id_prefix: str, asset_type: str
) -> DataFrame:
    """Rows left after deleting listed assets, ids with a prefix, or one asset type."""
    drop = (
        F.col("asset_id").isin(*assets)
        | F.col("finding_id").startswith(id_prefix)
        | (F.col("asset_type") == asset_type)
    )
    return findings.where(~F.coalesce(drop, F.lit(False)))


def finding_ids(findings: DataFrame, order: str) -> DataFrame:
    """Number findings within each asset in ``order`` (numeric, unique per asset)."""
    numbered = ordered_scan(findings, ["asset_id"], order, index="_index")
    return numbered.withColumn(
        "finding_id", F.format_string("F-%s-%03d", F.col("asset_id"), F.col("_index") + 1)
    ).drop("_index")


def _factor_weight() -> Column:
    """Weight of a finding inside its asset; unknown severity or category counts 1."""
    return (
        risk.weight_of(F.coalesce(F.col("severity"), F.lit("LOW")), risk.SEVERITY_WEIGHTS, 1.0)
        * risk.weight_of(F.coalesce(F.col("category"), F.lit("UNKNOWN")), risk.CATEGORY_WEIGHTS, 1.0)
        * F.coalesce(F.col("confidence"), F.lit(0.5))
    )


def contributing_factors(findings: DataFrame) -> DataFrame:
    """What each finding adds to its asset, one row per finding."""
    return findings.select(
        "asset_id",
        "category",
        "severity",
        F.col("risk_score").alias("finding_score"),
        "confidence",
        _factor_weight().alias("contribution_weight"),
    )


def asset_risk(findings: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Score, level, disposition and explanation per asset.

    With ``assets`` (column asset_id) assets without findings are listed too, as LOW.
    """
    weight = _factor_weight()
    sums = findings.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum(F.coalesce(F.col("risk_score"), F.lit(0.0)) * weight).alias("_score"),
        F.sum(weight).alias("_weight"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_findings"),
        F.count_if(F.col("severity") == "HIGH").alias("high_findings"),
    )
    if assets is not None:
        sums = assets.select("asset_id").distinct().join(sums, "asset_id", "left")
        sums = sums.fillna(0, ["findings", "_score", "_weight", "critical_findings", "high_findings"])
    raw = (
        F.col("_score") / F.greatest(F.lit(1.0), F.col("_weight"))
        + F.col("critical_findings") * 15.0
        + F.col("high_findings") * 5.0
    )
    scored = sums.withColumn("risk_score", F.least(F.lit(100.0), F.round(raw, 1)))
    score, critical, high = F.col("risk_score"), F.col("critical_findings"), F.col("high_findings")
    quarantine = (score >= risk.QUARANTINE_AT) | (critical > 0)
    review = (score >= risk.REVIEW_AT) | (high > 0)
    level = (
        F.when(quarantine, "CRITICAL")
        .when(review & (score >= risk.HIGH_AT), "HIGH")
        .when(review, "MEDIUM")
        .otherwise("LOW")
    )
    # Wording of the explanation.
    explanation = F.when(
        F.col("findings") == 0, "No integrity violations or anomalies detected."
    ).otherwise(
        F.concat(
            F.lit("Overall risk evaluated as "), F.col("risk_level"),
            F.lit(" ("), score.cast("string"), F.lit("/100) across "), F.col("findings").cast("string"),
            F.lit(" findings. Critical findings: "), critical.cast("string"),
            F.lit(", High findings: "), high.cast("string"), F.lit("."),
        )
    )
    return (
        scored.withColumn("risk_level", level)
        .withColumn(
            "disposition",
            F.when(quarantine, "QUARANTINE").when(review, "REVIEW").otherwise("ACCEPT"),
        )
        .withColumn("explanation", explanation)
        .drop("_score", "_weight")
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity in upper case; anything unknown counts as LOW."""
    upper = F.upper(F.coalesce(F.col("severity"), F.lit("LOW")))
    return (
        findings.groupBy(F.when(upper.isin(*SEVERITIES), upper).otherwise("LOW").alias("severity"))
        .agg(F.count(F.lit(1)).alias("findings"))
    )


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings per category, smallest first."""
    return (
        findings.where(F.coalesce(F.col("category"), F.lit("")) != "")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("findings"))
        .orderBy("findings", "category")
    )


def latest_first(table: DataFrame, *columns: str) -> DataFrame:
    return table.orderBy(*[F.col(c).desc() for c in columns])


def page(table: DataFrame, key: str, limit: int, offset: int = 0, after=None) -> DataFrame:
    """One page in key order. ``after`` (last key seen) reads any page at the same cost;
    ``offset`` suits the first pages."""
    if after is not None:
        table = table.where(F.col(key) > after)
    ordered = table.orderBy(key)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def top_by_risk(findings: DataFrame, count: int = 5, tie: str = "finding_id") -> DataFrame:
    return findings.orderBy(F.col("risk_score").desc(), F.col(tie)).limit(count)


def first_per_group(table: DataFrame, group: str, order: list[Column], count: int) -> DataFrame:
    """First rows per group; Spark keeps only ``count`` rows per group before the shuffle."""
    window = W.partitionBy(group).orderBy(*order)
    return table.withColumn("position", F.row_number().over(window)).where(F.col("position") <= count)


def latest_version(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key of an append-only change table."""
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"))
    return newest.select(*keys, "row.*")


def truncated(array: Column, count: int) -> Column:
    return F.slice(array, 1, count)


def members_except_self(members: Column, own: Column) -> Column:
    return F.array_except(members, F.array(own))


def affected_lists(rows: DataFrame, keys: list[str], sample: str, size: int = 10_000) -> DataFrame:
    """Affected samples per finding as bounded arrays."""
    return chunked_lists(rows, keys, sample, "affected_samples", size)


def status_summary(results: DataFrame, group: str | None = None) -> DataFrame:
    """Check results (status PASS / PARTIAL / FAIL) to totals and an overall status."""
    keys = [group] if group else []
    counted = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "PARTIAL").alias("partial"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )
    return counted.withColumn(
        "score", F.round(F.col("passed") / F.greatest(F.lit(1), F.col("total")) * 100, 1)
    ).withColumn(
        "overall_status", F.when(F.col("failed") == 0, "COMPLIANT").otherwise("NON_COMPLIANT")
    )
