"""Report tables: one header row, chart data and export projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.findings import DATASET_CATEGORIES, first_per_group, latest_version

# Chart score shown for an asset without one.
DEFAULT_SCORES = {"DATASET": 45.0, "MODEL": 85.0, "SOURCE": 65.0}

# Header names of the findings CSV, in column order.
CSV_COLUMNS = {
    "Finding ID": "finding_id", "Asset Type": "asset_type", "Asset ID": "asset_id", "Category": "category",
    "Severity": "severity", "Confidence": "confidence", "Risk Score": "risk_score", "Title": "title",
    "Recommendation": "recommendation", "Detection Method": "detection_method",
    "Affected Samples Count": "affected_count", "Evidence": "evidence_text", "Limitations": "limitations_text",
    "Description": "description",
}


def executive_summary(findings: DataFrame) -> DataFrame:
    """Counts over all findings given, in one row: severities, anomaly categories, shifts,
    and whether any model was substituted."""
    sev, cat = F.col("severity"), F.col("category")
    return findings.agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count_if(sev == s).alias(f"{s.lower()}_findings") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.count_if(cat.isin(*DATASET_CATEGORIES)).alias("dataset_anomalies"),
        F.count_if(cat == "DISTRIBUTION_SHIFT").alias("shift_events_recorded"),
        F.coalesce(F.bool_or(cat == "MODEL_SUBSTITUTION"), F.lit(False)).alias("model_substituted"),
    ).select(
        "*",
        F.when(F.col("dataset_anomalies") > 0, "EVALUATED_ANOMALIES_DETECTED").otherwise("PASS").alias("dataset_integrity"),
        F.when(F.col("model_substituted"), "SUBSTITUTION_DETECTED").otherwise("PASS").alias("model_integrity"),
    )


def report_header(
    findings: DataFrame, asset_risk: DataFrame, record_counts: DataFrame,
    dataset: DataFrame | None = None, model: DataFrame | None = None, newest: str = "finding_id",
) -> DataFrame:
    """One nested row: overall risk and verdict, executive summary, dataset, model,
    distribution and inference sections.

    ``asset_risk`` and ``record_counts`` have one row each, as have ``dataset`` and ``model``
    where given; without them, or where they have no row, their section says that none was
    selected. The shift shown is the description of the shift finding with the greatest
    ``newest``. The findings stay a table of their own; a report of any size is the header
    plus that table.
    """
    overall = asset_risk.select(
        F.struct("risk_score", "risk_level", "disposition", "explanation").alias("overall"),
        F.col("disposition").alias("assessment_verdict"),
    )
    executive = executive_summary(findings)
    inference = record_counts.select(F.struct(*record_counts.columns).alias("inference_assurance"))
    joined = overall.join(executive.select(F.struct(*executive.columns).alias("executive_summary")), how="cross")
    for part in (_section(dataset, "dataset"), _section(model, "model"), _distribution(findings, newest), inference):
        joined = joined if part is None else joined.join(part, how="cross")
    for name, given in (("dataset", dataset), ("model", model)):
        chosen = F.lit(False) if given is None else F.col(name).isNotNull()
        status = F.when(chosen, "SELECTED").otherwise(f"NO_{name.upper()}_SELECTED")
        joined = joined.withColumn(f"{name}_status", status)
    return joined


def _section(table: DataFrame | None, name: str) -> DataFrame | None:
    """The only row of a table as one struct, null where there is none."""
    return None if table is None else table.agg(F.first(F.struct(*table.columns)).alias(name))


def _distribution(findings: DataFrame, newest: str) -> DataFrame:
    shift = F.col("category") == "DISTRIBUTION_SHIFT"
    text = F.col("description") if "description" in findings.columns else F.col("category")
    return findings.agg(
        F.struct(
            F.count_if(shift).alias("shift_events_recorded"),
            F.coalesce(F.max_by(F.when(shift, text), F.when(shift, F.col(newest))), F.lit("NORMAL")).alias("recent_shift"),
        ).alias("distribution")
    )


def findings_with_assets(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Findings with the summary columns of their asset, where it is registered."""
    return findings.join(assets, "asset_id", "left")


def csv_rows(findings: DataFrame) -> DataFrame:
    """The 14 columns of the findings CSV, from findings as the generators make them."""
    shaped = (
        findings.withColumn("affected_count", F.col("affected"))
        .withColumn("evidence_text", F.array_join("evidence", " | "))
        .withColumn("limitations_text", F.array_join("limitations", " | "))
        .withColumn("description", F.regexp_replace("description", "\n", " "))
    )
    return shaped.select(*[F.col(c).alias(name) for name, c in CSV_COLUMNS.items()])


def risk_chart(assets: DataFrame, per_type: int = 3) -> DataFrame:
    """The first assets of each type with their score; assets: asset_type, name, position,
    risk_score. A missing or zero score shows the default of its type."""
    first = first_per_group(assets, "asset_type", [F.col("position")], per_type).drop("position")
    default = F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_SCORES.items() for x in kv]), F.col("asset_type"))
    score = F.when(F.coalesce(F.col("risk_score"), F.lit(0.0)) == 0, default).otherwise(F.col("risk_score"))
    return first.withColumn("risk_score", score)


def source_chart(risks: DataFrame) -> DataFrame:
    score = F.when(F.coalesce(F.col("risk_score"), F.lit(0.0)) == 0, 20.0).otherwise(F.col("risk_score"))
    return risks.select("source_id", score.alias("risk_score"), F.coalesce("suspicious_count", F.lit(0)).alias("suspicious_count"))


def audit_timeline(events: DataFrame, order: str = "seq", count: int = 15) -> DataFrame:
    """The first ledger entries in order."""
    return events.orderBy(order).limit(count)


def dataset_status(summaries: DataFrame, risks: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets with their analysis counts and risk; newest version of each dataset row."""
    current = latest_version(datasets, ["dataset_id"], "version")
    analysed = summaries.join(risks.withColumnRenamed("asset_id", "dataset_id"), "dataset_id", "left").fillna(
        {"risk_score": 0.0, "disposition": "ACCEPT"}
    )
    joined = current.join(analysed, "dataset_id", "left")
    return joined.withColumn("status", F.when(F.col("risk_score").isNotNull(), "ANALYZED").otherwise(F.col("status")))
