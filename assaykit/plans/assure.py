"""Whole analyses: dataset assurance, model assurance and the detector benchmark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.columns import primary_label
from assaykit.operators import duplicates, evaluate, findings, generators, knn, labels, outliers, patches, sources
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed


CATEGORY_OF_KIND = {"duplicate": "NEAR_DUPLICATE", "label": "LABEL_FLIP", "ood": "OOD", "trigger": "TRIGGER"}


@dataclass
class DatasetAssurance:
    """Tables of one dataset analysis."""

    duplicate_rows: DataFrame
    duplicate_clusters: DataFrame
    label_suspects: DataFrame
    outliers: DataFrame
    outlier_summary: DataFrame
    patch_rows: DataFrame
    patch_clusters: DataFrame
    anomalies: DataFrame
    samples: DataFrame
    source_risk: DataFrame
    summary: DataFrame
    findings: DataFrame
    finding_samples: DataFrame
    asset_risk: DataFrame


def analyse_dataset(
    dataset_id: str,
    samples: DataFrame,
    features: DataFrame,
    similarity: float = 0.92,
    min_cluster: int = 2,
    ood_share: float = 0.95,
    reference: DataFrame | None = None,
) -> DatasetAssurance:
    """Run all detectors over one dataset and roll their results up.

    samples: ordinal, sample_id, image_path, source_id, batch_id, contributor, labels.
    features: image_path and the columns of the image feature job. Rows are told apart by
    ``ordinal``, so equal file names do not collide; results carry it as ``sample_id``'s
    companion. ``reference`` (ordinal, vector) trains the outlier model.
    """
    measured = features.select("image_path", "vector", "phash", "dhash", "patches")
    rows = checkpointed(samples.join(measured, "image_path").withColumn("label", primary_label(F.col("labels"))))
    population = rows.count()

    hashed = rows.select(F.col("ordinal").alias("ord"), F.col("phash").alias("h1"), F.col("dhash").alias("h2"), "sample_id", "source_id")
    clustered = checkpointed(duplicates.near_duplicates(hashed, similarity, min_cluster))
    clusters = duplicates.cluster_summary(clustered, population, similarity)

    near = knn.labelled_neighbours(rows, "ordinal", "vector", "label")
    suspects = checkpointed(labels.label_suspects(near).withColumnRenamed("id", "ordinal"))

    scored = rows.select("ordinal", "vector")
    flagged_out = checkpointed(outliers.outliers(scored, "ordinal", "vector", reference, ood_share))
    summary_out = outliers.outlier_summary(
        outliers.scored_outliers(scored, "ordinal", "vector", reference), flagged_out, reference is not None
    )

    position = F.create_map(*[F.lit(x) for i, r in enumerate(("TL", "TR", "BL", "BR", "C")) for x in (r, i)])
    opened = rows.select("ordinal", "label", F.explode("patches").alias("p"))
    patch_table = opened.select(
        (position[F.col("p.region")] * F.lit(1 << 40).cast("long") + F.col("ordinal")).alias("ord"),
        F.col("ordinal").alias("sample_id"), F.col("p.region").alias("region"), "label",
        F.transform("p.vec", lambda v: v.cast("double")).alias("vec"),
    )
    patched = checkpointed(patches.patch_clusters(patch_table, population))
    patch_summary = patches.patch_summary(patched)

    anomalies = checkpointed(
        clustered.select(F.col("ord").alias("ordinal"), F.lit("duplicate").alias("kind"))
        .unionAll(suspects.select("ordinal", F.lit("label")))
        .unionAll(flagged_out.select("ordinal", F.lit("ood")))
        .unionAll(patched.select(F.col("sample_id").alias("ordinal"), F.lit("trigger")))
        .distinct()
    )
    marked = sources.suspicion_reasons(
        sources.flag_samples(rows.drop("label", "vector", "phash", "dhash", "patches"), anomalies, ("ordinal",))
    )
    risks = checkpointed(sources.source_risk(marked))
    summary = checkpointed(
        _summary(dataset_id, rows, clusters, clustered, suspects, flagged_out, summary_out, patch_summary, patched, risks)
    )
    found = generators.dataset_findings(summary)
    categories = F.create_map(*[F.lit(x) for kv in CATEGORY_OF_KIND.items() for x in kv])
    affected = anomalies.join(rows.select("ordinal", "sample_id"), "ordinal").select(
        F.lit(dataset_id).alias("asset_id"), categories[F.col("kind")].alias("category"), "ordinal", "sample_id"
    )
    listed = generators.finding_samples(found, affected)
    overall = findings.asset_risk(found, summary.select(F.col("dataset_id").alias("asset_id")))
    return DatasetAssurance(
        clustered, clusters, suspects, flagged_out, summary_out, patched, patch_summary, anomalies, marked, risks, summary, found, listed, overall
    )


def _summary(dataset_id, rows, clusters, clustered, suspects, flagged_out, summary_out, patch_summary, patched, risks) -> DataFrame:
    """All counts of one analysis in one row: a cross join of one-row tables."""
    n = F.count(F.lit(1))
    balance = labels.class_balance(rows, "label").agg(
        F.max("imbalance_ratio").alias("imbalance_ratio"), F.max("total_samples").alias("population")
    )
    parts = [
        balance,
        clusters.agg(n.alias("dup_clusters"), F.count_if("is_flooding").alias("dup_flooding")),
        clustered.agg(n.alias("dup_samples")),
        suspects.agg(n.alias("label_suspects")),
        flagged_out.agg(n.alias("ood_samples")),
        summary_out.select(F.col("confidence").alias("ood_confidence"), "ood_score"),
        patch_summary.agg(n.alias("trigger_clusters"), F.count_if(F.col("severity") == "HIGH").alias("trigger_high")),
        patched.agg(n.alias("trigger_samples")),
        risks.agg(n.alias("sources"), F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("bad_sources")),
    ]
    joined = parts[0].withColumn("dataset_id", F.lit(dataset_id))
    for part in parts[1:]:
        joined = joined.join(part, how="cross")
    return joined


def benchmark(truth: DataFrame, analysis: DatasetAssurance, scenarios: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Score the detectors on a labelled attack table.

    truth: scenario, sample_id, with the clean samples under scenario ``clean_samples``.
    ``scenarios`` maps a truth scenario to the anomaly kind that should find it. Returns
    metrics per scenario and the macro means.
    """
    names = analysis.samples.select("ordinal", "sample_id")
    found = lookup_join(analysis.anomalies, names, ["ordinal"], "inner")
    kinds = F.create_map(*[F.lit(x) for scenario, kind in scenarios.items() for x in (kind, scenario)])
    detected = found.select(kinds[F.col("kind")].alias("scenario"), "sample_id").where("scenario IS NOT NULL")
    clean = truth.where("scenario = 'clean_samples'").select(
        F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario"), "sample_id"
    )
    marks = evaluate.marked(truth.where(F.col("scenario").isin(*scenarios)), detected, clean)
    metrics = checkpointed(evaluate.detector_metrics(marks))
    return metrics, evaluate.macro_metrics(metrics)
