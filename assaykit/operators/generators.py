"""Findings from detector results: one row per asset and category found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import risk
from assaykit.operators.skew import lookup_join


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _finding(
    category: str, severity: Column, confidence: Column, affected: Column, population: Column,
    title: Column, description: Column, evidence: list[Column], method: str, limitation: str,
    recommendation: Column | None = None,
) -> Column:
    raw = risk.finding_score(F.lit(category), severity, confidence, affected, population)
    score = F.round(raw, 1)
    return F.struct(
        F.lit(category).alias("category"),
        severity.alias("severity"),
        confidence.cast("double").alias("confidence"),
        score.alias("risk_score"),
        affected.cast("bigint").alias("affected"),
        title.alias("title"),
        description.alias("description"),
        F.array(*evidence).alias("evidence"),
        F.lit(method).alias("detection_method"),
        F.array(F.lit(limitation)).alias("limitations"),
        (recommendation if recommendation is not None else risk.disposition(score)).alias("recommendation"),
    )


def _spread(summary: DataFrame, asset_type: str, asset: str, candidates: list[tuple[Column, Column]]) -> DataFrame:
    """Keep the candidates whose condition holds and number them within their asset."""
    cells = F.array_compact(F.array(*[F.when(when, finding) for when, finding in candidates]))
    rows = summary.select(F.col(asset).alias("asset_id"), F.posexplode(cells).alias("_i", "f"))
    return rows.select(
        F.format_string("F-%s-%03d", F.col("asset_id"), F.col("_i") + 1).alias("finding_id"),
        F.lit(asset_type).alias("asset_type"),
        "asset_id",
        "f.*",
    )


def dataset_findings(summary: DataFrame) -> DataFrame:
    """Findings of many datasets from one summary row each.

    summary: dataset_id, population, dup_clusters, dup_flooding, dup_samples,
    label_suspects, imbalance_ratio, ood_samples, ood_confidence, trigger_clusters,
    trigger_high, trigger_samples, sources, bad_sources.
    """
    c = F.col
    population = c("population")
    duplicate = _finding(
        "NEAR_DUPLICATE", F.when(c("dup_flooding") > 0, "HIGH").otherwise("MEDIUM"), F.lit(0.94),
        c("dup_samples"), population,
        _text("Near-duplicate clusters: ", c("dup_clusters")),
        _text(c("dup_samples"), " samples form near-identical clusters: redundant ingestion or flooding."),
        [_text("Clusters: ", c("dup_clusters")), _text("Duplicated samples: ", c("dup_samples")),
         _text("Flooding clusters: ", c("dup_flooding"))],
        "Hamming distance of two 64-bit perceptual hashes",
        "Heavy cropping or warping may not match 64-bit perceptual hashes.",
    )
    label = _finding(
        "LABEL_FLIP", F.when(c("label_suspects") >= 5, "HIGH").otherwise("MEDIUM"), F.lit(0.86),
        c("label_suspects"), population,
        _text("Label noise: ", c("label_suspects"), " samples"),
        F.lit("Assigned labels contradict the consensus of the nearest neighbours."),
        [_text("Conflicting samples: ", c("label_suspects")), _text("Class imbalance ratio: ", c("imbalance_ratio"), ":1")],
        "k-nearest-neighbour label disagreement",
        "Relies on low-level features; subtle semantic differences may overlap.",
    )
    ood = _finding(
        "OOD", F.when(c("ood_samples") < 10, "MEDIUM").otherwise("HIGH"), c("ood_confidence"),
        c("ood_samples"), population,
        _text("Out-of-distribution samples: ", c("ood_samples")),
        F.lit("Samples lie outside the feature distribution of the population."),
        [_text("Samples beyond the anomaly cut-off: ", c("ood_samples"))],
        "Isolation forest",
        "Unsupervised; gains from an explicit reference population.",
    )
    trigger = _finding(
        "TRIGGER", F.when(c("trigger_high") > 0, "CRITICAL").otherwise("HIGH"), F.lit(0.89),
        c("trigger_samples"), population,
        _text("Repeated local patches: ", c("trigger_clusters"), " clusters"),
        F.lit("A local pattern repeats across samples and correlates with a label."),
        [_text("Clusters: ", c("trigger_clusters")), _text("Samples: ", c("trigger_samples"))],
        "Per-region patch cosine clustering",
        "Detects fixed patches; blended or frequency-domain marks need other methods.",
        F.lit("QUARANTINE"),
    )
    source = _finding(
        "SOURCE_POISONING", F.lit("HIGH"), F.lit(0.85), c("bad_sources"), c("sources"),
        _text("Sources with elevated risk: ", c("bad_sources")),
        F.lit("Some sources contribute a disproportionate share of anomalous samples."),
        [_text("Sources at HIGH or CRITICAL: ", c("bad_sources"), " of ", c("sources"))],
        "Batch, contributor and source roll-up",
        "Needs source and contributor metadata.",
    )
    return _spread(
        summary, "DATASET", "dataset_id",
        [
            (c("dup_clusters") > 0, duplicate), (c("label_suspects") > 0, label), (c("ood_samples") > 0, ood),
            (c("trigger_clusters") > 0, trigger), (c("bad_sources") > 0, source),
        ],
    )


def model_findings(summary: DataFrame) -> DataFrame:
    """Findings of many models from one summary row each.

    summary: model_id, status, severity, confidence, recommendation (fingerprint
    comparison; null if none), behavioural_agreement_rate, anomalous_inputs_count,
    total_battery_tests, high_vulnerability_detected.
    """
    c = F.col
    one = F.lit(1)
    swap = _finding(
        "MODEL_SUBSTITUTION", c("severity"), c("confidence"), one, one,
        _text("Model integrity deviation: ", c("status")),
        F.lit("The candidate differs from its reference model."),
        [_text("Fingerprint status: ", c("status"))],
        "SHA-256 and tensor-statistics comparison", "Needs a valid reference model.", c("recommendation"),
    )
    percent = F.floor(F.round(c("behavioural_agreement_rate") * 100, 6)).cast("int")
    behaviour = _finding(
        "BACKDOOR_BEHAVIOUR", F.when(percent < 65, "HIGH").otherwise("MEDIUM"), F.lit(0.85),
        c("anomalous_inputs_count"), c("total_battery_tests"),
        _text("Behaviour differs from reference (agreement ", percent, "%)"),
        _text(c("anomalous_inputs_count"), " of ", c("total_battery_tests"), " tests disagree with the reference."),
        [_text("Class agreement: ", percent, "%"), _text("Disagreeing inputs: ", c("anomalous_inputs_count"))],
        "Perturbation battery", "Subtle triggers may need gradient methods.",
    )
    trigger = _finding(
        "TRIGGER", F.lit("HIGH"), F.lit(0.82), one, one,
        F.lit("Predictions collapse under a local patch"),
        F.lit("A small checkerboard patch moves most predictions into one class."),
        [F.lit("Top-class share at or above the collapse limit")],
        "Patch perturbation collapse search", "Natural or dynamic triggers may be missed.", F.lit("REVIEW"),
    )
    return _spread(
        summary, "MODEL", "model_id",
        [
            (F.coalesce(c("status") != "MATCH", F.lit(False)), swap),
            (F.coalesce(c("behavioural_agreement_rate") < 0.85, F.lit(False)), behaviour),
            (F.coalesce(c("high_vulnerability_detected"), F.lit(False)), trigger),
        ],
    )


def inference_findings(verified: DataFrame) -> DataFrame:
    """One finding per tampered or replayed record. verified: record_id, arrival, status."""
    c = F.col
    one = F.lit(1)
    tamper = _finding(
        "TAMPERING", F.lit("CRITICAL"), F.lit(1.0), one, one,
        _text("Tampering detected in record ", c("record_id")),
        F.lit("A bound component or the signature no longer matches the record."),
        [_text("Status: ", c("status"))], "Hash binding and signature check", "", F.lit("QUARANTINE"),
    )
    replay = _finding(
        "REPLAY", F.lit("HIGH"), F.lit(0.95), one, one,
        _text("Replay detected on record ", c("record_id")),
        F.lit("The record reuses an identifier, nonce, sequence or payload."),
        [_text("Status: ", c("status"))], "Nonce and sequence freshness", "", F.lit("QUARANTINE"),
    )
    found = verified.withColumn("asset", _text(c("record_id"), "@", c("arrival")))
    return _spread(
        found, "INFERENCE", "asset",
        [(c("status").isin("TAMPERED", "INVALID_SIGNATURE"), tamper), (c("status") == "REPLAY_DETECTED", replay)],
    )


def shift_findings(shift: DataFrame, features: int) -> DataFrame:
    """A finding for each detected distribution shift. shift: asset_id plus the columns of
    the shift classification; ``features`` is how many features were compared."""
    c = F.col
    finding = _finding(
        "DISTRIBUTION_SHIFT", c("severity"), c("confidence"), c("significant_drift_features_count"), F.lit(features),
        _text("Distribution drift: ", c("classification")),
        _text(c("significant_drift_features_count"), " features drift: ", c("classification")),
        [_text("Classification: ", c("classification"))], "PSI and Kolmogorov-Smirnov tests",
        "Statistical shift only; semantic shift needs other estimators.", c("recommendation"),
    )
    return _spread(shift, "DATASET", "asset_id", [(c("overall_shift_detected"), finding)])


def finding_samples(findings: DataFrame, affected: DataFrame) -> DataFrame:
    """All affected samples of all findings, a row each: finding_id, ordinal, sample_id.

    affected: asset_id, category, ordinal, sample_id. The table is the complete list that a
    finding's ``affected`` counts; a report takes from it what it shows.
    """
    keys = findings.select("finding_id", "asset_id", "category")
    return lookup_join(affected, keys, ["asset_id", "category"], "inner").select("finding_id", "ordinal", "sample_id").distinct()
