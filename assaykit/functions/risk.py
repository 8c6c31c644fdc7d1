"""Risk scores, levels and dispositions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity and category weights, score thresholds.
SEVERITY_WEIGHTS = {"LOW": 1.0, "MEDIUM": 2.5, "HIGH": 6.0, "CRITICAL": 10.0}
CATEGORY_WEIGHTS = {
    "NEAR_DUPLICATE": 1.2,
    "LABEL_FLIP": 2.0,
    "SYSTEMATIC_MISLABEL": 2.5,
    "OOD": 1.5,
    "TRIGGER": 3.0,
    "MODEL_SUBSTITUTION": 3.5,
    "MODEL_MODIFICATION": 3.0,
    "BACKDOOR_BEHAVIOUR": 3.2,
    "TAMPERING": 4.0,
    "REPLAY": 3.0,
    "DISTRIBUTION_SHIFT": 1.8,
    "SOURCE_POISONING": 2.8,
    "CONFIGURATION_MISMATCH": 2.0,
    "PROVENANCE_VIOLATION": 3.8,
}
REVIEW_AT = 40.0
QUARANTINE_AT = 75.0
HIGH_AT = 60.0


def weight_of(key: Column, weights: dict[str, float], default: float) -> Column:
    """Look a weight up in a literal map; unknown keys get ``default``."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def finding_score(
    category: Column, severity: Column, confidence: Column, affected: Column, population: Column
) -> Column:
    """Unrounded 0..100 score of one finding."""
    share = F.greatest(
        F.lit(0.05), F.least(F.lit(1.0), affected / F.greatest(F.lit(1), population))
    )
    score = (
        weight_of(F.upper(severity), SEVERITY_WEIGHTS, 2.0)
        * 7.0
        * (weight_of(F.upper(category), CATEGORY_WEIGHTS, 1.5) / 2.0)
        * (confidence * 0.6 + 0.4)
        * (share * 0.3 + 0.7)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def finding_risk(
    category: Column, severity: Column, confidence: Column, affected: Column, population: Column
) -> Column:
    """Finding score rounded to one decimal."""
    return F.round(finding_score(category, severity, confidence, affected, population), 1)


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= QUARANTINE_AT, "CRITICAL")
        .when(score >= HIGH_AT, "HIGH")
        .when(score >= REVIEW_AT, "MEDIUM")
        .otherwise("LOW")
    )


def disposition(score: Column) -> Column:
    return (
        F.when(score >= QUARANTINE_AT, "QUARANTINE")
        .when(score >= REVIEW_AT, "REVIEW")
        .otherwise("ACCEPT")
    )
