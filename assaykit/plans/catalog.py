"""All driver queries."""

from assaykit.plans import core_queries, drift_queries, ingest_queries, log_queries, similarity_queries  # noqa: F401
from assaykit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
