"""Record, event and dataset ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12


def random_id(prefix: str) -> Column:
    """``PREFIX-`` and 12 random hex digits; a retried task draws new ones, so write the
    rows before using the ids twice."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, DIGITS)))


def stable_id(prefix: str, *keys: Column) -> Column:
    """``PREFIX-`` and 12 hex digits of a digest of the keys: the same on every run."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(text, 256), 1, DIGITS)))
