"""Joins and lists that stay bounded when one key holds a large part of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.session import checkpointed

#: A lookup table is broadcast up to this size by the optimiser's own estimate.
BROADCAST_BYTES = 32 << 20
HEAVY_SHARE = 1 / 1000


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size of a result: file sizes scaled by the columns read, never less
    than the truth by a wide margin, and far more where joins make it unknown. Runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(big: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a big table to a lookup table, broadcast only where its size is known to be small.

    Otherwise it is a shuffle join, which Spark still turns into a broadcast once it has seen
    the real size, and whose hot keys it splits. Nothing is counted beforehand.
    """
    if estimated_bytes(table) <= BROADCAST_BYTES:
        return big.join(F.broadcast(table), on, how)
    return big.join(table, on, how)


def heavy_keys(df: DataFrame, on: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of all rows, with the number of salts to use.

    There can be at most ``1/share`` such keys, so the result is safe to broadcast.
    """
    counts = df.groupBy(*on).count()
    total = df.count()
    limit = max(1.0, total * share)
    return counts.where(F.col("count") > limit).select(
        *on, F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("_salts")
    )


def salted_join(big: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join (inner or left) with every hot key of ``big`` spread over many tasks."""
    heavy = F.broadcast(heavy_keys(big, on))
    columns = big.columns
    left = big.join(heavy, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*columns), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    )
    right = (
        table.join(heavy, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    extra = [c for c in table.columns if c not in on]
    return left.join(right, [*on, "_salt"], how).select(*columns, *extra)


def chunked_lists(
    df: DataFrame, keys: list[str], value: str, out: str, size: int = 10_000, tie: str | None = None
) -> DataFrame:
    """Collect ``value`` per key into sorted arrays of bounded length.

    Columns keys, ``chunk``, ``out``. A key with at most ``size`` rows gives one row with
    chunk 0; a larger one is spread by hash over as many rows as it needs, so no task
    ever holds a whole hot key and nothing is left out.
    """
    sizes = checkpointed(
        df.groupBy(*keys).count().where(F.col("count") > size).select(
            *keys, F.ceil(F.col("count") / F.lit(size / 2)).cast("int").alias("_chunks")
        )
    )
    spread = lookup_join(df, sizes, keys, "left")
    seed = F.xxhash64(F.col(tie or value))
    return (
        spread.withColumn("chunk", F.pmod(seed, F.coalesce(F.col("_chunks"), F.lit(1))).cast("int"))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(value)).alias(out))
    )
