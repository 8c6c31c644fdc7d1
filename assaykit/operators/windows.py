"""Time-windowed status counts, sessions and drift. The plans of windows run on streams as they are.

Sessions are built from cells: windows as long as the gap, so that all records of one key in
a cell belong to one session. Cells are partial aggregates, and a busy key brings one row per
cell to its sessions however many records it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.times import epoch_micros
from assaykit.operators.drift import PSI_EPS
from assaykit.operators.scan import bucket_of, exact_quantiles


def _start(window: str) -> Column:
    return epoch_micros(F.col(window)["start"].cast("timestamp_ntz"))


def status_per_window(records: DataFrame, length: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """Total, tampered, replayed and valid records per tumbling or sliding window."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        records.groupBy(window.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("is_tampered").alias("tampered"),
            F.count_if("is_replayed").alias("replayed"),
            F.count_if(~F.col("is_tampered") & ~F.col("is_replayed")).alias("valid"),
        )
        .select(_start("w").alias("start_us"), "total", "tampered", "replayed", "valid")
    )


def session_cells(
    records: DataFrame, key: str, gap: str, time: str = "ts", counters: dict[str, Column] | None = None
) -> DataFrame:
    """Records per key and window of length ``gap``: key, at, first_us, until_us, records, ``counters``.

    ``until_us`` is when the session ends if nothing follows. ``counters`` are sums.
    """
    stamp = epoch_micros(F.col(time).cast("timestamp_ntz"))
    cells = records.groupBy(key, F.window(time, gap).alias("w")).agg(
        F.min(stamp).alias("first_us"), F.max(stamp).alias("last_us"), F.count(F.lit(1)).alias("records"),
        *[F.sum(c).cast("bigint").alias(name) for name, c in (counters or {}).items()],
    )
    length = epoch_micros(F.col("w")["end"].cast("timestamp_ntz")) - _start("w")
    return cells.select(
        key, F.window_time("w").alias("at"), "first_us", (F.col("last_us") + length).alias("until_us"), "records", *(counters or {})
    )


def joined_cells(cells: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Sessions from cells: key, start_us, records, ``counters``."""
    order = W.partitionBy(key).orderBy("first_us")
    ended = F.lag("until_us").over(order)
    numbered = cells.withColumn("_new", F.when(F.col("first_us") < ended, 0).otherwise(1)).withColumn(
        "_session", F.sum("_new").over(order)
    )
    sums = [F.sum(c).alias(c) for c in ("records", *counters)]
    return numbered.groupBy(key, "_session").agg(F.min("first_us").alias("start_us"), *sums).drop("_session")


def sessions(records: DataFrame, key: str, gap: str, time: str = "ts") -> DataFrame:
    """Sessions per key: runs of records less than ``gap`` apart. Records without a time are left out."""
    return joined_cells(session_cells(records, key, gap, time), key, [])


def baseline_bins(reference: DataFrame, value: str, bins: int = 10) -> tuple[list[float], list[float]]:
    """Quantile edges of a baseline and its share per bin: ``bins`` numbers each.

    Returns (edges, shares). Two edges or fewer leave no shares: nothing drifts then.
    """
    shares = [i / bins for i in range(bins + 1)]
    edges = sorted({r["quantile"] for r in exact_quantiles(reference, [], value, shares).collect()})
    if len(edges) <= 2:
        return edges, []
    counts = dict.fromkeys(range(len(edges) - 1), 0)
    binned = reference.where(F.col(value).isNotNull()).groupBy(_bin(value, edges).alias("bin")).count()
    counts.update({r["bin"]: r["count"] for r in binned.collect()})
    total = sum(counts.values())
    scale = total + PSI_EPS * len(counts)
    return edges, [(counts[b] + PSI_EPS) / scale for b in sorted(counts)]


def _bin(value: str, edges: list[float]) -> Column:
    inner = edges[1:-1]
    return bucket_of(F.col(value), inner).cast("int")


def drift_per_window(
    records: DataFrame,
    value: str,
    baseline: tuple[list[float], list[float]],
    length: str,
    slide: str | None = None,
    time: str = "ts",
) -> DataFrame:
    """PSI of every window against a fixed baseline.

    One aggregation with a counter per bin, so it also runs as a streaming query.
    """
    edges, shares = baseline
    window = F.window(time, length, slide) if slide else F.window(time, length)
    inside = records.where(F.col(value).between(edges[0], edges[-1]))
    counters = bin_counters(value, baseline)
    counts = inside.groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in counters.items()]
    )
    return counts.select(_start("w").alias("start_us"), "n", _psi(F.col("n"), shares).alias("psi"))


def bin_counters(value: str, baseline: tuple[list[float], list[float]]) -> dict[str, Column]:
    """A 0/1 column per bin of the baseline; all 0 for a value outside it or without one."""
    edges, shares = baseline
    if not shares:
        return {}
    inside = F.col(value).between(edges[0], edges[-1])
    found = F.when(inside, _bin(value, edges))
    return {f"_b{b}": F.when(found == b, 1).otherwise(0) for b in range(len(shares))}


def _psi(n: Column, shares: list[float]) -> Column:
    scale = n + PSI_EPS * len(shares)
    psi = F.lit(0.0)
    for b, expected in enumerate(shares):
        share = (F.col(f"_b{b}") + PSI_EPS) / scale
        psi = psi + (share - expected) * F.log(share / expected)
    return F.least(F.greatest(psi, F.lit(0.0)), F.lit(10.0))


def session_psi(sessions: DataFrame, key: str, baseline: tuple[list[float], list[float]]) -> DataFrame:
    """Sessions with bin counts to key, start_us, records, n, psi.

    ``n`` counts the values inside the baseline's range; without one psi is null, and with a
    baseline of no bins it is 0.
    """
    _, shares = baseline
    n = F.lit(0)
    for b in range(len(shares)):
        n = n + F.col(f"_b{b}")
    psi = F.when(n > 0, _psi(n, shares)) if shares else F.lit(0.0)
    return sessions.select(key, "start_us", "records", n.cast("bigint").alias("n"), psi.alias("psi"))


def drift_per_session(
    records: DataFrame, key: str, value: str, baseline: tuple[list[float], list[float]], gap: str, time: str = "ts"
) -> DataFrame:
    """PSI of every session of every key against a fixed baseline: key, start_us, records, n, psi."""
    counters = bin_counters(value, baseline)
    cells = session_cells(records, key, gap, time, counters)
    return session_psi(joined_cells(cells, key, list(counters)), key, baseline)
