"""Ordered scans (running sums, previous row, row index) that never sort one key in one task.

A window over ``partitionBy(key).orderBy(seq)`` puts a whole key in one task, which fails
when one key holds a third of the table. Here the order column is cut into buckets at its
approximate quantiles, each (key, bucket) is scanned on its own, and per-bucket summaries,
at most one row per bucket and key, carry the running state across bucket borders. The
bucket of a row depends only on its value, so a retried task reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.session import shuffle_partitions

MAX_BUCKETS = 4096


def order_edges(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Distinct approximate quantiles of ``column``: at most ``buckets`` numbers."""
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(16, 4 * shuffle_partitions(df.sparkSession)))
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(
        F.percentile_approx(F.col(column).cast("double"), shares, 10 * buckets).alias("edges")
    ).first()
    return sorted({float(e) for e in (row["edges"] or [])})


def bucket_of(value: Column, edges: list[float]) -> Column:
    """How many edges are <= value, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < edges[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    if len(edges) <= 64:
        return F.coalesce(tree(0, len(edges)), F.lit(0)) if edges else F.lit(0)
    # many edges: a binary search over one constant array keeps the expression small
    table = F.array(*[F.lit(e) for e in edges])
    found = F.aggregate(
        F.array(*[F.lit(s) for s in _steps(edges)]),
        F.lit(0),
        lambda acc, s: acc + F.when(F.get(table, acc + s - 1) <= value, s).otherwise(F.lit(0)),
    )
    return F.coalesce(found, F.lit(0))


def _steps(edges: list[float]) -> list[int]:
    """Powers of two, falling, that a binary search over the edges takes."""
    return [1 << i for i in reversed(range(len(edges).bit_length()))]


def with_bucket(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """``df`` with ``_bucket``, the ``bucket_of`` ``value``.

    With many edges each step of the search is a projection of its own: those are compiled,
    which the lambda in ``bucket_of`` is not.
    """
    if len(edges) <= 64:
        return df.withColumn("_bucket", bucket_of(value, edges))
    table = F.array(*[F.lit(e) for e in edges])
    found = df.withColumn("_bucket", F.lit(0))
    for step in _steps(edges):
        passed = F.when(F.get(table, F.col("_bucket") + (step - 1)) <= value, step).otherwise(0)
        found = found.withColumn("_bucket", F.col("_bucket") + passed)
    return found


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    sums: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    max_before: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    index: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ordered-scan columns to ``df`` (``order`` is numeric and unique within ``keys``).

    sums: running sum up to and including the row; totals: sum over the whole key;
    max_before: maximum over earlier rows; previous / following: value on the adjacent
    row; index: 0-based row number. Every argument maps new column -> existing column.
    """
    sums, totals = sums or {}, totals or {}
    max_before, previous, following = max_before or {}, previous or {}, following or {}
    edges = order_edges(df, order, buckets)
    cut = with_bucket(df, F.col(order).cast("double"), edges)
    group = [*keys, "_bucket"]

    per_bucket = [F.count(F.lit(1)).alias("_n")]
    for out, column in {**sums, **totals}.items():
        per_bucket.append(F.sum(column).alias(f"_s_{out}"))
    for out, column in max_before.items():
        per_bucket.append(F.max(column).alias(f"_m_{out}"))
    # a plain min or max keeps the aggregation on hashing; min_by of text has to sort
    for out, column in previous.items():
        last = F.max(order) if column == order else F.max_by(column, order)
        per_bucket.append(last.alias(f"_p_{out}"))
    for out, column in following.items():
        first = F.min(order) if column == order else F.min_by(column, order)
        per_bucket.append(first.alias(f"_f_{out}"))
    summary = cut.groupBy(*group).agg(*per_bucket)

    # at most one row per bucket in each window below
    across = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = across.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_c_n")]
    for out in sums:
        carry.append(F.sum(f"_s_{out}").over(earlier).alias(f"_c_{out}"))
    for out in totals:
        carry.append(F.sum(f"_s_{out}").over(across).alias(f"_t_{out}"))
    for out in max_before:
        carry.append(F.max(f"_m_{out}").over(earlier).alias(f"_b_{out}"))
    for out in previous:
        carry.append(F.lag(f"_p_{out}").over(across.orderBy("_bucket")).alias(f"_l_{out}"))
    for out in following:
        carry.append(F.lead(f"_f_{out}").over(across.orderBy("_bucket")).alias(f"_d_{out}"))
    carried = summary.select(*group, *carry)
    if not keys:
        # one row per bucket, which the estimate doesn't know
        carried = F.broadcast(carried)

    local = W.partitionBy(*group).orderBy(order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    before = local.rowsBetween(W.unboundedPreceding, -1)
    step = [F.col(c) for c in df.columns] + [F.col("_bucket")]
    if index or previous:
        step.append(F.row_number().over(local).alias("_w_index"))
    if following:
        step.append(F.lead(F.lit(True)).over(local).alias("_w_more"))
    for out, column in sums.items():
        step.append(F.sum(column).over(upto).alias(f"_w_{out}"))
    for out, column in max_before.items():
        step.append(F.max(column).over(before).alias(f"_w_{out}"))
    for out, column in previous.items():
        step.append(F.lag(column).over(local).alias(f"_w_{out}"))
    for out, column in following.items():
        step.append(F.lead(column).over(local).alias(f"_w_{out}"))
    scanned = cut.select(*step).join(carried, group)

    final = [F.col(c) for c in df.columns]
    if index:
        final.append((F.col("_c_n") + F.col("_w_index") - 1).cast("long").alias(index))
    for out in sums:
        final.append((F.coalesce(F.col(f"_c_{out}"), F.lit(0)) + F.col(f"_w_{out}")).alias(out))
    for out in totals:
        final.append(F.col(f"_t_{out}").alias(out))
    for out in max_before:
        final.append(F.greatest(F.col(f"_b_{out}"), F.col(f"_w_{out}")).alias(out))
    for out in previous:
        at_start = F.col("_w_index") == 1
        final.append(F.when(at_start, F.col(f"_l_{out}")).otherwise(F.col(f"_w_{out}")).alias(out))
    for out in following:
        at_end = F.col("_w_more").isNull()
        final.append(F.when(at_end, F.col(f"_d_{out}")).otherwise(F.col(f"_w_{out}")).alias(out))
    return scanned.select(*final)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, shares: list[float], counted: DataFrame | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per key: columns keys, ``share``, ``quantile``.

    Exact without sorting a key in one task: equal values are counted first, then the
    running count finds the two rows around every rank. ``counted`` may pass in an
    existing scan with columns keys, value, ``n``, ``upto`` and ``total``.
    """
    if counted is None:
        counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
            F.count(F.lit(1)).alias("n")
        )
        counted = ordered_scan(counts, keys, value, sums={"upto": "n"}, totals={"total": "n"})
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    rank = F.col("share") * (F.col("total") - 1)
    wanted = F.filter(
        F.array(*[F.lit(float(s)) for s in shares]),
        lambda s: (F.floor(s * (F.col("total") - 1)) <= last)
        & (F.ceil(s * (F.col("total") - 1)) >= first),
    )
    hits = counted.where(F.col("n") > 0).withColumn("share", F.explode(wanted))
    low = F.when(F.floor(rank).between(first, last), F.col(value))
    high = F.when(F.ceil(rank).between(first, last), F.col(value))
    return (
        hits.groupBy(*keys, "share")
        .agg(F.max(low).alias("_low"), F.max(high).alias("_high"), F.max(rank - F.floor(rank)).alias("_part"))
        .select(
            *keys,
            "share",
            (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"),
        )
    )
