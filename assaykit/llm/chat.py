"""Collapse cumulative snapshots of conversations and render what remains.

Logs often hold a conversation again and again, each time with a few more turns. A rolling
hash over the turns names every prefix; a conversation whose own hash is a proper prefix
of a longer one is dropped by an anti-join, and of equal ones the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import checkpointed

#: Turns per slice of a conversation: running sums and texts never span more in one group.
SLICE = 1_000


def prefixes(turns: DataFrame, slice_turns: int = SLICE) -> DataFrame:
    """Turns (_conv, _slice, _at, role, text, _h1, _h2): place from 1 and the rolling hash there.

    The hash of a prefix is the wrapping sum of hashes of (place, role, text), twice, so it
    can be added up per slice of a conversation and no conversation needs one task.
    """
    base = turns.select(
        F.col("conv_id").alias("_conv"),
        F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("_slice", F.floor(F.col("_turn") / slice_turns))
    counts = base.groupBy("_conv", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_conv").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(counts.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n"))
    within = Window.partitionBy("_conv", "_slice").orderBy("_turn", "role", "text")
    placed = base.join(
        starts.withColumnsRenamed({"_conv": "_c", "_slice": "_s"}),
        F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_slice") == F.col("_s")),
    ).drop("_c", "_s").withColumn("_at", F.col("_start") + F.row_number().over(within)).drop("_start")
    for n in (1, 2):
        placed = placed.withColumn(f"_t{n}", F.xxhash64(F.lit(n), "_at", "role", "text"))
    # sums wrap: 31-bit halves keep ANSI arithmetic from overflowing within 2^31 turns
    for n in (1, 2):
        low, high = F.col(f"_t{n}").bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(f"_t{n}", 33)
        placed = placed.withColumn(f"_l{n}", low).withColumn(f"_u{n}", high).drop(f"_t{n}")
    parts = [f"_{k}{n}" for n in (1, 2) for k in "lu"]
    sums = placed.groupBy("_conv", "_slice").agg(*[F.sum(p).alias(f"{p}s") for p in parts])
    for p in parts:
        sums = sums.withColumn(f"{p}s", F.coalesce(F.sum(f"{p}s").over(ahead), F.lit(0)))
    sums = checkpointed(sums.withColumnsRenamed({"_conv": "_c", "_slice": "_s"}))
    joined = placed.join(sums, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_slice") == F.col("_s")))
    run = within.rowsBetween(Window.unboundedPreceding, 0)
    ran = joined.select(
        "_conv", "_slice", "_at", "_turn", "role", "text",
        *[(F.col(f"{p}s") + F.sum(p).over(run)).alias(p) for p in parts],
    )
    return ran.select(
        "_conv", "_slice", "_at", "role", "text",
        F.xxhash64("_at", "_l1", "_u1").alias("_h1"), F.xxhash64("_at", "_l2", "_u2").alias("_h2"),
    )


def collapse(turns: DataFrame, slice_turns: int = SLICE) -> DataFrame:
    """Turns of the conversations that no longer one begins with: columns as ``prefixes``.

    A conversation is its rows ordered by turn, then role and text where turns tie or are
    null. Null roles and texts count as empty. Rows with a null conv_id are one
    conversation. Of conversations with the same turns the smallest conv_id stays, null last.
    """
    rows = checkpointed(prefixes(turns, slice_turns))
    ends = rows.groupBy("_conv").agg(F.max(F.struct("_at", "_h1", "_h2")).alias("_e")).select("_conv", "_e.*")
    # a prefix shared by a third of all conversations is one row here, after map-side combine
    lengths = rows.join(
        ends.select(F.col("_conv").alias("_c"), F.col("_at").alias("_length")), F.col("_conv").eqNullSafe(F.col("_c"))
    )
    longer = lengths.where("_at < _length").groupBy("_h1", "_h2").agg(F.max("_length").alias("_longest")).drop("_longest")
    maximal = ends.join(longer, ["_h1", "_h2"], "left_anti")
    firsts = maximal.groupBy("_h1", "_h2").agg(F.min("_conv").alias("_c"))
    keep = checkpointed(firsts.select("_c"))
    return rows.join(keep, F.col("_conv").eqNullSafe(F.col("_c")), "left_semi")


def render(kept: DataFrame) -> DataFrame:
    """Conversations as text: conv_id, part, n_turns, text.

    Turns are written as ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a
    line break. A conversation of over SLICE turn numbers comes in parts, in order.
    """
    turn = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    grouped = kept.groupBy("_conv", "_slice").agg(F.sort_array(F.collect_list(F.struct("_at", turn.alias("_line")))).alias("_lines"))
    return grouped.select(
        F.col("_conv").alias("conv_id"),
        F.col("_slice").cast("long").alias("part"),
        F.size("_lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("_lines", lambda x: x["_line"]), "").alias("text"),
    )
