"""Mix sources to target weights by capped water-filling.

Native: sizes and targets are expressions and sums over the sources; which documents get
one more repetition is read off a running sum in seeded hash order, kept per hash prefix
so that a hot source is never sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import masked, source_key, unmasked, word_count
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
#: Rows wanted per hash prefix: only the one prefix in which a source's target ends is sorted.
PREFIX_ROWS = 10_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: ``_key``, ``_total``, ``_target`` (words), from rows (_source, _key, _size).

    Sources in code point order, null last, take the weights in turn. Shares of all words
    are clamped at ``max_epochs`` times the source's words and what is over is shared by
    weight among the rest until none is above: in order of words per weight a prefix of the
    sources ends up clamped, and the level of the rest follows from sums over the prefix.
    The windows run over one row per source.
    """
    totals = sized.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    turn = (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long")
    weighed = totals.withColumn("_weight", weight).withColumn("_cap", F.col("_total") * max_epochs)
    level = F.col("_cap") / F.col("_weight")
    before = Window.orderBy(level, "_key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(level, "_key").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    filled = (
        weighed.withColumn("_all", F.sum("_total").over(whole))
        .withColumn("_clamped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_open", F.sum("_weight").over(onward))
        .withColumn("_level", (F.col("_all") - F.col("_clamped")) / F.col("_open"))
        .withColumn("_free", F.when(F.col("_level") <= level, F.col("_level")))
        .withColumn("_level", F.max(F.struct(F.col("_free").isNotNull(), F.col("_clamped") * -1, "_free")).over(whole)["_free"])
    )
    return filled.select(
        "_key", "_total", "_rows",
        F.least(F.col("_level") * F.col("_weight"), F.col("_cap").cast("double")).alias("_target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    Every document gets the whole repetitions its source can have; the remaining words
    are taken from documents in seeded hash order, the last one in part, so a source's
    taken words equal its target to the word. ``copies`` rounds the part to whole texts.
    The order hashes seed, id and text, so reruns agree; equal rows follow each other.
    Null texts have size 0, null sources are one source of their own, null ids are hashed
    as empty. No row is dropped; extra columns pass through, those named like a result give
    way to it.
    """
    renamed, name = masked(docs)
    id_col, text_col, source_col = name[id_col], name[text_col], name[source_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    tag = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))
    row = renamed.select(
        "*",
        F.col(source_col).alias("_source"),
        source_key(F.col(source_col)).alias("_key"),
        word_count(F.col(text_col)).alias("_size"),
        F.substring(F.md5(tag), 1, 16).alias("_hash"),
    )
    sized = checkpointed(row.select("_source", "_key", "_size", "_hash"))
    targets = checkpointed(source_targets(sized, weights, max_epochs))
    largest = targets.agg(F.max("_rows")).first()[0] or 1
    digits = max(0, math.ceil(math.log(max(1, largest / PREFIX_ROWS), 16)))
    prefix = F.substring("_hash", 1, digits)
    sums = sized.groupBy("_key", prefix.alias("_prefix")).agg(F.sum("_size").alias("_sum"))
    running = Window.partitionBy("_key").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        .join(_parts(targets), "_key")
        .where(F.col("_before") < F.col("_rest"))
        .groupBy("_key")
        .agg(F.max(F.struct("_prefix", "_before")).alias("_edge"))
    )
    # sources with nothing left over have no edge: an empty prefix sorts before all, so none is taken
    per_source = checkpointed(_parts(targets).join(edges, "_key", "left"))
    joined = lookup_join(row.withColumn("_prefix", prefix), per_source, ["_key"])
    at_edge = F.col("_prefix") == F.col("_edge._prefix")
    within = Window.partitionBy("_key", "_prefix", "_is_edge").orderBy("_hash", "_size", F.xxhash64(id_col, text_col)).rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.where(at_edge).withColumn("_is_edge", F.lit(True))
    ran = inside.withColumn("_ran", F.col("_edge._before") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_ran")))
    outside = joined.where(~F.coalesce(at_edge, F.lit(False)))
    more = F.when(F.col("_prefix") < F.col("_edge._prefix"), F.col("_size")).otherwise(0)
    columns = [*renamed.columns, "_size", "_total", "_target", "_whole"]
    both = ran.select(*columns, part.cast("long").alias("_part")).unionByName(
        outside.select(*columns, more.cast("long").alias("_part"))
    )
    rounded = F.when((F.col("_part") > 0) & (F.col("_part") * 2 >= F.col("_size")), 1).otherwise(0)
    return unmasked(
        both,
        docs,
        {
            "size": F.col("_size"),
            "source_size": F.col("_total"),
            "target": F.col("_target"),
            "taken": F.col("_whole") * F.col("_size") + F.col("_part"),
            "copies": F.col("_whole") + rounded,
        },
    )


def _parts(targets: DataFrame) -> DataFrame:
    """Whole repetitions and words left over per source."""
    whole = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0).cast("long")
    rest = F.floor(F.col("_target") + 0.5) - whole * F.col("_total")
    return targets.withColumn("_whole", whole).withColumn("_rest", F.greatest(F.lit(0), rest).cast("long"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus itself: every document as often as its ``copies`` say."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where("copies > 0").select(*columns, times.alias("_copy")).select(*columns)
