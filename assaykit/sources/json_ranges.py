"""Objects in the top-level arrays of JSON documents that are larger than a task.

Spark's text reader cuts a file into byte ranges at any separator. With ``}`` as the separator
every row is the text up to the next closing brace, whatever the line breaks, so one document
is read by many tasks and through any file system Spark knows. Where a row stands follows from
running sums over the rows of a file: the quotes before it tell whether it begins in a string,
the brackets outside strings tell its depth. Rows at depth two that go on with an object open an
element; the rows after it, until the depth is back at two, belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.paths import file_path
from assaykit.operators.scan import ordered_scan
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

#: Positions per byte of a file: a row is numbered within its task, from where its range begins.
SPREAD = 16
ROW_BITS = (1 << 33) - 1

# a name in front of an array of objects, with nothing but whole strings and signs before it
NAMED = r'(?s)^(?:[^"]++|"(?:[^"\\]++|\\.)*+")*?"((?:[^"\\]++|\\.)*+)"\s*:\s*\[\s*(\{.*)$'


def _count(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("bigint")


def _pieces(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Texts between closing braces: json_path, pos (rising within a file), text, size."""
    raw = (
        spark.read.option("lineSep", "}").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    begin = F.col("_metadata.file_block_start")
    return raw.select(
        file_path().alias("json_path"), (begin * SPREAD + row).alias("pos"), F.col("value").alias("text"),
        F.col("_metadata.file_size").alias("size"),
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces of whole documents with ``quoted`` (begins in a string), ``bare`` (what is outside
    strings), ``depth`` before and ``after``."""
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    counted = checkpointed(pieces.withColumn("_quotes", _count(plain, '"')))
    scanned = ordered_scan(counted, ["json_path"], "pos", sums={"_upto": "_quotes"})
    quoted = (F.col("_upto") - F.col("_quotes")) % 2 == 1
    opened = F.when(quoted, F.concat(F.lit('"'), plain)).otherwise(plain)
    bare = F.regexp_replace(opened, r'"[^"]*("|$)', '""')
    closes = F.when(F.col("_upto") % 2 == 0, 1).otherwise(0)
    strings = scanned.select("json_path", "pos", "text", "size", quoted.alias("quoted"), bare.alias("bare"), closes.alias("_closes"))
    change = _count(F.col("bare"), "{") + _count(F.col("bare"), "[") - _count(F.col("bare"), "]") - F.col("_closes")
    changed = checkpointed(strings.withColumn("_change", change))
    depths = ordered_scan(changed, ["json_path"], "pos", sums={"after": "_change"}).withColumn("depth", F.col("after") - F.col("_change"))
    # the reader ends the last piece of a file that does not end in a brace too
    length = F.sum(F.octet_length("text") + 1)
    whole = (
        changed.groupBy("json_path")
        .agg(F.sum("_change").alias("_end"), (length > F.max("size")).cast("int").alias("_added"))
        .where("_end + _added = 0").select("json_path")
    )
    return lookup_join(depths, whole, ["json_path"], "inner").drop("_change", "_closes", "size")


def array_objects(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Objects of all top-level arrays: json_path, array_name, ordinal, object (its JSON text).

    ``ordinal`` counts the objects of an array from 0. Documents that end before their last
    bracket closes give nothing; entries that are no objects are left out. Files must be plain
    UTF-8, as compressed ones can't be cut.
    """
    placed = _placed(_pieces(spark, path, pattern))
    text = F.when(F.col("quoted"), F.concat(F.lit('"'), F.col("text"))).otherwise(F.col("text"))
    bare = F.col("bare")
    lead = F.regexp_extract(bare, r"(?s)^(.*?)\[\s*\{", 1)
    level = F.col("depth") + _count(lead, "{") + _count(lead, "[") - _count(lead, "]")
    named = bare.rlike(r"\[\s*\{") & (F.col("depth") <= 2) & (level == 1)
    further = (F.col("depth") == 2) & bare.rlike(r"^\s*,\s*\{")
    marked = placed.withColumns({"_named": named, "_opens": named | further}).withColumns({
        "_name": F.when(F.col("_named"), F.regexp_extract(text, NAMED, 1)),
        "text": F.when(F.col("_named"), F.regexp_extract(text, NAMED, 2))
        .when(F.col("_opens"), F.regexp_replace("text", r"^\s*,\s*", "")).otherwise(F.col("text")),
        "_open_pos": F.when(F.col("_opens"), F.col("pos")),
        "_break_pos": F.when(~F.col("_opens") & (F.col("depth") <= 2), F.col("pos")),
        "_named_pos": F.when(F.col("_named"), F.col("pos")),
        "_one": F.col("_opens").cast("bigint"),
    })
    marked = checkpointed(marked.drop("bare", "quoted"))
    scanned = ordered_scan(
        marked, ["json_path"], "pos", sums={"_opened": "_one"},
        max_before={"_open_at": "_open_pos", "_break_at": "_break_pos", "_named_at": "_named_pos"},
    )
    inside = F.col("_opens") | ((F.col("depth") >= 3) & (F.col("_open_at") > F.coalesce("_break_at", F.lit(-1))))
    kept = checkpointed(scanned.where(inside).select(
        "json_path", "pos", "text", "after", "_opens", "_name", "_opened",
        F.coalesce("_open_pos", "_open_at").alias("_element"), F.coalesce("_named_pos", "_named_at").alias("_array"),
    ))
    keys = ["json_path", "_element"]
    alone = F.col("_opens") & (F.col("after") == 2)
    single = kept.where(alone).select(*keys, "_array", "_opened", F.concat("text", F.lit("}")).alias("object"))
    cell = F.array_sort(F.collect_list(F.struct("pos", "text")))
    joined = kept.where(~alone).groupBy(*keys).agg(
        F.min("_array").alias("_array"), F.min("_opened").alias("_opened"),
        F.concat(F.array_join(cell["text"], "}"), F.lit("}")).alias("object"),
    )
    # one row per array of a document
    arrays = kept.where("_name IS NOT NULL").select("json_path", F.col("pos").alias("_array"), F.col("_name").alias("array_name"), F.col("_opened").alias("_first"))
    found = lookup_join(single.unionByName(joined), arrays, ["json_path", "_array"], "inner")
    return found.select("json_path", "array_name", (F.col("_opened") - F.col("_first")).alias("ordinal"), "object")
