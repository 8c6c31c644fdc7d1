"""Drop lines that many documents share.

Native: lines are normalised and hashed by expressions, documents per hash are counted
with map-side sums, and what is dropped goes back to its document as positions. Only
hashes are shuffled for the counts and joins; texts move once, for the reassembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import SPACE, ascii_lower, masked, unmasked
from assaykit.session import checkpointed

#: A key in more than this share of all (document, key) pairs is joined by broadcast;
#: there are at most 1 / HOT_SHARE such keys, whatever the size of the input.
HOT_SHARE = 1 / 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    """Hash of every line's key, null where the key is too short to count."""

    def key(line: Column) -> Column:
        stripped = ascii_lower(F.btrim(line, F.lit(SPACE)))
        return F.when(F.char_length(stripped) >= min_chars, F.xxhash64(stripped))

    return F.transform(lines_of(text), key)


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents with ``kept`` (text without common lines), ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys
    of at least ``min_chars`` code points found in at least ``min_docs`` rows lose all
    their lines everywhere. Every row counts as a document, repeated rows and null ids
    too; a null or empty text is one empty line. Other columns pass through untouched.
    Keys are compared as 64-bit hashes. Input columns named like a result
    give way to it.
    """
    rows, name = masked(docs)
    text = F.col(name[text_col])
    own = [F.xxhash64(F.lit(n), name[id_col], text).alias(f"_k{n}") for n in (1, 2)]
    # the hashes alone, stored once: counts and places are both read from them
    keyed = checkpointed(rows.select(*own, line_keys(text, min_chars).alias("_keys")))
    per_doc = keyed.select(F.explode(F.array_distinct("_keys")).alias("_key")).where("_key IS NOT NULL")
    counts = checkpointed(per_doc.groupBy("_key").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= min_docs))
    shared = counts.agg(F.sum("_docs")).first()[0] or 0
    is_hot = F.col("_docs") > shared * HOT_SHARE
    hot = counts.where(is_hot).select("_key")
    cold = counts.where(~is_hot).select("_key")
    places = keyed.select("_k1", "_k2", F.posexplode("_keys").alias("_at", "_key")).where("_key IS NOT NULL")
    marked = places.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_key", "left")
    dropped = marked.where("_hot").drop("_hot").unionByName(
        marked.where("_hot IS NULL").drop("_hot").join(cold, "_key", "left_semi")
    )
    per_row = dropped.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("_at")).alias("_gone"))
    joined = rows.select("*", *own).join(per_row, ["_k1", "_k2"], "left")
    lines, gone = lines_of(text), F.coalesce("_gone", F.array().cast("array<int>"))
    return unmasked(
        joined,
        docs,
        {
            "kept": F.array_join(_without(lines, gone), "\n"),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.size(gone).cast("long"),
        },
    )


def _without(lines: Column, gone: Column) -> Column:
    """Lines outside the sorted positions ``gone``, as the slices between them."""

    def between(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
        return F.slice(lines, start + 1, end - start)

    pieces = F.transform(F.sequence(F.lit(0), F.size(gone)), between)
    return F.when(F.size(gone) == 0, lines).otherwise(F.flatten(pieces))
