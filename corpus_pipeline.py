"""A corpus from raw documents to packed sequences, as stages that are each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import linededup, mixing, packing, quality_trees, simhash
from assaykit.llm.common import masked
from assaykit.session import checkpointed


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels beside them, does not reject."""
    rows, name = masked(docs)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    sample = docs.select("doc_id", "text")
    forest = quality_trees.fit(sample, labels)
    scored = rows.withColumn("_score", quality_trees.score(F.col(name["text"]), forest))
    return _like(docs, scored.where(F.col("_score") >= quality_trees.THRESHOLD), {})


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; no document goes."""
    rows, name = masked(docs)
    kept = linededup.dedup_lines(rows, id_col=name["doc_id"], text_col=name["text"])
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col(name["text"]))
    return _like(docs, kept, {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    rows, name = masked(docs)
    found = simhash.near_duplicates(rows, id_col=name["doc_id"], text_col=name["text"])
    return _like(docs, found.where("is_first"), {})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says; part repetitions are rounded."""
    rows, name = masked(docs)
    mixed = mixing.mix(rows, id_col=name["doc_id"], text_col=name["text"], source_col=name["source"])
    return _like(docs, mixing.repeated(mixed, rows.columns), {})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their place in the packed sequences."""
    return packing.pack(packing.pieces(docs))


def _like(docs: DataFrame, rows: DataFrame, changed: dict) -> DataFrame:
    """Masked rows under the names of ``docs``, some columns replaced."""
    return rows.select(*[changed.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and the packing search can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    *early, (_, last) = STAGES
    for _, stage in early:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
