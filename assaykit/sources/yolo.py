"""YOLO label folders to sample and annotation tables, for many dataset roots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.columns import corner_box
from assaykit.functions.paths import basename, batch_of, file_path, source_of, stem
from assaykit.operators.skew import lookup_join


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(F.trim("value").alias("line"), file_path().alias("path"))
    )


def _documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("value").alias("text"), file_path().alias("path"))
    )


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of all label files: path, class_id, xc, yc, w, h. Short lines are skipped."""
    parts = F.split("line", r"\s+")
    lines = _lines(spark, path, "*.txt").where(F.lower(basename(F.col("path"))) != "classes.txt")
    return lines.where(F.size(parts) >= 5).select(
        "path",
        F.get(parts, F.lit(0)).try_cast("int").alias("class_id"),
        *[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("xc", "yc", "w", "h"), start=1)],
    )


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^['\"]+|['\"]+$", "")


def names_from_lists(documents: DataFrame) -> DataFrame:
    """(path, class_id, class_name) from classes.txt documents: one name a line."""
    names = F.filter(F.transform(F.split("text", "\r?\n"), lambda s: F.trim(s)), lambda n: n != "")
    return documents.select("path", F.posexplode(names).alias("class_id", "class_name"))


def names_from_yaml(documents: DataFrame) -> DataFrame:
    """(path, class_id, class_name) from data.yaml documents.

    Reads ``names: [a, b]``, a dash list, or ``0: a`` lines; the list ends at the first
    line that is neither. Entries count in the order they appear.
    """
    inline = F.regexp_extract("text", r"(?s)names:\s*\[(.*?)\]", 1)
    inline_names = F.filter(F.transform(F.split(inline, ","), _unquoted), lambda n: n != "")
    block = F.regexp_extract("text", r"(?m)^[^\n]*names:[^\n]*\n((?:[ \t]*-[^\n]*\n?|[^\n#:]*:[^\n]*\n?)*)", 1)
    lines = F.transform(F.split(block, "\n"), lambda s: F.trim(s))
    entries = F.filter(lines, lambda s: s.startswith("-") | s.rlike(r"^\d+\s*:"))
    block_names = F.transform(
        entries,
        lambda s: _unquoted(F.when(s.startswith("-"), F.regexp_replace(s, r"^[-\s]+", "")).otherwise(F.regexp_replace(s, r"^\d+\s*:", ""))),
    )
    names = F.when(F.size(inline_names) > 0, inline_names).otherwise(block_names)
    return documents.select("path", F.posexplode(names).alias("class_id", "class_name"))


def class_names(spark: SparkSession, path: str, roots: DataFrame) -> DataFrame:
    """(dataset_id, class_id, class_name): classes.txt if it names any class, else yaml.

    roots: dataset_id. A file belongs to the root its path starts with.
    """
    found = names_from_lists(_documents(spark, path, "classes.txt")).withColumn("_rank", F.lit(0)).unionByName(
        names_from_yaml(_documents(spark, path, "data.{yaml,yml}")).withColumn("_rank", F.lit(1))
    )
    placed = in_root(found, roots)
    best = placed.groupBy("dataset_id").agg(F.min(F.struct("_rank", "path")).alias("_best"))
    return (
        placed.join(best, "dataset_id")
        .where((F.col("_rank") == F.col("_best._rank")) & (F.col("path") == F.col("_best.path")))
        .select("dataset_id", "class_id", "class_name")
    )


def in_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Add ``dataset_id``: the root folder a path lies in.

    Every ancestor folder of a path becomes a row, so this is an equi-join.
    """
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return lookup_join(files.withColumn("dataset_id", F.explode(above)), roots.select("dataset_id").distinct(), ["dataset_id"], "inner")


def swapped_label_path(path: Column) -> Column:
    """Label path with the first ``images`` folder replaced by ``labels``."""
    at = F.array_position(F.split(path, "/"), "images")
    moved = F.transform(
        F.split(path, "/"), lambda p, i: F.when(i + 1 == at, "labels").otherwise(p)
    )
    return F.when(at > 0, F.regexp_replace(F.array_join(moved, "/"), r"\.[^./]*$", ".txt"))


def label_files(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(image_path, label_path) per image: same folder first, then images -> labels."""
    existing = lines.select(F.col("path").alias("label_path")).distinct()
    beside = F.regexp_replace("image_path", r"\.[^./]*$", ".txt")
    candidates = images.select(
        "image_path", F.posexplode(F.array(beside, swapped_label_path(F.col("image_path")))).alias("_rank", "label_path")
    ).where("label_path IS NOT NULL")
    matched = candidates.join(existing, "label_path")
    return matched.groupBy("image_path").agg(F.min_by("label_path", "_rank").alias("label_path"))


def boxes(images: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """Annotation rows with pixel boxes. images: dataset_id, image_path, width, height.

    A class id without a name, a negative one included, is called ``class_<id>``.
    """
    linked = images.join(label_files(images, lines), "image_path").join(
        lines.withColumnRenamed("path", "label_path"), "label_path"
    )
    named = lookup_join(linked, names, ["dataset_id", "class_id"])
    box = corner_box(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return named.select(
        "dataset_id",
        "image_path",
        stem(F.col("image_path")).alias("sample_id"),
        F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id"))).alias("class_name"),
        F.col("class_id").cast("bigint").alias("category_id"),
        box.alias("bbox"),
        F.array("xc", "yc", "w", "h").alias("normalized"),
        "width",
        "height",
    )


def samples(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per decodable image, with source and batch read from its path."""
    per_image = boxes.groupBy("image_path").agg(
        F.array_sort(F.collect_set("class_name")).alias("labels"), F.count(F.lit(1)).alias("annotation_count")
    )
    path = F.col("image_path")
    return (
        images.where("height > 0")
        .join(per_image, "image_path", "left")
        .select(
            "dataset_id",
            "image_path",
            stem(path).alias("sample_id"),
            source_of(path).alias("source_id"),
            batch_of(path).alias("batch_id"),
            F.lit("anonymous").alias("contributor"),
            F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
            F.coalesce("annotation_count", F.lit(0)).alias("annotation_count"),
            "width",
            "height",
        )
    )


def read(spark: SparkSession, path: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples and annotations of a YOLO tree; images: dataset_id, image_path, width, height."""
    lines = label_lines(spark, path)
    found = boxes(images, lines, class_names(spark, path, images.select("dataset_id")))
    return samples(images, found), found


