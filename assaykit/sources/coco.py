"""COCO annotation files to sample and annotation tables.

A COCO file is one JSON document. ``read_files`` takes each as one task's work, right for many
files of moderate size; ``read_ranges`` cuts files into byte ranges, so that one large document is
read by many tasks. Rows of separate images/annotations/categories tables go to
``samples_from_tables`` directly. Annotations stay one row each: an image with a huge number of them is never
gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from assaykit.functions.paths import basename, file_path, parent, stem
from assaykit.operators.skew import chunked_lists, lookup_join
from assaykit.schemas import COCO_FILE
from assaykit.session import checkpointed
from assaykit.sources.json_ranges import array_objects


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """COCO documents under ``path``, one row per file, other JSON left out."""
    raw = (
        spark.read.schema(COCO_FILE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    located = raw.withColumn("json_path", file_path())
    return located.where("images IS NOT NULL AND annotations IS NOT NULL").withColumn(
        "dataset_id", parent(F.col("json_path"))
    )


def _keys(*tables: DataFrame) -> list[str]:
    """What ids are unique within: a file where it is known, else the dataset."""
    return [k for k in ("dataset_id", "json_path") if all(k in t.columns for t in tables)]


def images(files: DataFrame) -> DataFrame:
    """One row per image entry, with its position in the file."""
    rows = files.select("dataset_id", "json_path", F.posexplode("images").alias("ordinal", "i"))
    return rows.select("dataset_id", "json_path", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("i.id").alias("image_id"), "i.*").drop("id")


def annotations(files: DataFrame) -> DataFrame:
    rows = files.select("dataset_id", "json_path", F.explode("annotations").alias("a"))
    return rows.select("dataset_id", "json_path", F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", "a.bbox", "a.area")


def categories(files: DataFrame) -> DataFrame:
    rows = files.select("dataset_id", "json_path", F.explode("categories").alias("c"))
    return rows.select(
        "dataset_id", "json_path", F.col("c.id").alias("category_id"), F.coalesce("c.name", F.col("c.id").cast("string")).alias("class_name")
    )


def named_annotations(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their class name; an unknown category is ``unknown``."""
    joined = lookup_join(annotations, categories, [*_keys(annotations, categories), "category_id"])
    return joined.withColumn("class_name", F.coalesce(F.col("class_name"), F.lit("unknown")))


def samples_from_tables(images: DataFrame, named: DataFrame, strict: bool = False) -> DataFrame:
    """One row per image with its sorted label set and annotation count.

    Labels are collected as a set, so a hot image is reduced map-side to its classes.
    ``strict`` ignores ``source_id`` when looking for the source.
    """
    keys = [*_keys(images, named), "image_id"]
    per_image = named.groupBy(*keys).agg(
        F.array_sort(F.collect_set("class_name")).alias("labels"), F.count(F.lit(1)).alias("annotation_count")
    )
    origins = ["source", "contributor_id"] if strict else ["source", "source_id", "contributor_id"]
    source = F.coalesce(*[F.col(k) for k in origins], F.lit("source_coco"))
    name = F.coalesce(F.col("file_name"), F.lit(""))
    return images.join(per_image, keys, "left").select(
        *_keys(images, named),
        "ordinal",
        "image_id",
        F.when(name == "", F.col("image_id").cast("string")).otherwise(stem(name)).alias("sample_id"),
        "file_name",
        source.alias("source_id"),
        F.coalesce("batch_id", F.lit("batch_0")).alias("batch_id"),
        F.coalesce("contributor", F.lit("unknown")).alias("contributor"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("annotation_count", F.lit(0)).alias("annotation_count"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
    )


def nested_annotations(named: DataFrame, size: int = 10_000) -> DataFrame:
    """Annotations per image as arrays of at most about ``size`` entries each."""
    cell = F.struct("annotation_id", "class_name", "category_id", "bbox", "area")
    keys = [*_keys(named), "image_id"]
    rows = named.select(*keys, cell.alias("annotation"), "annotation_id")
    return chunked_lists(rows, keys, "annotation", "annotations", size, tie="annotation_id")


def resolve_paths(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``image_path``: the file of a sample, found in its dataset folder.

    files: dataset_id, path. A file at ``images/<name>`` beats ``<name>`` beats a match
    deeper down; among equals the first in path order. Samples without a file are dropped.
    """
    listed = files.select("dataset_id", "path", basename(F.col("path")).alias("_base"))
    wanted = samples.withColumn("_base", basename(F.col("file_name")))
    keys = [*_keys(samples), "image_id"]
    found = wanted.select(*keys, "file_name", "_base").join(listed, ["dataset_id", "_base"])
    inside = F.expr("substring(path, length(dataset_id) + 2)")
    rank = F.when(inside == F.concat(F.lit("images/"), F.col("file_name")), 0).when(
        inside == F.col("file_name"), 1
    ).when(inside.endswith(F.concat(F.lit("/"), F.col("file_name"))), 2)
    best = (
        found.withColumn("_rank", rank)
        .where("_rank IS NOT NULL")
        .groupBy(*keys)
        .agg(F.min_by("path", F.struct("_rank", "path")).alias("image_path"))
    )
    return samples.join(best, keys)


def dataset_totals(samples: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Images, annotations and distinct classes per dataset."""
    n_images = samples.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_images"))
    n_boxes = annotations.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_annotations"))
    n_classes = categories.groupBy("dataset_id").agg(F.count_distinct("class_name").alias("categories_count"))
    return n_images.join(n_boxes, "dataset_id", "left").join(n_classes, "dataset_id", "left").fillna(0)


def read_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO files of any size, as the functions of those
    names give them for ``read_files``. Files that are cut off give nothing."""
    objects = checkpointed(array_objects(spark, path)).withColumn("dataset_id", parent(F.col("json_path")))
    kinds = {f.name: f.dataType.elementType for f in StructType.fromDDL(COCO_FILE) if isinstance(f.dataType, ArrayType)}

    def rows(name: str) -> DataFrame:
        parsed = objects.where(F.col("array_name") == name).select("dataset_id", "json_path", "ordinal", F.from_json("object", kinds[name]).alias("e"))
        return parsed.select("dataset_id", "json_path", "ordinal", "e.*")

    shown = rows("images").withColumnRenamed("id", "image_id")
    boxes = rows("annotations").withColumnRenamed("id", "annotation_id").drop("ordinal")
    classes = rows("categories").select(
        "dataset_id", "json_path", F.col("id").alias("category_id"), F.coalesce("name", F.col("id").cast("string")).alias("class_name")
    )
    return shown, boxes, classes


def read(spark: SparkSession, path: str, strict: bool = False, ranges: bool = False) -> tuple[DataFrame, DataFrame]:
    """Samples and annotations of every COCO file under ``path``; ``ranges`` for large files."""
    if ranges:
        shown, boxes, classes = read_ranges(spark, path)
        named = named_annotations(boxes, classes)
        return samples_from_tables(shown, named, strict), named
    files = read_files(spark, path)
    named = named_annotations(annotations(files), categories(files))
    return samples_from_tables(images(files), named, strict), named
