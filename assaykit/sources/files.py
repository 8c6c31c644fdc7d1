"""File listings: format detection, archives, file digests."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.hashing import sha256
from assaykit.functions.paths import basename, escapes_root, parent, uniform

HEAD_BYTES = 512


def _contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.withColumn("path", uniform(F.col("path")))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes of all files under ``path``; contents are not read."""
    return _contents(spark, path, pattern).select("path", "length", "modificationTime")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file (up to 2 GB each)."""
    return _contents(spark, path, pattern).select("path", "length", sha256(F.col("content")).alias("sha256"))


def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """COCO, YOLO or GENERIC_IMAGES for each first-level folder under ``path``.

    A JSON file whose first 512 bytes name both images and annotations means COCO; a yaml
    or classes.txt file, or images and labels folders together, mean YOLO.
    """
    names = listing(spark, path).select("path")
    heads = _contents(spark, path, "*.json").select(
        "path", F.substring("content", 1, HEAD_BYTES).cast("string").alias("head")
    )
    base = path.rstrip("/").removeprefix("file:")

    def rooted(df: DataFrame) -> DataFrame:
        tail = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), base + "/", -1)
        return df.withColumn("dataset", F.split(tail, "/")[0]).withColumn("inside", F.concat(F.lit("/"), tail))

    marks = rooted(names).select(
        "dataset",
        basename(F.col("path")).isin("data.yaml", "data.yml", "classes.txt").alias("yolo_file"),
        parent(F.col("inside")).contains("/labels").alias("has_labels"),
        parent(F.col("inside")).contains("/images").alias("has_images"),
        F.lit(False).alias("coco"),
    )
    both = F.col("head").contains('"images"') & F.col("head").contains('"annotations"')
    no = F.lit(False)
    coco = rooted(heads).select("dataset", no.alias("yolo_file"), no.alias("has_labels"), no.alias("has_images"), both.alias("coco"))
    flags = marks.unionByName(coco).groupBy("dataset").agg(
        *[F.bool_or(c).alias(c) for c in ("yolo_file", "has_labels", "has_images", "coco")]
    )
    return flags.select(
        "dataset",
        F.when(F.col("coco"), "COCO")
        .when(F.col("yolo_file") | (F.col("has_labels") & F.col("has_images")), "YOLO")
        .otherwise("GENERIC_IMAGES")
        .alias("format"),
    )


def _members(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, archive.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
            for info in archive:
                if info.isfile():
                    yield info.name, archive.extractfile(info).read()


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of zip and tar archives: archive, member, content, is_unsafe.

    One row per member, a few at a time. Members whose path climbs out of the archive are
    flagged. An archive that can't be read to its end gives what it gave so far and one row
    with ``error``. ``safe_archives`` drops both kinds as a whole.
    """
    files = _contents(spark, path, "*.{zip,tar,gz}").select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(name, member=None, data=None, error=None):
            return pd.DataFrame({"archive": [name], "member": [member], "content": [data], "error": [error]})

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    for member, data in _members(name, content):
                        yield row(name, member, data)
                except (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError) as ex:
                    yield row(name, error=f"{type(ex).__name__}: {ex}")

    rows = files.mapInPandas(run, "archive STRING, member STRING, content BINARY, error STRING")
    return rows.withColumn("is_unsafe", F.coalesce(escapes_root(F.col("member")), F.lit(False)))


def safe_archives(members: DataFrame) -> DataFrame:
    """Members of the archives that could be read and hold no unsafe member."""
    bad = members.where("is_unsafe OR error IS NOT NULL").select("archive").distinct()
    return members.join(bad, "archive", "left_anti")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, sample_id) from JSON documents holding lists of ids per scenario."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "array<string>"]
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(n).alias("ids")) for n in lists])
    return raw.select(F.explode(cells).alias("c")).select("c.scenario", F.explode("c.ids").alias("sample_id"))
