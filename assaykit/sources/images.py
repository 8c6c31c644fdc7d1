"""Image folders: one decode on the JVM, one pass for all features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import pixels
from assaykit.functions.paths import IMAGE_EXTENSIONS, uniform
from assaykit.sources.yolo import in_root

FEATURES = (
    "image_path STRING, width INT, height INT, readable BOOLEAN, vector ARRAY<FLOAT>, "
    + ", ".join(f"{m} DOUBLE" for m in pixels.METRICS)
    + ", phash BIGINT, dhash BIGINT, patches ARRAY<STRUCT<region: STRING, vec: ARRAY<FLOAT>>>"
)


def _pattern() -> str:
    return "*.{" + ",".join(e.lstrip(".") for e in IMAGE_EXTENSIONS) + "}"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images under ``path``; a file that cannot be decoded has height -1."""
    raw = (
        spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
        .option("pathGlobFilter", _pattern()).load(path)
    )
    return raw.select(
        uniform(F.col("image.origin")).alias("image_path"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def image_sizes(images: DataFrame) -> DataFrame:
    """Sizes for the file check; no pixel leaves the JVM."""
    return images.select("image_path", F.col("width").alias("actual_width"), F.col("height").alias("actual_height"))


def image_index(spark: SparkSession, path: str, roots: DataFrame) -> DataFrame:
    """(dataset_id, image_path, width, height) of every image inside the given roots."""
    sizes = read_images(spark, path).select(F.col("image_path").alias("path"), "width", "height")
    return in_root(sizes, roots).select("dataset_id", F.col("path").alias("image_path"), "width", "height")


def _measure(path: str, width: int, height: int, channels: int, data: bytes) -> dict:
    row = {"image_path": path, "width": width, "height": height, "readable": False,
           "vector": np.zeros(15, dtype=np.float32), **pixels.FALLBACK_METRICS,
           "phash": None, "dhash": None, "patches": []}
    if height <= 0:
        return row
    try:
        rgb = pixels.decode(data, height, width, channels)
        row |= pixels.image_metrics(rgb)
        row |= {
            "vector": pixels.visual_vector(rgb), "phash": pixels.frequency_hash(rgb), "dhash": pixels.gradient_hash(rgb),
            "patches": [{"region": r, "vec": v} for r, v in pixels.patch_vectors(rgb).items()], "readable": True,
        }
    except ValueError:
        pass
    return row


def image_features(images: DataFrame) -> DataFrame:
    """All features of every image, wide: 15-d vector, eight metrics, two hashes, patches.

    An unreadable image gets a zero vector, default metrics, and no hashes or patches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # images are large: hand results on in small frames
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                rows = [_measure(*r) for r in zip(part["image_path"], part["width"], part["height"], part["channels"], part["data"])]
                out = pd.DataFrame(rows)
                for name in ("phash", "dhash"):
                    out[name] = out[name].astype("Int64")
                yield out

    return images.select("image_path", "width", "height", "channels", "data").mapInPandas(run, FEATURES)


def patch_rows(features: DataFrame, sample: Column) -> DataFrame:
    """Patches in long form: sample_id, region, vec."""
    rows = features.select(sample.alias("sample_id"), F.explode("patches").alias("p"))
    return rows.select("sample_id", "p.region", F.transform("p.vec", lambda v: v.cast("double")).alias("vec"))
