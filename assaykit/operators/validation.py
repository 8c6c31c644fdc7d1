"""Checks of image files and annotation boxes. Issues are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK_LOW = -5
SLACK_HIGH = 10


def box_issue(box: Column, width: Column, height: Column) -> Column:
    """INVALID_BBOX_SIZE, OUT_OF_BOUNDS_BBOX or null for one [x, y, w, h] box.

    Boxes without exactly four numbers are not judged.
    """
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    outside = (
        (x < SLACK_LOW) | (y < SLACK_LOW) | (x + w > width + SLACK_HIGH) | (y + h > height + SLACK_HIGH)
    )
    return F.when(F.size(box) != 4, F.lit(None)).when((w <= 0) | (h <= 0), "INVALID_BBOX_SIZE").when(
        outside, "OUT_OF_BOUNDS_BBOX"
    )


def box_issues(annotations: DataFrame) -> DataFrame:
    """Issue rows of annotations (sample_id, bbox, width, height); the sample stays valid."""
    found = annotations.withColumn("issue_type", box_issue(F.col("bbox"), F.col("width"), F.col("height")))
    text = F.concat(F.lit("["), F.concat_ws(", ", F.transform("bbox", lambda v: v.cast("string"))), F.lit("]"))
    invalid = F.col("issue_type") == "INVALID_BBOX_SIZE"
    details = F.when(invalid, F.concat(F.lit("Non-positive bbox dimensions: "), text)).otherwise(
        F.concat(F.lit("Bbox "), text, F.lit(" exceeds image bounds ["), F.col("width").cast("string"), F.lit(", "),
                 F.col("height").cast("string"), F.lit("]"))
    )
    return found.where(F.col("issue_type").isNotNull()).select(
        "sample_id", F.when(invalid, "MEDIUM").otherwise("LOW").alias("severity"), "issue_type", details.alias("details")
    )


def check_files(samples: DataFrame, images: DataFrame) -> DataFrame:
    """Samples joined to decoded images, with ``file_issue`` (null where the file is fine).

    images: image_path, actual_width, actual_height, with height -1 for a file that could
    not be decoded. The actual size replaces the declared one.
    """
    joined = samples.join(images, "image_path", "left")
    w, h = F.col("actual_width"), F.col("actual_height")
    issue = (
        F.when(h.isNull(), "MISSING_IMAGE_FILE").when(h == -1, "CORRUPTED_IMAGE").when((w <= 0) | (h <= 0), "ZERO_DIMENSION")
    )
    return (
        joined.withColumn("file_issue", issue)
        .withColumn("width", F.when(issue.isNull(), w).otherwise(F.col("width")))
        .withColumn("height", F.when(issue.isNull(), h).otherwise(F.col("height")))
        .drop("actual_width", "actual_height")
    )


def file_issues(checked: DataFrame) -> DataFrame:
    detail = (
        F.when(F.col("file_issue") == "MISSING_IMAGE_FILE", F.concat(F.lit("File does not exist: "), F.col("image_path")))
        .when(F.col("file_issue") == "CORRUPTED_IMAGE", F.concat(F.lit("Failed to load image: "), F.col("image_path")))
        .otherwise(F.lit("Invalid image dimensions"))
    )
    return checked.where("file_issue IS NOT NULL").select(
        "sample_id", F.lit("HIGH").alias("severity"), F.col("file_issue").alias("issue_type"), detail.alias("details")
    )


def valid_samples(checked: DataFrame) -> DataFrame:
    return checked.where("file_issue IS NULL").drop("file_issue")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("issues"))
