"""Stored tables: partitioned writes, replace-all per key, append logs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.operators.findings import latest_version
from assaykit.operators.report import csv_rows


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("append").partitionBy("dataset_id").parquet(path)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of the keys present in ``rows``."""
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    )


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def register(spark: SparkSession, path: str, view: str) -> DataFrame:
    """Expose a stored table as a view."""
    table = spark.read.parquet(path)
    table.createOrReplaceTempView(view)
    return table


def current_rows(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """Newest version of each row of an append-only table."""
    return latest_version(spark.read.parquet(path), keys, version)


def write_report(header: DataFrame, findings: DataFrame, path: str) -> None:
    """JSON report: the header document and the findings as JSON lines beside it."""
    header.write.mode("overwrite").json(f"{path}/report")
    findings.write.mode("overwrite").json(f"{path}/findings")


def write_findings_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
