"""Registry of driver queries: a Spark plan and, where SQL can say it, an equivalent text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Tables:
    """Parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def rounded(expression: str, digits: int) -> str:
    """SQL rounding half-up on the decimal text of a double, as Spark's round does."""
    return (
        f"CAST(ROUND(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"
    )


def case_map(expression: str, table: dict, default) -> str:
    """SQL CASE with one branch per dictionary entry."""
    branches = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {expression} {branches} ELSE {default} END"
