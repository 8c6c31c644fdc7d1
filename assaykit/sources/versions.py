"""Tables whose rows are replaced per key, and which a crash never leaves half replaced.

A change writes its rows and the keys it replaces into folders of its own version; an empty
marker file, created last and at once, makes the version count. Readers take marked versions
only, so they see all of a change or nothing of it, and what a crash leaves behind is
overwritten when the change is made again. One writer at a time; any number of readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE, BASE = "change", "base"


def _folder(spark: SparkSession, path: str):
    """The marker folder of a table and its file system."""
    context = spark.sparkContext
    marks = context._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    return marks, marks.getFileSystem(context._jsc.hadoopConfiguration())


def _mark(spark: SparkSession, path: str, kind: str, version: int) -> None:
    marks, files = _folder(spark, path)
    files.mkdirs(marks)
    files.createNewFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks, f"{kind}-{version}"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that count, oldest first: the newest compacted one and the changes after it."""
    marks, files = _folder(spark, path)
    if not files.exists(marks):
        return []
    names = [s.getPath().getName().rsplit("-", 1) for s in files.listStatus(marks)]
    numbers = {kind: [int(n) for k, n in names if k == kind] for kind in (CHANGE, BASE)}
    base = max(numbers[BASE], default=-1)
    return sorted({n for n in numbers[CHANGE] if n > base} | {n for n in numbers[BASE] if n == base})


def _write(rows: DataFrame, key: str, path: str, kind: str, version: int, keys: DataFrame | None = None) -> None:
    spark, folder = rows.sparkSession, f"{path}/rows/_version={version}"
    rows.write.mode("overwrite").parquet(folder)
    # from what was written, so that rows computed twice can't differ from their keys
    replaced = spark.read.schema(rows.schema).parquet(folder).select(key)
    if keys is not None:
        replaced = replaced.unionByName(keys.select(key))
    replaced.distinct().write.mode("overwrite").parquet(f"{path}/keys/_version={version}")
    _mark(spark, path, kind, version)


def replace(rows: DataFrame, path: str, key: str, version: int | None = None, keys: DataFrame | None = None) -> int:
    """Make ``rows`` the only rows of their keys, and give the version they are.

    ``keys`` (one column ``key``) names keys to replace besides, so that a key without rows is
    deleted. The number of a micro-batch as ``version`` makes a repeated one change nothing;
    without it the next free number is taken. Null is a key like any other.
    """
    spark = rows.sparkSession
    known = versions(spark, path)
    if version is None:
        version = known[-1] + 1 if known else 0
    elif known and version <= known[-1]:
        return version
    _write(rows, key, path, CHANGE, version, keys)
    return version


def _read(spark: SparkSession, path: str, part: str, known: list[int]) -> DataFrame:
    folders = [f"{path}/{part}/_version={v}" for v in known]
    return spark.read.option("basePath", f"{path}/{part}").option("mergeSchema", True).parquet(*folders)


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of every key as its last replacement left them."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of {path} has been finished")
    rows = _read(spark, path, "rows", known)
    if len(known) == 1:
        return rows.drop("_version")
    last = _read(spark, path, "keys", known).groupBy(F.col(key).alias("_key")).agg(F.max("_version").alias("_last"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_version") == F.col("_last"))).drop("_version", "_key", "_last")


def compact(spark: SparkSession, path: str, key: str) -> int:
    """Write the current rows as one version, so that readers no longer join older ones.

    Older folders stay for the readers still at them; remove them when none is.
    """
    known = versions(spark, path)
    rows = current(spark, path, key)
    version = known[-1] + 1
    _write(rows, key, path, BASE, version)
    return version


def replace_from(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Replace keys by each micro-batch of a stream; one that is repeated changes nothing.

    The stream is the table's only writer, as its batch numbers are the versions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        replace(batch, path, key, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
