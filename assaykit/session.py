"""Session settings and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "assaykit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here is required by the operators: they run on any session. AQE with
    skew-join splitting is what keeps hot join keys from sitting in one task.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder the cluster names, or a local one in tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back from there.

    Used where a result feeds several later passes: it is computed once, an executor lost
    afterwards costs a file read instead of a recomputation, and as parquet it is read by
    column with known sizes, which lets Spark choose joins from facts.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_checkpoints(spark: SparkSession) -> None:
    """Delete this application's own tables from the checkpoint folder, at its end."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        path = context._jvm.org.apache.hadoop.fs.Path(current)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """Evaluate a table that has few rows by construction (per feature, per bin, per
    cluster cell) and keep it as a local relation. Never for tables that grow with data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
