"""Streaming inputs and state-store settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state on disk next to the executors; keyed state needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_log(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, file_format: str = "parquet"
) -> DataFrame:
    """Stream of the files appearing under ``path`` (a folder or glob).

    ``files_per_trigger`` bounds a micro-batch, and with it the rows any one key can
    bring at a time.
    """
    return (
        spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def write_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append a stream to parquet files, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
