"""Replay detection on a stream, with the rows the batch operator gives.

Keyed state holds two facts per nonce, sequence, payload or record id: the earliest arrival,
and the earliest one under another record id. Rows are reduced to such facts before they are
shuffled, so a key with a third of a micro-batch brings a few rows to its state. The rows
themselves are judged against the facts per micro-batch, by joins that split hot keys.

The sequence head needs no state under one key: inside a micro-batch the prefix maximum is a
bucketed scan, and one row per stream, written with the batch, carries the head to the next.
Arrivals must not be older than those of earlier micro-batches; inside one any order will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assaykit.operators.provenance import check_records, record_flags, with_replays
from assaykit.operators.replay import (
    PAYLOAD_KEY, SAME_ID, keyed_rows, replayed_arrivals, settle_reasons,
)
from assaykit.operators.scan import ordered_scan
from assaykit.operators.skew import lookup_join
from assaykit.streaming.sources import use_rocksdb

REASONS = "arrival BIGINT, rule STRING, prior_record STRING"
SIGHTINGS = "rule STRING, key STRING, arrival BIGINT, record_id STRING, n BIGINT"
FACTS = "rule STRING, key STRING, first_at BIGINT, first_id STRING, other_at BIGINT, other_id STRING"
LOG_COLUMNS = ["arrival", "record_id", "nonce", "sequence", *PAYLOAD_KEY]


def _sightings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The earliest rows of a key under two record ids, per batch of rows, with the key's row count."""
    for rows in batches:
        rows = rows.sort_values("arrival", kind="stable")
        rows["n"] = rows.groupby(["rule", "key"])["arrival"].transform("size")
        leading = rows.drop_duplicates(["rule", "key", "record_id"]).groupby(["rule", "key"]).head(2)
        # a key's rows are counted once
        leading["n"] = leading["n"].where(~leading.duplicated(["rule", "key"]), 0)
        yield leading


class KeyFacts(StatefulProcessor):
    """Keeps a key's two facts; gives them for keys used more than once."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = "first_at BIGINT, first_id STRING, other_at BIGINT, other_id STRING, n BIGINT"
        self.facts = handle.getValueState("facts", fields, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, other, n = None, None, 0
        if self.facts.exists():
            first_at, first_id, other_at, other_id, n = self.facts.get()
            first = (first_at, first_id)
            other = None if other_at is None else (other_at, other_id)
        for frame in rows:
            for arrival, record, count in zip(frame["arrival"].tolist(), frame["record_id"].tolist(), frame["n"].tolist()):
                n += count
                seen = (arrival, record)
                if first is None or seen[0] < first[0]:
                    if first is not None and first[1] != record:
                        other = first
                    first = seen
                elif record != first[1] and (other is None or seen[0] < other[0]):
                    other = seen
        other_at, other_id = other or (None, None)
        self.facts.update((*first, other_at, other_id, n))
        if n > 1:
            rule, text = key
            cells = [(rule, text, *first, other_at, other_id)]
            facts = pd.DataFrame(cells, columns=["rule", "key", "first_at", "first_id", "other_at", "other_id"])
            yield facts.astype({"first_at": "Int64", "other_at": "Int64"})

    def close(self) -> None:
        pass


def key_facts(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Facts of the keys that a micro-batch touches and that were used more than once."""
    use_rocksdb(log.sparkSession)
    seen = keyed_rows(log).mapInPandas(_sightings, SIGHTINGS)
    return seen.groupBy("rule", "key").transformWithStateInPandas(
        statefulProcessor=KeyFacts(ttl_ms), outputStructType=FACTS, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def _repeats(log: DataFrame, facts: DataFrame) -> DataFrame:
    judged = lookup_join(keyed_rows(log), facts, ["rule", "key"], "inner")
    own = (F.col("record_id") == F.col("first_id")) & (F.col("rule") != SAME_ID)
    at = F.when(own, F.col("other_at")).otherwise(F.col("first_at"))
    prior = F.when(own, F.col("other_id")).otherwise(F.col("first_id"))
    return judged.where(at < F.col("arrival")).select("arrival", "rule", prior.alias("prior_record"))


def _heads_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """One row per stream: its largest sequence before micro-batch ``batch_id``."""
    empty = spark.createDataFrame([], "stream STRING, head BIGINT")
    if batch_id == 0:
        return empty
    return spark.read.schema(empty.schema).parquet(f"{path}/batch={batch_id - 1}")


def write_reasons(
    log: DataFrame, path: str, checkpoint: str, stream: str | None = None, ttl_ms: int | None = None
):
    """Streaming replay reasons, written under ``path``: read them with ``read_reasons``.

    Each micro-batch writes ``reasons/batch=<id>`` and ``heads/batch=<id>`` (one row per
    ``stream``), so one that is repeated after a crash replaces what it wrote. ``ttl_ms``
    forgets keys not seen for that long; without it state grows with the log and the answer
    equals the batch one. Rows without a sequence leave the head alone; those without a
    ``stream`` are a stream of their own.
    """
    lane = (F.coalesce(F.col(stream).cast("string"), F.lit("")) if stream else F.lit("")).alias("stream")
    rows = log.select(F.struct(*LOG_COLUMNS, lane).alias("row"), F.lit(None).cast(f"struct<{FACTS}>").alias("fact"))
    kind = rows.schema["row"].dataType
    facts = key_facts(log, ttl_ms)
    facts = facts.select(F.lit(None).cast(kind).alias("row"), F.struct(*facts.columns).alias("fact"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the state of the micro-batch is read and written by one job only
        batch.persist()
        records = batch.where("row IS NOT NULL").select("row.*")
        repeats = _repeats(records, batch.where("fact IS NOT NULL").select("fact.*"))
        before = _heads_before(spark, f"{path}/heads", batch_id)
        reached = records.groupBy("stream").agg(F.max("sequence").alias("head")).unionByName(before)
        heads = reached.groupBy("stream").agg(F.max("head").alias("head"))
        scanned = ordered_scan(records.select("arrival", "sequence", "stream"), ["stream"], "arrival", max_before={"head": "sequence"})
        carried = lookup_join(scanned, before.withColumnRenamed("head", "opening"), ["stream"])
        head = F.greatest("head", "opening")
        behind = carried.where(F.col("sequence") <= head).select(
            "arrival", F.lit("SEQUENCE_REGRESSION").alias("rule"), head.cast("string").alias("prior_record")
        )
        repeats.unionByName(behind).write.mode("overwrite").parquet(f"{path}/reasons/batch={batch_id}")
        heads.write.mode("overwrite").parquet(f"{path}/heads/batch={batch_id}")
        batch.unpersist()

    return (
        rows.unionByName(facts).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_reasons(spark: SparkSession, path: str) -> DataFrame:
    """Final reasons of a stream: those of ``replay.replay_reasons`` without a clock."""
    return settle_reasons(spark.read.schema(REASONS).parquet(f"{path}/reasons/batch=*"))


def check_batches(log: DataFrame, path: str, checkpoint: str):
    """Stream of component and hash checks, written per micro-batch.

    Each micro-batch overwrites its own partition, so a repeated one changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            check_records(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        )

    return (
        log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def verified_flags(checked: DataFrame, reasons: DataFrame) -> DataFrame:
    """Status flags per record from the two streams' outputs (``read_reasons``)."""
    return record_flags(with_replays(checked, replayed_arrivals(reasons)))
