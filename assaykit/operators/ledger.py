"""Hash-chained audit ledgers: append and verify, one chain per key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.hashing import ledger_hash
from assaykit.operators.scan import ordered_scan
from assaykit.session import checkpointed

GENESIS = "0" * 64
PAYLOAD = ["timestamp", "actor", "action", "asset", "metadata_json"]
ENTRY = "chain STRING, seq BIGINT, timestamp STRING, actor STRING, action STRING, asset STRING, metadata_json STRING"


def chain_step(previous: str, payload: str) -> str:
    return hashlib.sha256(f"{previous}|{payload}".encode()).hexdigest()


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chain, head = None, GENESIS
    for pdf in batches:
        previous, current = [], []
        for key, start, payload in zip(pdf["chain"], pdf["head"], pdf["payload"]):
            if key != chain:
                chain, head = key, start if isinstance(start, str) else GENESIS
            previous.append(head)
            head = chain_step(head, payload)
            current.append(head)
        yield pdf.drop(columns=["head", "payload"]).assign(previous_hash=previous, current_hash=current)


def append(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Link entries (chain, seq, payload columns) to their predecessors.

    A chain is sequential by nature: each hash needs the one before. Chains run in
    parallel, and a chain streams through its task in sorted Arrow batches carrying one
    hash, so a long chain costs time but never memory. ``heads`` (chain, head) continues
    existing chains.
    """
    payload = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in PAYLOAD])
    rows = entries.select("chain", "seq", *PAYLOAD, payload.alias("payload"))
    if heads is None:
        rows = rows.withColumn("head", F.lit(None).cast("string"))
    else:
        rows = rows.join(heads.select("chain", "head"), "chain", "left")
    ordered = rows.repartition("chain").sortWithinPartitions("chain", "seq")
    return ordered.select("chain", "seq", *PAYLOAD, "payload", "head").mapInPandas(
        _fold, ENTRY + ", previous_hash STRING, current_hash STRING"
    )


def entry_hash() -> F.Column:
    """Hash an entry should carry, from its own columns."""
    return ledger_hash(F.col("previous_hash"), *[F.col(c) for c in PAYLOAD])


def check_entries(events: DataFrame) -> DataFrame:
    """Every entry with its index, the hash expected before it, whether it is the head of
    its chain, and what is broken.

    ``broken`` is LINK, CONTENT or null; the link is checked first. Uses the stored
    hashes, so all rows of all chains are checked in parallel.
    """
    scanned = ordered_scan(
        events, ["chain"], "seq", previous={"_before": "current_hash"}, following={"_next": "seq"}, index="index"
    )
    # the row itself always exists, so a missing predecessor is the genesis position
    expected = F.when(F.col("index") == 0, GENESIS).otherwise(F.col("_before"))
    linked = F.col("previous_hash").eqNullSafe(F.col("expected_previous"))
    intact = F.col("current_hash").eqNullSafe(entry_hash())
    return (
        scanned.withColumn("expected_previous", expected)
        .withColumn("is_head", F.col("_next").isNull())
        .drop("_before", "_next")
        .withColumn("broken", F.when(~linked, "LINK").when(~intact, "CONTENT"))
    )


def verify(events: DataFrame) -> DataFrame:
    """One row per chain: VALID or TAMPERED, first break, length and head hash."""
    checked = checkpointed(
        check_entries(events).select(
            "chain", "seq", "index", "broken", F.when(F.col("is_head"), F.col("current_hash")).alias("head")
        )
    )
    lengths = checked.groupBy("chain").agg(F.count(F.lit(1)).alias("total_events"))
    # only broken entries and heads, not the whole log, meet the struct and text aggregates
    breaks = (
        checked.where("broken IS NOT NULL")
        .groupBy("chain")
        .agg(F.min(F.struct("seq", "index", "broken")).alias("first"))
    )
    ends = checked.where("head IS NOT NULL").select("chain", "head")
    broken = F.col("first").isNotNull()
    return (
        lengths.join(breaks, "chain", "left")
        .join(ends, "chain", "left")
        .select(
            "chain",
            F.when(broken, "TAMPERED").otherwise("VALID").alias("status"),
            "total_events",
            F.col("first.index").alias("broken_index"),
            F.col("first.seq").alias("broken_seq"),
            F.col("first.broken").alias("broken_kind"),
            F.when(~broken, F.col("head")).alias("head_hash"),
        )
    )


def heads(events: DataFrame) -> DataFrame:
    """Last hash per chain, for continuing an append."""
    return events.groupBy("chain").agg(F.max_by("current_hash", "seq").alias("head"))
