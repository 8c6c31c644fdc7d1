"""Ledger append on a stream: the state of a chain is its last hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assaykit.operators.ledger import ENTRY, GENESIS, PAYLOAD, chain_step
from assaykit.streaming.sources import use_rocksdb


class ChainAppender(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "hash STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head = self.head.get()[0] if self.head.exists() else GENESIS
        frames = list(rows)
        ordered = pd.concat(frames).sort_values("seq")
        previous, current = [], []
        for payload in ordered["payload"]:
            previous.append(head)
            head = chain_step(head, payload)
            current.append(head)
        self.head.update((head,))
        yield ordered.drop(columns=["payload"]).assign(previous_hash=previous, current_hash=current)

    def close(self) -> None:
        pass


def append(entries: DataFrame) -> DataFrame:
    """Link streaming entries to their chains, in the form the batch operator gives.

    Entries of a chain must not be older than those of earlier micro-batches; the size of
    a micro-batch bounds what one chain brings at a time.
    """
    use_rocksdb(entries.sparkSession)
    payload = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in PAYLOAD])
    rows = entries.select("chain", "seq", *PAYLOAD, payload.alias("payload"))
    return rows.groupBy("chain").transformWithStateInPandas(
        statefulProcessor=ChainAppender(),
        outputStructType=ENTRY + ", previous_hash STRING, current_hash STRING",
        outputMode="Append",
        timeMode="None",
    )
