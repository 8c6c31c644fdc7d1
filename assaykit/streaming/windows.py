"""Windowed operators on streams: the batch plans behind a watermark, and sessions from cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assaykit.functions.times import epoch_micros
from assaykit.operators import windows
from assaykit.streaming.sources import use_rocksdb


def status_per_window(
    records: DataFrame, late: str, length: str, slide: str | None = None, time: str = "ts"
) -> DataFrame:
    """Status counts per window; rows more than ``late`` behind are dropped."""
    return windows.status_per_window(records.withWatermark(time, late), length, slide, time)


def drift_per_window(
    records: DataFrame, value: str, baseline: tuple[list[float], list[float]], late: str, length: str,
    slide: str | None = None, time: str = "ts",
) -> DataFrame:
    """PSI of each window against a fixed baseline."""
    return windows.drift_per_window(records.withWatermark(time, late), value, baseline, length, slide, time)


class OpenSession(StatefulProcessor):
    """Joins the cells of one key into sessions; its state is the session still open.

    Cells come once the watermark has passed their end, so in order of time over the
    micro-batches. The last cell that can continue a session begins before ``until`` and
    ends at most one gap later: the session is given when the watermark has passed that.
    """

    def __init__(self, counters: int):
        self.counters = counters

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start BIGINT, until BIGINT, closes BIGINT, counts ARRAY<BIGINT>")

    def _frame(self, key, found: list[tuple]) -> pd.DataFrame:
        names = ["start_us", "records", *[f"_b{b}" for b in range(self.counters)]]
        frame = pd.DataFrame(found, columns=names, dtype="int64")
        frame.insert(0, "key", pd.Series([key[0]] * len(found), dtype="object"))
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = until = None
        counts: list[int] = []
        if self.open.exists():
            start, until, closes, counts = self.open.get()
            counts = list(counts)
            self.handle.deleteTimer(closes)
        found = []
        cells = sorted((tuple(r) for f in rows for r in f[["first_us", "until_us", "gap_us", "counts"]].itertuples(index=False)), key=lambda r: r[0])
        for first, cell_until, gap, cell_counts in cells:
            if start is not None and first < until:
                counts = [a + int(b) for a, b in zip(counts, cell_counts)]
            else:
                if start is not None:
                    found.append((start, *counts))
                start, counts = int(first), [int(c) for c in cell_counts]
            until = int(cell_until)
            closes = (until + int(gap)) // 1000 + 1
        self.open.update((start, until, closes, counts))
        self.handle.registerTimer(closes)
        yield self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        if self.open.exists():
            start, _, _, counts = self.open.get()
            found.append((start, *counts))
            self.open.clear()
        yield self._frame(key, found)

    def close(self) -> None:
        pass


def _session_counts(records: DataFrame, key: str, gap: str, late: str, time: str, counters: dict) -> DataFrame:
    """Sessions with counters; one row per key and cell reaches the state of a key."""
    use_rocksdb(records.sparkSession)
    cells = windows.session_cells(records.withWatermark(time, late), key, gap, time, counters)
    names = ["records", *counters]
    gap_us = F.expr(f"CAST(INTERVAL '{gap}' AS INTERVAL DAY TO SECOND)")
    spans = F.unix_micros(F.timestamp_seconds(F.lit(0)) + gap_us)
    kind = records.schema[key].dataType.simpleString()
    rows = cells.select(F.col(key).alias("key"), "at", "first_us", "until_us", spans.alias("gap_us"), F.array(*names).alias("counts"))
    columns = ", ".join(f"{c} BIGINT" for c in ("start_us", *names))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=OpenSession(len(counters)), outputStructType=f"key {kind}, {columns}", outputMode="Append",
        timeMode="EventTime",
    ).withColumnRenamed("key", key)


def sessions(records: DataFrame, key: str, gap: str, late: str, time: str = "ts") -> DataFrame:
    """Sessions per key, in append or complete mode."""
    return (
        records.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("records"))
        .select(key, epoch_micros(F.col("w")["start"].cast("timestamp_ntz")).alias("start_us"), "records")
    )


def drift_per_session(
    records: DataFrame, key: str, value: str, baseline: tuple[list[float], list[float]], gap: str, late: str, time: str = "ts"
) -> DataFrame:
    """PSI of each finished session against a fixed baseline, as the batch operator gives it.

    A session is given once two gaps after its last record are behind the watermark. Rows more
    than ``late`` behind are dropped; earlier ones may come in any order.
    """
    counters = windows.bin_counters(value, baseline)
    return windows.session_psi(_session_counts(records, key, gap, late, time, counters), key, baseline)


def first_uses(records: DataFrame, late: str, key: str = "nonce", time: str = "ts") -> DataFrame:
    """Drop repeats of a nonce. State is forgotten once the watermark passes, so a repeat
    later than ``late`` is not caught here (the batch and stateful checks catch it)."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
