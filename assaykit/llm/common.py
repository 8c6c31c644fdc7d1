"""Small helpers shared by the text operators."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the only characters that part words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A never-null join key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("v"), source), F.lit("n"))


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names no operator uses, and the new name of each column."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unmasked(df: DataFrame, docs: DataFrame, results: dict[str, Column]) -> DataFrame:
    """Columns of ``docs`` under their own names, then ``results``.

    Where a column of the input has the name of a result, the result takes its place.
    """
    taken = {r.lower() for r in results}
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken]
    return df.select(*own, *[value.alias(name) for name, value in results.items()])


class Ranges:
    """Spans merged where they meet, searched by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touch(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def cover(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str, step: int = 64
) -> DataFrame:
    """Run a Python function over rows that arrive in Arrow batches.

    ``make()`` is called once per task and gives ``fn(rows) -> rows of the result``, called
    with at most ``step`` rows, fewer where texts are long. Results go on in bounded batches.
    """
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        held: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows = list(zip(*(column.to_pylist() for column in part.columns)))
                few = max(1, step * 4_000_000 // max(4_000_000, part.nbytes))
                for at in range(0, len(rows), few):
                    held.extend(fn(rows[at : at + few]))
                    if len(held) >= 4096:
                        yield _batch(held, target)
                        held = []
        if held:
            yield _batch(held, target)

    return df.mapInArrow(run, schema)


def each(fn: Callable[..., tuple]) -> Callable[[list[tuple]], list[tuple]]:
    """``fn(*row) -> row`` as a function of many rows."""
    return lambda rows: [fn(*row) for row in rows]


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.record_batch(
        [pa.array(values, type=field.type) for values, field in zip(columns, target)], schema=target
    )
