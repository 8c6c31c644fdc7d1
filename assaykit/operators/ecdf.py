"""Empirical distribution functions of two tables, many columns side by side.

One pass sketches every column (mergeable quantile sketches), which gives splitters. A
second one deals values to the ranges between them, each (column, range) to one task, where
they are counted and stored as sorted arrays. Totals of the ranges, a few numbers each, then
tell every range how much lies before it, so ranks, gaps and histograms are exact and come
from the stored arrays without another shuffle. Values are compared in single precision;
nulls and NaNs are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.session import checkpointed, pinned

#: Values of a range on average, and the accuracy of the sketches (about one in 1 300 ranks).
RANGE_ROWS = 250_000
LEAST_RANGES = 8
SKETCH = 2_048


@dataclass
class Feature:
    """One column: sizes and extremes of both sides, and the ranges its values are cut into."""

    name: str
    n_ref: int
    n_cand: int
    mean_ref: float | None
    mean_cand: float | None
    low: float
    high: float
    splitters: np.ndarray
    #: by range: values of each side before it, and the first value of a later range
    before_ref: dict[int, int] = field(default_factory=dict)
    before_cand: dict[int, int] = field(default_factory=dict)
    following: dict[int, float] = field(default_factory=dict)


def _single(value: Column) -> Column:
    return value.cast("float").cast("double")


def _sides(reference: DataFrame, candidate: DataFrame, features: list[str]) -> DataFrame:
    parts = [df.select(F.lit(side).alias("r"), *[_single(F.col(f)).alias(f"v{i}") for i, f in enumerate(features)])
             for df, side in ((reference, True), (candidate, False))]
    return parts[0].unionAll(parts[1])


def described(both: DataFrame, names: list[str]) -> list[Feature]:
    """Sizes, means, extremes and splitters of all columns, by one aggregation to one row."""
    wanted = []
    for i in range(len(names)):
        value = F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))
        ref, cand = F.when(F.col("r"), value), F.when(~F.col("r"), value)
        wanted += [
            F.count(ref).alias(f"n{i}"), F.count(cand).alias(f"m{i}"), F.avg(ref).alias(f"a{i}"), F.avg(cand).alias(f"b{i}"),
            F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias(f"s{i}"),
        ]
    # one row, a few numbers and a sketch per column
    whole = pinned(both.agg(*wanted))
    row = whole.collect()[0]
    known = [i for i in range(len(names)) if row[f"n{i}"] + row[f"m{i}"]]
    ranges = max([LEAST_RANGES, *(-(-(row[f"n{i}"] + row[f"m{i}"]) // RANGE_ROWS) for i in known)])
    cuts = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    found = whole.select(*[F.kll_sketch_get_quantile_double(f"s{i}", cuts).alias(f"q{i}") for i in known]).collect()[0] if known else {}
    return [
        Feature(name, row[f"n{i}"], row[f"m{i}"], row[f"a{i}"], row[f"b{i}"], row[f"lo{i}"], row[f"hi{i}"], np.unique(found[f"q{i}"] if i in known else []))
        for i, name in enumerate(names)
    ]


def ranged(both: DataFrame, features: list[Feature]) -> DataFrame:
    """A row per (feature, bucket): sorted distinct values and how often each side has them."""
    cuts = [f.splitters for f in features]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            side = frame["r"].to_numpy(dtype=bool)
            for i, cut in enumerate(cuts):
                values = frame[f"v{i}"].to_numpy(dtype=np.float64)
                known = ~np.isnan(values)
                distinct, ref, cand = _counted(values[known], side[known].astype(np.int64), (~side[known]).astype(np.int64))
                bucket = np.searchsorted(cut, distinct, side="right").astype(np.int32)
                yield pd.DataFrame({"feature": np.int32(i), "bucket": bucket, "value": distinct, "r": ref, "c": cand})

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        distinct, ref, cand = _counted(*(frame[c].to_numpy() for c in ("value", "r", "c")))
        return pd.DataFrame({
            "feature": [frame["feature"].iat[0]], "bucket": [frame["bucket"].iat[0]], "n_r": [ref.sum()], "n_c": [cand.sum()],
            "first": [distinct[0]], "values": [distinct.astype(np.float32).tobytes()], "refs": [_small(ref)], "cands": [_small(cand)],
        })

    dealt = both.mapInPandas(deal, "feature INT, bucket INT, value DOUBLE, r BIGINT, c BIGINT")
    schema = "feature INT, bucket INT, n_r BIGINT, n_c BIGINT, first DOUBLE, values BINARY, refs BINARY, cands BINARY"
    return checkpointed(dealt.groupBy("feature", "bucket").applyInPandas(pack, schema))


def _small(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, in eight where one needs them."""
    return counts.astype(np.int32 if counts.max() < 1 << 31 else np.int64).tobytes()


def _counted(values: np.ndarray, ref: np.ndarray, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values and the sums of both counts."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    if not len(starts):
        return values, ref[:0], cand[:0]
    return values[starts], np.add.reduceat(ref[order], starts), np.add.reduceat(cand[order], starts)


def _carry(stored: DataFrame, features: list[Feature]) -> None:
    """Tell every feature what lies before each of its ranges; a row per range is read."""
    by_feature: dict[int, list] = {}
    for row in stored.select("feature", "bucket", "n_r", "n_c", "first").collect():
        by_feature.setdefault(row["feature"], []).append(row)
    for i, rows in by_feature.items():
        known, ref, cand, last = features[i], 0, 0, None
        for row in sorted(rows, key=lambda r: r["bucket"]):
            known.before_ref[row["bucket"]], known.before_cand[row["bucket"]] = ref, cand
            if last is not None:
                known.following[last] = row["first"]
            ref, cand, last = ref + row["n_r"], cand + row["n_c"], row["bucket"]


def _of_ranges(stored: DataFrame, features: list[Feature], measure: Callable, size: int) -> dict[int, np.ndarray]:
    """Stacked numbers that ``measure(feature number, bucket, values, ref, cand)`` gives per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(c).to_pylist() for c in ("feature", "bucket")]
            out = []
            # the arrays stay in the batch: only those of one range are widened at a time
            for at, (i, bucket) in enumerate(zip(*numbers)):
                values, refs, cands = (batch.column(c)[at].as_buffer() for c in ("values", "refs", "cands"))
                values = np.frombuffer(values, dtype=np.float32).astype(np.float64)
                counts = [np.frombuffer(c, dtype=f"i{c.size // len(values)}").astype(np.int64) for c in (refs, cands)]
                out.append([float(x) for x in measure(i, bucket, values, *counts)])
            features, buckets = (pa.array(n, pa.int32()) for n in numbers)
            yield pa.record_batch([features, buckets, pa.array(out, pa.list_(pa.float64()))], names=["feature", "bucket", "found"])

    found = stored.select("feature", "bucket", "values", "refs", "cands").mapInArrow(run, "feature INT, bucket INT, found ARRAY<DOUBLE>")
    rows = sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])
    return {i: np.array([r[2] for r in rows if r[0] == i]).reshape(-1, size) for i in range(len(features))}


def _histogram(values: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Counts per bin of ascending edges, the last bin closed; values outside are left out."""
    inside = (values >= edges[0]) & (values <= edges[-1])
    at = np.minimum(np.searchsorted(edges, values[inside], side="right"), len(edges) - 1) - 1
    return np.bincount(at, weights=counts[inside], minlength=len(edges) - 1)


@dataclass
class Distributions:
    """Both tables' values in stored ranges, ready for exact statistics."""

    features: list[Feature]
    stored: DataFrame

    def gaps(self, shares: list[float], edges: dict[int, np.ndarray], bins: int) -> tuple[dict, dict, dict]:
        """Per feature number, in one pass: (largest gap, area between both functions), the
        reference's interpolated quantiles, and both histograms over ``edges`` of ``bins`` bins."""
        features, width = self.features, 2 + 2 * len(shares) + 2 * bins

        def measure(i, bucket, values, ref, cand):
            known = features[i]
            upto_ref = known.before_ref[bucket] + np.cumsum(ref)
            upto_cand = known.before_cand[bucket] + np.cumsum(cand)
            gap = np.abs(upto_ref / known.n_ref - upto_cand / known.n_cand) if known.n_ref and known.n_cand else np.zeros(len(values))
            steps = np.diff(np.r_[values, known.following.get(bucket, values[-1])])
            ranks = np.array(shares) * (known.n_ref - 1)
            found = []
            for rank in (np.floor(ranks), np.ceil(ranks)):
                at = np.searchsorted(upto_ref, rank, side="right")
                here = (rank >= known.before_ref[bucket]) & (at < len(values)) & (known.n_ref > 0)
                found.append(np.where(here, values[np.minimum(at, len(values) - 1)], 0.0))
            both = [_histogram(values, c, edges[i]) if i in edges else np.zeros(bins) for c in (ref, cand)]
            return np.concatenate([[gap.max(), (gap * steps).sum()], *found, *both])

        distance, quantiles, counts = {}, {}, {}
        for i, rows in _of_ranges(self.stored, features, measure, width).items():
            if not len(rows):
                continue
            distance[i] = float(rows[:, 0].max()), float(rows[:, 1].sum())
            # a rank lies in one range, the others give zero
            low, high = np.split(rows[:, 2 : 2 + 2 * len(shares)].sum(axis=0), 2)
            ranks = np.array(shares) * max(0, features[i].n_ref - 1)
            quantiles[i] = low + (high - low) * (ranks - np.floor(ranks))
            counts[i] = np.split(rows[:, 2 + 2 * len(shares) :].sum(axis=0), 2)
        return distance, quantiles, counts

    def counts(self, edges: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Both sides' histograms over the edges of each feature number."""
        most = max((len(e) - 1 for e in edges.values()), default=0)

        def measure(i, bucket, values, ref, cand):
            if i not in edges:
                return np.zeros(2 * most)
            both = [_histogram(values, c, edges[i]) for c in (ref, cand)]
            return np.concatenate([np.pad(b, (0, most - len(b))) for b in both])

        if not most:
            return {}
        found = _of_ranges(self.stored, self.features, measure, 2 * most)
        return {i: tuple(part[: len(edges[i]) - 1] for part in np.split(found[i].sum(axis=0), 2)) for i in edges}


def distributions(reference: DataFrame, candidate: DataFrame, names: list[str]) -> Distributions:
    both = _sides(reference, candidate, names)
    features = described(both, names)
    stored = ranged(both, features)
    _carry(stored, features)
    return Distributions(features, stored)
