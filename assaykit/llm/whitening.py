"""Whitening of embeddings by leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. One pass over the distinct vectors multiplies it with a block
of vectors, centring every row before the product. Rayleigh-Ritz on a small subspace gives
approximate eigenpairs; each open one is corrected by an equation projected off itself and
off the pairs already locked, solved by a few steps of MINRES, and the corrections enlarge
the subspace. All open pairs take their steps side by side, so a pass serves all of them. A
pair is locked when its residual has reached double precision.

The driver holds the subspace and sums of the vectors' width; rows stay in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import masked, unmasked
from assaykit.session import checkpointed

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
SEED = 11
#: Residual norms, in units of the largest eigenvalue, at which a pair is locked.
RESIDUAL = 256 * np.finfo(np.float64).eps
#: Eigenvalues below this share of the largest are rounding: such directions hold no variance.
FLAT = 1e-13
#: Vectors of a stored block, steps of the inner solver, and the subspace in multiples of the components.
BLOCK_ROWS = 2_048
INNER_STEPS = 6
SUBSPACE = 4
#: Scaled entries beyond this can't be whole numbers in a double.
LARGEST = float(1 << 52)


def scaled(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry as longs."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors with entries, all of them finite and small enough to scale."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE > LARGEST))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


@dataclass
class Moments:
    """Count and per-dimension sums of the fit list, and its trace."""

    n: int
    sums: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, by way of exact whole numbers."""
        return (x * self.n - self.sums) / self.n


def fit_blocks(rows: DataFrame) -> DataFrame:
    """Each distinct ``_x`` once, packed: (rows, data), data the longs of up to BLOCK_ROWS vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.column(0).slice(at, BLOCK_ROWS)
                data = part.flatten().to_numpy().tobytes()
                yield pa.record_batch({"rows": pa.array([len(part)], pa.int32()), "data": pa.array([data], pa.binary())})

    distinct = rows.select("_x").groupBy("_x").agg(F.lit(1).alias("_one")).select("_x")
    return checkpointed(distinct.mapInArrow(pack, "rows int, data binary"))


def _summed(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """Sum over blocks of an array that depends on one block of vectors, taken in two levels."""
    name = {np.int64: "bigint", np.float64: "double"}[kind]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows, data in zip(batch.column("rows").to_pylist(), batch.column("data")):
                value = of_block(np.frombuffer(data.as_buffer(), dtype=np.int64).reshape(rows, -1))
                total = value if total is None else total + value
        if total is not None:
            yield pa.record_batch({"v": pa.array([total.ravel()], pa.list_(pa.from_numpy_dtype(kind)))})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum(np.stack(frame["v"]), axis=0)]})

    parts = blocks.mapInArrow(partial, f"v array<{name}>")
    count = parts.rdd.getNumPartitions()
    if count > 64:
        # as many sums again at most as there are groups come to the driver
        groups = parts.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(int(count**0.5))))
        parts = groups.groupBy("_g").applyInPandas(merge, f"v array<{name}>")
    found = [r["v"] for r in parts.collect()]
    return np.sum(np.array(found, dtype=kind), axis=0) if found else None


def moments(blocks: DataFrame) -> Moments | None:
    """n, S and trace(V); None for an empty fit list."""

    def sums(x: np.ndarray) -> np.ndarray:
        return np.r_[np.int64(len(x)), x.sum(axis=0)]

    found = _summed(blocks, sums, np.int64)
    if found is None:
        return None
    known = Moments(int(found[0]), found[1:], 0.0)
    _within_longs(known.n, np.abs(known.sums).max())
    spread = _summed(blocks, lambda x: (known.centred(x) ** 2).sum(axis=0), np.float64)
    known.trace = float(spread.sum() / known.n)
    return known


def _within_longs(n: int, largest: float) -> None:
    if float(n) * float(largest) > 2.0**62:
        raise OverflowError("n * S does not fit a long")


def covariance_product(blocks: DataFrame, known: Moments) -> Callable[[np.ndarray], np.ndarray]:
    """V @ Q in one pass over the blocks: rows are centred, then multiplied."""

    def product(q: np.ndarray) -> np.ndarray:
        def of_block(x: np.ndarray) -> np.ndarray:
            z = known.centred(x)
            return z.T @ (z @ q)

        return _summed(blocks, of_block, np.float64).reshape(q.shape) / known.n

    return product


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to orthonormal columns; drops what adds nothing."""
    kept = []
    base = np.concatenate(against, axis=1)
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for part in (base, np.stack(kept, axis=1) if kept else base[:, :0]):
                column = column - part @ (part.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept.append(column)
    return np.stack(kept, axis=1) if kept else block[:, :0]


def minres(product: Callable, shifts: np.ndarray, project: Callable, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of P (A - shift) P t = right, a column each, all columns in step.

    Every step is one product with a block. ``project`` applies each column's own projector.
    """
    t = np.zeros_like(right)
    size = np.linalg.norm(right, axis=0)
    v, before = right / np.where(size > 0, size, 1), np.zeros_like(right)
    beta, eta = size.copy(), size.copy()
    c1 = c0 = np.ones(right.shape[1])
    s1 = s0 = np.zeros(right.shape[1])
    w1 = w0 = np.zeros_like(right)
    open_ = size > 0
    first = True
    for _ in range(steps):
        if not open_.any():
            break
        image = project(product(v) - v * shifts)
        alpha = (v * image).sum(axis=0)
        image = project(image - v * alpha - (0 if first else before * beta))
        ahead = np.linalg.norm(image, axis=0)
        low = 0 if first else beta
        d = c1 * alpha - c0 * s1 * low
        r1 = np.hypot(d, ahead)
        r2 = s1 * alpha + c0 * c1 * low
        r3 = s0 * low
        safe = np.where(r1 > 0, r1, 1)
        w = (v - w0 * r3 - w1 * r2) / safe
        c, s = np.where(r1 > 0, d / safe, 1.0), np.where(r1 > 0, ahead / safe, 0.0)
        t = t + np.where(open_ & (r1 > 0), c * eta, 0) * w
        eta = -s * eta
        w0, w1, c0, c1, s0, s1 = w1, w, c1, c, s1, s
        before, beta = v, ahead
        open_ = open_ & (ahead > 1e-14 * np.abs(alpha))
        v, first = image / np.where(ahead > 0, ahead, 1), False
    return t


def leading_pairs(product: Callable, width: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors, by Jacobi-Davidson.

    Ends when all residuals are at most RESIDUAL times the largest eigenvalue.
    """
    room = min(width, max(SUBSPACE * wanted, wanted + 8))
    guard = min(width, wanted + 2)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((width, guard)), np.zeros((width, 0)))
    image = product(basis)
    locked = np.zeros((width, 0))
    locked_image = np.zeros((width, 0))
    rounds = 0
    while True:
        rounds += 1
        if rounds % 25 == 0:
            # images are carried along by rotations; now and then they are made anew
            locked_image, image = np.split(product(np.c_[locked, basis]), [locked.shape[1]], axis=1)
        whole, images = np.c_[locked, basis], np.c_[locked_image, image]
        # locked vectors stay in the Rayleigh-Ritz step, so their order and angles stay right
        small = whole.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_image = whole @ turn, images @ turn
        residual = ritz_image[:, :wanted] - ritz[:, :wanted] * values[:wanted]
        limit = RESIDUAL * max(abs(values[0]), np.finfo(np.float64).tiny)
        done = np.linalg.norm(residual, axis=0) <= limit
        lead = wanted if done.all() else int(np.argmin(done))
        if lead == wanted:
            return _canonical(values[:wanted], ritz[:, :wanted])
        locked, locked_image = ritz[:, :lead], ritz_image[:, :lead]
        keep = min(ritz.shape[1], max(guard, room - (wanted - lead)))
        basis, image = ritz[:, lead:keep], ritz_image[:, lead:keep]
        at = np.arange(lead, wanted)[~done[lead:]]
        own, shifts = ritz[:, at], values[at]

        def project(block: np.ndarray) -> np.ndarray:
            block = block - locked @ (locked.T @ block)
            return block - own * (own * block).sum(axis=0)

        right = project(-residual[:, at])
        steps = minres(product, shifts, project, right, INNER_STEPS)
        fresh = _orthonormal(np.c_[steps, right], locked, basis)[:, : max(1, width - locked.shape[1] - basis.shape[1])]
        if not fresh.shape[1]:
            # the subspace is invariant: a fresh image of the basis removes the rounding of the old one
            basis = _orthonormal(np.c_[locked, basis], np.zeros((width, 0)))
            locked = locked_image = np.zeros((width, 0))
            again = product(basis)
            if np.linalg.norm(again - basis @ (basis.T @ again)) <= limit * np.sqrt(basis.shape[1]):
                small = basis.T @ again
                values, turn = np.linalg.eigh((small + small.T) / 2)
                return _canonical(values[::-1][:wanted], (basis @ turn[:, ::-1])[:, :wanted])
            image = again
            continue
        basis, image = np.c_[basis, fresh], np.c_[image, product(fresh)]


def _canonical(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest entry of each vector made positive."""
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0)
    return values, vectors * np.sign(largest)


@dataclass
class Whitening:
    """What maps a vector to its whitened components."""

    known: Moments
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.known.trace

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(deviation, whitened) of rows of longs; deviation is exact or an error."""
        _within_longs(self.known.n, np.abs(x).max(initial=0))
        apart = x * self.known.n - self.known.sums
        if (apart.astype(np.float64) ** 2).sum(axis=1).max(initial=0) > 9.2e18:
            raise OverflowError("a deviation does not fit a long")
        return (apart * apart).sum(axis=1), (apart / self.known.n) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = SEED) -> Whitening | None:
    """The whitening of the distinct vectors ``_x`` of rows; None if there is no variance."""
    blocks = fit_blocks(rows)
    known = moments(blocks)
    if known is None or known.trace <= 0:
        return None
    width = len(known.sums)
    product = covariance_product(blocks, known)
    values, vectors = leading_pairs(product, width, min(components, width), seed)
    real = values > FLAT * values[0]
    values, vectors = values[real], vectors[:, real]
    spread = vectors.T @ product(vectors) / np.sqrt(np.outer(values, values))
    return Whitening(known, values, vectors, float(np.abs(spread - np.eye(len(values))).max()))


def whiten(
    vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, seed: int = SEED
) -> DataFrame:
    """Rows with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Entries are scaled to whole numbers first. n counts the distinct scaled vectors;
    deviation is the sum over dimensions of (n * x - S) squared; whitened and explained are
    arrays with one entry per component. The covariance is over the distinct vectors, so
    copies and repeated rows don't weigh more, but every row gets its result.

    Rows take no part, and are not in the result, if the vector is null, empty, holds null or
    entries that are not finite or beyond 2 ** 52 / 64, or is not of the most frequent length
    (ties: the longest). There are fewer components where the vectors span fewer dimensions;
    without variance (no row, or one distinct vector) there is no row. A null id is an id
    like any other. Other columns pass through; one named like a result gives way to it. A
    deviation beyond 64 bits is an error, not a wrong number.
    """
    rows, name = masked(vectors)
    valid = rows.where(usable(F.col(name[vector_col])))
    lengths = valid.groupBy(F.size(name[vector_col]).alias("_d")).count().orderBy(F.desc("count"), F.desc("_d"))
    width = lengths.first()
    model = None
    if width is not None:
        valid = valid.where(F.size(name[vector_col]) == width["_d"])
        valid = valid.withColumn("_x", scaled(F.col(name[vector_col])))
        model = fit(valid, components, seed)
    kind = "struct<deviation: bigint, whitened: array<double>>"

    @F.arrow_udf(kind)
    def applied(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy().reshape(len(values), -1)
        deviation, white = model.apply(x)
        offsets = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviation), lists], ["deviation", "whitened"])

    if model is None:
        none = valid.where(F.lit(False)).withColumn("_r", F.lit(None).cast(kind))
        n, explained, error = 0, [], 0.0
    else:
        none = valid.withColumn("_r", applied("_x"))
        n, explained, error = model.known.n, model.explained.tolist(), model.identity_error
    return unmasked(
        none,
        vectors,
        {
            "n": F.lit(n).cast("long"),
            "deviation": F.col("_r.deviation"),
            "whitened": F.col("_r.whitened"),
            "explained": F.array(*map(F.lit, explained)).cast("array<double>"),
            "identity_error": F.lit(error),
        },
    )
