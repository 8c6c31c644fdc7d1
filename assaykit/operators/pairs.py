"""Exact near-pair joins that survive hot keys.

Rows meet on candidate keys (an equi-join, never a cross join). A key shared by many rows
is cut into tiles, so each (key, tile) join group has a bounded number of rows per side.
Rows crowded around one pivot closer than half the radius are all neighbours of each other:
they are kept as one clique, a membership row each, instead of being listed pair by pair.
Rows with a ``point``, numbers in single precision, are compared by matrix products per
key, which takes about a hundredth of the time of a joined row per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

TILE_ROWS = 4_000
#: Rows per side of a group of points, in tiles of joined rows.
POINT_TILES = 16
#: Rows of a crowded key that are looked through for crowds, and the share of them that makes one.
CROWD_ROWS = 1_000
CROWD_SHARE = 1 / 20
Match = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


@dataclass
class Within:
    """Match of rows whose ``point`` (bytes of ``dims`` float32) lie within ``distance``, rounding included.

    A point's last number is the length of what the others leave out of a unit vector.
    """

    distance: float
    dims: int

    @property
    def least(self) -> float:
        return -(self.distance**2 + 2e-5) / 2

    def points(self, column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, self.dims)

    def sure(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the vectors of matching rows are within the distance whatever their points leave out."""
        most = ((a - b) ** 2).sum(axis=1) + 4 * a[:, -1] * b[:, -1]
        whole = [np.abs((p**2).sum(axis=1) - 1) < 1e-5 for p in (a, b)]
        return (most <= self.distance**2 - 4e-5) & whole[0] & whole[1]

    def near(self, left: np.ndarray, right: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None = None):
        """Positions of matching rows, block by block; of rows sharing a true column of ``apart`` none."""
        one, other = (-(p**2).sum(axis=1, keepdims=True) / 2 for p in (left, right))
        left = np.concatenate([left, one, np.ones_like(one)], axis=1)
        right = np.concatenate([right, np.ones_like(other), other], axis=1)
        for i in range(0, len(left), 1_024):
            for j in range(0, len(right), 8_192):
                # minus half the squared distance
                hit = left[i : i + 1_024] @ right[j : j + 8_192].T >= self.least
                if apart is not None:
                    hit &= apart[0][i : i + 1_024] @ apart[1][j : j + 8_192].T == 0
                if hit.any():
                    a, b = np.nonzero(hit)
                    yield a + i, b + j


def side(name: str) -> Callable[[str], Column]:
    return lambda column: F.col(f"{name}_{column}")


def _prefixed(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns])


def dense_keys(own: DataFrame, reach: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Keys with more than ``tile_rows`` rows on a side, and their tile counts."""
    left = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_own"))
    right = reach.groupBy("key").agg(F.count(F.lit(1)).alias("n_reach"))
    return (
        left.join(right, "key")
        .where((F.col("n_own") > tile_rows) | (F.col("n_reach") > tile_rows))
        .select(
            "key",
            F.ceil(F.col("n_own") / tile_rows).cast("int").alias("_ta"),
            F.ceil(F.col("n_reach") / tile_rows).cast("int").alias("_tb"),
        )
    )


def near_pairs(own: DataFrame, reach: DataFrame, match: Match | Within, dense: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with a < b sharing a key and satisfying ``match``.

    Both sides have ``key``, ``node`` and whatever ``match`` reads. For points, ``reach`` tells by
    ``own`` which rows are those of ``own``; the others are met whichever node is the lower. Their
    pairs have a column ``sure``, false where vectors must be looked at.
    """
    a, b = side("a"), side("b")
    on = a("key") == b("key")
    if dense is not None:
        tiles = dense.select("key", "_ta", "_tb")
        one = F.lit(1)
        own = (
            lookup_join(own, tiles, ["key"])
            .withColumn("ta", F.pmod(F.xxhash64("node"), F.coalesce(F.col("_ta"), one)).cast("int"))
            .withColumn("tb", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_tb"), one) - 1)))
        )
        reach = (
            lookup_join(reach, tiles, ["key"])
            .withColumn("tb", F.pmod(F.xxhash64("node"), F.coalesce(F.col("_tb"), one)).cast("int"))
            .withColumn("ta", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ta"), one) - 1)))
        )
        on = on & (a("ta") == b("ta")) & (a("tb") == b("tb"))
    if isinstance(match, Within):
        return _near_points(own, reach, match, ["key"] if dense is None else ["key", "ta", "tb"])
    # the optimiser counts a row's keys as one row, so without the hint it broadcasts millions
    joined = _prefixed(own, "a").hint("merge").join(
        _prefixed(reach, "b"), on & (a("node") < b("node")) & match(a, b)
    )
    return joined.select(a("node").alias("a"), b("node").alias("b"))


def _near_points(own: DataFrame, reach: DataFrame, match: Within, keys: list[str]) -> DataFrame:
    listed = [c for c in ("cliques",) if c in reach.columns]
    sides = [
        rows.select(*keys, "node", "point", *listed, role.alias("role"))
        for rows, role in ((own, F.lit(0)), (reach, F.when(F.col("own"), 1).otherwise(2)))
    ]

    def meet(group: pa.Table) -> pa.Table:
        role, node = group["role"].to_numpy(), group["node"].to_numpy()
        points, left, right = match.points(group["point"]), np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        apart = None
        if listed:
            member = _memberships(group["cliques"].to_pylist())
            apart = member[left], member[right]
        found, sure = [np.empty((0, 2), dtype=np.int64)], [np.empty(0, dtype=bool)]
        for i, j in match.near(points[left], points[right], apart):
            a, b, own_too = node[left[i]], node[right[j]], role[right[j]] == 1
            kept = (a < b) | (~own_too & (a != b))
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[kept])
            sure.append(match.sure(points[left[i[kept]]], points[right[j[kept]]]))
        whole = np.concatenate(found)
        return pa.table({"a": whole[:, 0], "b": whole[:, 1], "sure": np.concatenate(sure)})

    return sides[0].unionByName(sides[1]).groupBy(*keys).applyInArrow(meet, "a BIGINT, b BIGINT, sure BOOLEAN")


def _memberships(cliques: list[list[int] | None]) -> np.ndarray:
    """A row per row, a column per clique: one for its members."""
    numbers = {c: n for n, c in enumerate(sorted({c for row in cliques for c in row or ()}))}
    member = np.zeros((len(cliques), len(numbers)), dtype=np.float32)
    for i, row in enumerate(cliques):
        member[i, [numbers[c] for c in row or ()]] = 1
    return member


def crowd_members(own: DataFrame, reach: DataFrame, match: Within, tile_rows: int = TILE_ROWS) -> DataFrame | None:
    """(clique, node) for rows with points within half the distance of a row that many others are near to.

    Keys with over ``tile_rows`` own rows are looked through; None where none of them has a crowd.
    """
    half = Within(match.distance / 2, match.dims)
    large = checkpointed(own.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile_rows))
    if large.isEmpty():
        return None
    every = F.ceil(F.col("_n") / CROWD_ROWS)
    some = lookup_join(own, large, ["key"], "inner").where(F.pmod(F.xxhash64("node"), every) == 0).select("key", "node", "point")

    def choose(group: pa.Table) -> pa.Table:
        points, open_rows = half.points(group["point"]), np.ones(group.num_rows, dtype=bool)
        near = np.zeros((len(points), len(points)), dtype=bool)
        for i, j in half.near(points, points):
            near[i, j] = True
        chosen = []
        while open_rows.any():
            size = near[:, open_rows].sum(axis=1) * open_rows
            if size.max() < max(3, CROWD_SHARE * len(points)):
                break
            chosen.append(int(size.argmax()))
            open_rows &= ~near[chosen[-1]]
            open_rows[chosen[-1]] = False
        return group.take(pa.array(chosen, pa.int64())).select(["key", "node", "point"]).rename_columns(["key", "clique", "pivot"])

    pivots = checkpointed(some.groupBy("key").applyInArrow(choose, "key BIGINT, clique BIGINT, pivot BINARY"))
    if pivots.isEmpty():
        return None

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = half.points(batch.column("point")) - half.points(batch.column("pivot"))
            close = (gap**2).sum(axis=1) <= -2 * half.least
            yield batch.select(["clique", "node"]).filter(pa.array(close))

    rows = lookup_join(reach, pivots, ["key"], "inner").select("clique", "node", "point", "pivot")
    return rows.mapInArrow(inside, "clique BIGINT, node BIGINT").distinct()


def cliques(own: DataFrame, reach: DataFrame, dense: DataFrame, core: Match) -> DataFrame:
    """(clique, node) for rows within half the radius of the pivot of a dense key.

    The pivot is the lowest node of the key. ``core(pivot, row)`` must guarantee that any
    two rows satisfying it are neighbours.
    """
    columns = [c for c in own.columns if c != "key"]
    crowded = lookup_join(own, dense.select("key"), ["key"], "inner")
    pivots = crowded.groupBy("key").agg(F.min_by(F.struct(*columns), "node").alias("p"))
    rows = lookup_join(reach, checkpointed(pivots), ["key"], "inner")
    inside = rows.where(core(lambda c: F.col(f"p.{c}"), lambda c: F.col(c)))
    return inside.select(F.col("p.node").alias("clique"), "node").distinct()


def with_cliques(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Add ``cliques``, the cliques a row belongs to (no more than it has keys)."""
    listed = members.groupBy("node").agg(F.collect_set("clique").alias("cliques"))
    return rows.join(listed, "node", "left")


def apart(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """True unless both rows share a clique."""
    return ~F.coalesce(F.arrays_overlap(a("cliques"), b("cliques")), F.lit(False))


def all_links(links: DataFrame, members: DataFrame | None) -> DataFrame:
    """Links with those inside cliques, which ``links`` leaves out, listed pair by pair."""
    if members is None:
        return links
    rows = checkpointed(members.select(F.col("clique").alias("key"), "node"))
    inside = near_pairs(rows, rows, lambda a, b: F.lit(True), checkpointed(dense_keys(rows, rows)))
    # two rows may share several cliques
    return links.unionByName(inside.distinct())


def collapse_copies(rows: DataFrame, keys: list[str], min_size: int) -> tuple[DataFrame, DataFrame]:
    """Fold groups of at least ``min_size`` identical rows into one node each.

    ``rows`` has a unique ``ord``. Returns nodes (node, weight, keys) and members
    (rows plus ``node``). A group that large always ends up in one cluster, so folding it
    changes no result, and N copies cost N rows instead of N*N pairs. Both results are
    read from stored tables.
    """
    floods = checkpointed(
        rows.groupBy(*keys)
        .agg(F.min("ord").alias("_node"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_size)
    )
    members = checkpointed(
        lookup_join(rows, floods, keys).withColumn("node", F.coalesce("_node", "ord"))
    )
    singles = members.where(F.col("_node").isNull()).select("node", F.lit(1).cast("long").alias("weight"), *keys)
    folded = floods.select(F.col("_node").alias("node"), F.col("_n").alias("weight"), *keys)
    return singles.unionByName(folded), members.drop("_node", "_n")
