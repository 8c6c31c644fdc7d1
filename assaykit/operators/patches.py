"""Repeated local patches: clusters of near-identical unit vectors per image region.

Cosine >= c on unit vectors is distance <= r. Vectors are turned by one orthonormal matrix
and a few leading coordinates are cut into m blocks: of two vectors within r some block is
within r / sqrt(m), so they meet in a cell of that block's grid. Cells are twice that wide,
which leaves one neighbour cell per axis in reach, and of their combinations only those
within the distance. Of two cells in reach the lower one takes the rows of both. The number
and width of the blocks follow the row count, but rows go to few cells: what they
leave together is compared by matrix products per cell, at about 2 ns a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.vectors import dot
from assaykit.operators import clusters, pairs
from assaykit.operators.scan import ordered_scan
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

COORDINATES = 16
#: Axes of a block at most: a row goes to at most two to this power cells of it.
BLOCK_AXES = 9
#: Rows that the basis and the blocks are chosen by. They decide the cost, never the result.
PLAN_ROWS = 1_024
#: What a row sent to a cell costs, in comparisons of two rows of a cell: the first few, and those beyond,
#: which would have the shuffle outgrow the input.
COPY_COST = 150
FEW_COPIES = 8
MORE_COST = 4_000
EPS = 1e-6
# Rules on a patch cluster.
CENTRE = "C"
MAX_FRACTION = 0.25


@dataclass
class BlockIndex:
    """Grid cells over blocks of rotated coordinates that rows within ``radius`` share.

    basis: (dims, coordinates) with orthonormal columns; blocks of ``axes`` coordinates each.
    """

    basis: np.ndarray
    blocks: int
    axes: int
    radius: float

    @property
    def reach(self) -> float:
        return self.radius / math.sqrt(self.blocks) + EPS

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row, block and axis: own cell, direction of the cell next to it, squared distance to that."""
        part = points[:, : self.blocks * self.axes].reshape(len(points), self.blocks, self.axes)
        width = 2 * self.reach
        own = np.floor(part / width)
        inside = part - own * width
        step = np.where(inside < self.reach, -1, 1)
        return own.astype(np.int64), step, np.minimum(inside, width - inside) ** 2

    def sent(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``touched`` without cells above the row's own: of two rows in reach one goes to the cell of the other."""
        own = self.cells(points)[0]
        for row, block, cell in self.touched(points):
            ahead = cell - own[row, block]
            first = np.take_along_axis(ahead, (ahead != 0).argmax(axis=1)[:, None], axis=1)[:, 0]
            below = first <= 0
            yield row[below], block[below], cell[below]

    def touched(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, block, cell of the block) for every cell within reach, the own ones first."""
        own, step, gap = self.cells(points)
        masks = (np.arange(1 << self.axes)[:, None] >> np.arange(self.axes)) & 1
        for block in range(self.blocks):
            near = gap[:, block] @ masks.T <= self.reach**2
            near[:, 0] = True
            mask, row = np.nonzero(near.T)
            yield row, np.full(len(row), block), own[row, block] + step[row, block] * masks[mask]

    def share_met(self, points: np.ndarray) -> tuple[float, float]:
        """Cells a row goes to, and the share of pairs of ``points`` that meet in some cell."""
        own, step, gap = self.cells(points)
        masks = (np.arange(1 << self.axes)[:, None] >> np.arange(self.axes)) & 1
        copies, met = 0.0, np.zeros((len(points), len(points)), dtype=np.int64)
        for block in range(self.blocks):
            copies += float((gap[:, block] @ masks.T <= self.reach**2).sum(axis=1).mean())
            inside, far = np.ones(met.shape, dtype=bool), np.zeros(met.shape)
            for axis in range(self.axes):
                ahead = own[None, :, block, axis] - own[:, None, block, axis]
                inside &= (ahead == 0) | (ahead == step[:, None, block, axis])
                far += np.where(ahead == 0, 0, gap[:, None, block, axis])
            met += inside & (far <= self.reach**2)
        apart = ~np.eye(len(points), dtype=bool)
        return copies, float(met[apart].mean()) if len(points) > 1 else 0.0


def block_index(sample: np.ndarray, radius: float, rows: float) -> BlockIndex:
    """The cheapest index for ``rows`` rows per region that look like ``sample``.

    The basis holds the directions in which the sample spreads most, mixed evenly for several blocks.
    """
    dims = sample.shape[1]
    width = min(COORDINATES, dims)
    _, _, directions = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=True)
    mixing = np.linalg.qr(np.random.default_rng(5).standard_normal((width, width)))[0]
    best, cost = None, math.inf
    for axes in range(1, min(BLOCK_AXES, width) + 1):
        for blocks in {1, width // axes} if axes > 1 else {1}:
            basis = directions[:width].T if blocks == 1 else directions[:width].T @ mixing
            index = BlockIndex(basis, blocks, axes, radius)
            touched, met = index.share_met(sample[:400] @ basis)
            copies = (touched + blocks) / 2
            price = COPY_COST * min(copies, FEW_COPIES) + MORE_COST * max(0.0, copies - FEW_COPIES) + met * rows / 2
            if price < cost:
                best, cost = index, price
    return best


def placed(nodes: DataFrame, index: BlockIndex) -> DataFrame:
    """Rows in cells: key, node, own (the row's own cell), point.

    A point is the coordinates and the length of what they leave out: that differs by no more than
    the vectors do there, so pairs are ruled out before their vectors are fetched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                batch = whole.slice(start, 1_000)
                node, zone = (batch.column(c).to_numpy() for c in ("node", "zone"))
                vectors = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                points = vectors @ index.basis
                rest = np.sqrt(np.maximum(0, (vectors**2).sum(axis=1) - (points**2).sum(axis=1)))
                kept = np.concatenate([points, rest[:, None]], axis=1).astype(np.float32)
                width = kept.shape[1] * kept.itemsize
                for row, block, cell in index.sent(points):
                    key = zone[row].view(np.uint64) ^ (block + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for axis in range(index.axes):
                        key = (key ^ cell[:, axis].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                        key ^= key >> np.uint64(31)
                    ends = pa.py_buffer((np.arange(len(row) + 1) * width).astype(np.int32))
                    point = pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(kept[row].tobytes())])
                    own = pa.array(np.arange(len(row)) < batch.num_rows)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(node[row]), own, point], names=["key", "node", "own", "point"])

    rows = nodes.select("node", F.xxhash64("region").alias("zone"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "key bigint, node bigint, own boolean, point binary")


def plan_index(nodes: DataFrame, radius: float) -> BlockIndex | None:
    """The index for ``nodes``, chosen by a bounded sample; None for an empty table."""
    sizes = nodes.groupBy("region").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if not sizes["n"]:
        return None
    every = max(1, sizes["n"] // (2 * PLAN_ROWS))
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("vec").limit(PLAN_ROWS).collect()
    some = some or nodes.select("vec").limit(PLAN_ROWS).collect()
    return block_index(np.array([r["vec"] for r in some], dtype=np.float64), radius, sizes["most"])


def similar_links(
    nodes: DataFrame, similarity: float = 0.98, tile_rows: int = pairs.TILE_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of one region with cosine >= ``similarity``, and cliques if crowded.

    nodes: node, region, vec (unit vectors of one length).
    """
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * similarity))
    nodes = checkpointed(nodes.select("node", "region", "vec"))
    index = plan_index(nodes, radius)
    if index is None:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")), None
    reach = checkpointed(placed(nodes, index))
    own = reach.where("own")
    close = pairs.Within(radius, index.basis.shape[1] + 1)
    members = pairs.crowd_members(own, reach, close, tile_rows)
    if members is not None:
        # cliques need the exact distance to the pivot
        half = 1.0 - (radius / 2) ** 2 / 2
        ends = [nodes.select(*[F.col(c).alias(f"{n}{c}") for c in ("node", "region", "vec")]) for n in "pq"]
        inside = members.withColumnsRenamed({"clique": "pnode", "node": "qnode"}).join(ends[0], "pnode").join(ends[1], "qnode")
        inside = inside.where((F.col("pregion") == F.col("qregion")) & (dot(F.col("pvec"), F.col("qvec")) >= half + EPS))
        members = checkpointed(inside.select(F.col("pnode").alias("clique"), F.col("qnode").alias("node")))
        own, reach = pairs.with_cliques(own, members), pairs.with_cliques(reach, members)
    tiles = checkpointed(pairs.dense_keys(own, reach, pairs.POINT_TILES * tile_rows))
    found = pairs.near_pairs(own, reach, close, None if tiles.isEmpty() else tiles)
    # a pair may be close in several blocks
    found = checkpointed(found if index.blocks == 1 else found.distinct())
    sides = [nodes.select(*[F.col(c).alias(f"{n}{c}") for c in ("node", "region", "vec")]) for n in "ab"]
    exact = (
        found.where("NOT sure").withColumnsRenamed({"a": "anode", "b": "bnode"})
        .join(sides[0], "anode").join(sides[1], "bnode")
        .where((F.col("aregion") == F.col("bregion")) & (dot(F.col("avec"), F.col("bvec")) >= similarity))
    )
    links = found.where("sure").select("a", "b").unionByName(exact.select(F.col("anode").alias("a"), F.col("bnode").alias("b")))
    return links, members


def patch_clusters(
    patches: DataFrame,
    population: int,
    similarity: float = 0.98,
    min_size: int = 3,
    max_fraction: float = MAX_FRACTION,
    tile_rows: int = pairs.TILE_ROWS,
    component_rows: int = clusters.COMPONENT_ROWS,
) -> DataFrame:
    """Clustered patches: ord, sample_id, region, label, seed.

    patches: ord (unique over samples and regions), sample_id, region, label, vec.
    Clusters above ``max_fraction`` of the population use up their members and are dropped,
    as are centre clusters of a single label.
    """
    nodes, members = pairs.collapse_copies(patches, ["region", "vec"], min_size)
    members = members.drop("vec")
    links, crowd = similar_links(nodes, similarity, tile_rows)
    assigned = clusters.star_clusters(links, nodes.select("node", "weight"), min_size, crowd, component_rows)
    return kept_clusters(clusters.expand(members, assigned), population, max_fraction)


def kept_clusters(clustered: DataFrame, population: int, max_fraction: float = MAX_FRACTION) -> DataFrame:
    """Apply the size cap and the centre rule to clustered patches."""
    clustered = checkpointed(clustered)
    stats = clustered.groupBy("seed").agg(
        F.count(F.lit(1)).alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.min("region").alias("_r")
    )
    plain_centre = (F.col("_r") == CENTRE) & F.col("_lo").eqNullSafe(F.col("_hi"))
    good = stats.where((F.col("_n") <= int(population * max_fraction)) & ~plain_centre).select("seed")

    return lookup_join(clustered, checkpointed(good), ["seed"], "inner")


def patch_summary(clustered: DataFrame) -> DataFrame:
    """One row per cluster: id, location, size, dominant class, correlation, severity.

    The dominant class is the most frequent; of several, the one met first.
    """
    votes = clustered.groupBy("seed", "region", "label").agg(
        F.count(F.lit(1)).alias("votes"), F.min("ord").alias("met")
    )
    per = votes.groupBy("seed", "region").agg(
        F.sum("votes").alias("cluster_size"),
        F.count(F.lit(1)).alias("classes"),
        F.max_by("label", F.struct("votes", (-F.col("met")).alias("early"))).alias("associated_class"),
        F.max("votes").alias("_top"),
    )
    correlation = F.round(F.col("_top") / F.col("cluster_size"), 2)
    strong = (correlation >= 0.75) & (F.col("cluster_size") >= 4)
    numbered = ordered_scan(checkpointed(per), [], "seed", index="_i")
    return numbered.select(
        F.format_string("TRIG-%s-%02d", F.col("region"), F.col("_i") + 1).alias("cluster_id"),
        "seed",
        F.col("region").alias("location"),
        "cluster_size",
        "classes",
        "associated_class",
        correlation.alias("class_correlation"),
        F.when(strong, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(strong, 0.92).otherwise(0.78).alias("confidence"),
        F.when(strong, "QUARANTINE").otherwise("REVIEW").alias("recommendation"),
    )


def patch_suspects(clustered: DataFrame, summary: DataFrame, every: bool = False) -> DataFrame:
    """One row per sample: of several clusters the last one found counts; with ``every`` one row for each."""

    detail = summary.select("seed", "location", "associated_class", "confidence")
    joined = lookup_join(clustered.select("sample_id", "seed"), detail, ["seed"], "inner")
    if every:
        return joined.select("sample_id", F.col("location").alias("trigger_location"), "associated_class", "confidence")
    return (
        joined.groupBy("sample_id")
        .agg(F.max_by(F.struct("location", "associated_class", "confidence"), "seed").alias("s"))
        .select("sample_id", F.col("s.location").alias("trigger_location"), "s.associated_class", "s.confidence")
    )


# Wording of a suspect's reason.
REASON = (
    "Localized patch at region '%s' exhibits anomalous cross-image repetition correlated with label '%s'"
    " (%d samples, %.1f%% of dataset)."
)


def suspect_details(
    clustered: DataFrame, summary: DataFrame, samples: DataFrame, population: int, every: bool = False
) -> DataFrame:
    """Suspect samples with location, class, confidence, where they came from and why.

    samples: sample_id, source_id, batch_id. Of several clusters of a sample the last counts;
    with ``every`` each of them has a row.
    """
    columns = ("location", "associated_class", "confidence", "cluster_size")
    joined = lookup_join(clustered.select("sample_id", "seed"), summary.select("seed", *columns), ["seed"], "inner")
    last = joined.select("sample_id", *columns)
    if not every:
        last = joined.groupBy("sample_id").agg(F.max_by(F.struct(*columns), "seed").alias("s")).select("sample_id", "s.*")
    share = F.col("cluster_size") * 100.0 / population
    reason = F.format_string(REASON, "location", F.coalesce(F.col("associated_class").cast("string"), F.lit("unlabelled")), "cluster_size", share)
    found = last.join(samples.select("sample_id", "source_id", "batch_id"), "sample_id", "left")
    return found.select(
        "sample_id", F.col("location").alias("trigger_location"), "associated_class", "confidence", "source_id", "batch_id", reason.alias("reason")
    )
