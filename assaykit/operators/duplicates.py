"""Near-duplicate clusters of rows with two 64-bit hashes.

Two rows match when both hashes are within ``d`` bits. Cut each hash into d+1 bands: one
band of each must be equal (pigeonhole), so rows meet on an equi-join over band pairs.
A crowded band pair is cut again over its remaining bits, by the same argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.vectors import hamming
from assaykit.operators import clusters, pairs
from assaykit.operators.scan import ordered_scan
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

BITS = 64


def max_distance(similarity: float) -> int:
    return int(round(BITS * (1.0 - similarity)))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(positions: list[int], parts: int) -> list[int]:
    """Split bit positions into ``parts`` contiguous masks."""
    size, extra = divmod(len(positions), parts)
    out, start = [], 0
    for part in range(parts):
        stop = start + size + (part < extra)
        out.append(_signed(sum(1 << p for p in positions[start:stop])))
        start = stop
    return out


def band_masks(distance: int) -> list[int]:
    return _masks(list(range(BITS)), distance + 1)


def fine_masks(distance: int) -> list[list[int]]:
    """For each band, masks cutting the bits outside it into distance+1 parts."""
    out = []
    for band in band_masks(distance):
        rest = [p for p in range(BITS) if not (band >> p) & 1]
        out.append(_masks(rest, distance + 1))
    return out


def _literal(masks) -> Column:
    def text(m) -> str:
        return f"array({', '.join(map(text, m))})" if isinstance(m, list) else f"{m}L"

    return F.expr(text(masks))


def _keyed(nodes: DataFrame, distance: int) -> DataFrame:
    """One row per node and band pair; ``i``/``j`` say which bands, ``s``/``u`` = -1."""
    masks = band_masks(distance)
    cells = ", ".join(
        f"struct({i} AS i, {j} AS j, xxhash64({i}, {j}, h1 & {p}L, h2 & {q}L) AS key)"
        for i, p in enumerate(masks)
        for j, q in enumerate(masks)
    )
    return nodes.select("node", "h1", "h2", F.expr(f"explode(array({cells}))").alias("c")).select(
        "node", "h1", "h2", "c.i", "c.j", F.lit(-1).alias("s"), F.lit(-1).alias("u"), "c.key"
    )


def _refined(rows: DataFrame, distance: int) -> DataFrame:
    """Replace a row's key by keys over the bits outside its two bands."""
    fine = _literal(fine_masks(distance))
    parts = range(distance + 1)
    cells = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(u).alias("u")) for s in parts for u in parts])
    opened = rows.select("node", "h1", "h2", "i", "j", "key", F.explode(cells).alias("c"))
    p = F.col("h1").bitwiseAND(F.get(F.get(fine, F.col("i")), F.col("c.s")))
    q = F.col("h2").bitwiseAND(F.get(F.get(fine, F.col("j")), F.col("c.u")))
    return opened.select(
        "node", "h1", "h2", "i", "j", "c.s", "c.u",
        F.xxhash64("key", "c.s", "c.u", p, q).alias("key"),
    )


def _match(distance: int) -> pairs.Match:
    masks, fine = _literal(band_masks(distance)), _literal(fine_masks(distance))

    def same(x: Column, y: Column, mask: Column) -> Column:
        return x.bitwiseXOR(y).bitwiseAND(mask) == 0

    def first(x: Column, y: Column, table: Column, position: Column) -> Column:
        """Whether ``position`` is the first mask on which both values agree."""
        earlier = F.slice(table, F.lit(1), position)
        return same(x, y, F.get(table, position)) & ~F.exists(earlier, lambda m: same(x, y, m))

    def match(a, b) -> Column:
        near = (hamming(a("h1"), b("h1")) <= distance) & (hamming(a("h2"), b("h2")) <= distance)
        at_band = first(a("h1"), b("h1"), masks, a("i")) & first(a("h2"), b("h2"), masks, a("j"))
        at_fine = F.when(a("s") < 0, F.lit(True)).otherwise(
            first(a("h1"), b("h1"), F.get(fine, a("i")), a("s"))
            & first(a("h2"), b("h2"), F.get(fine, a("j")), a("u"))
        )
        # same band cell on both sides (guards against key hash collisions); each pair is
        # reported from one cell only, so no distinct is needed afterwards
        cell = (a("i") == b("i")) & (a("j") == b("j")) & (a("s") == b("s")) & (a("u") == b("u"))
        return near & cell & at_band & at_fine

    return match


def near_links(
    nodes: DataFrame, distance: int, tile_rows: int = pairs.TILE_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """All node pairs (a, b) within ``distance`` on both hashes, and cliques if any.

    Pairs inside a clique are not listed; cliques is None unless some key is crowded.
    """
    keyed = _keyed(nodes, distance)
    crowded = pairs.dense_keys(keyed, keyed, tile_rows)
    if crowded.limit(1).count() == 0:
        return pairs.near_pairs(keyed, keyed, _match(distance)), None
    marked = lookup_join(keyed, checkpointed(crowded).select("key", F.lit(True).alias("hot")), ["key"])
    fine = _refined(marked.where("hot"), distance)
    keyed = checkpointed(marked.where("hot IS NULL").drop("hot").unionByName(fine))
    crowded = checkpointed(pairs.dense_keys(keyed, keyed, tile_rows))
    if crowded.limit(1).count() == 0:
        return pairs.near_pairs(keyed, keyed, _match(distance)), None
    half = distance // 2

    def core(p, row) -> Column:
        return (hamming(p("h1"), row("h1")) <= half) & (hamming(p("h2"), row("h2")) <= half)

    members = checkpointed(pairs.cliques(keyed, keyed, crowded, core))
    rows = pairs.with_cliques(keyed, members)
    full = _match(distance)
    links = pairs.near_pairs(rows, rows, lambda a, b: full(a, b) & pairs.apart(a, b), crowded)
    return links, members


def near_duplicates(
    rows: DataFrame,
    similarity: float = 0.92,
    min_size: int = 2,
    mode: str = "stars",
    tile_rows: int = pairs.TILE_ROWS,
    component_rows: int = clusters.COMPONENT_ROWS,
) -> DataFrame:
    """Clustered rows: every input column plus ``node`` and ``seed``.

    ``rows``: ord (unique, gives the order), h1, h2 and any others. ``mode='components'``
    joins chains of neighbours instead of forming stars.
    """
    known = rows.dropna(subset=["h1", "h2"])
    nodes, members = pairs.collapse_copies(known, ["h1", "h2"], min_size)
    links, crowd = near_links(nodes, max_distance(similarity), tile_rows)
    weights = nodes.select("node", "weight")
    if mode == "stars":
        assigned = clusters.star_clusters(links, weights, min_size, crowd, component_rows)
    else:
        assigned = component_clusters(links, crowd, weights, min_size)
    return clusters.expand(members, assigned)


def component_clusters(
    links: DataFrame, crowd: DataFrame | None, weights: DataFrame, min_size: int
) -> DataFrame:
    """Connected components of at least ``min_size`` weight: columns node, seed."""
    if crowd is not None:
        lead = crowd.groupBy("clique").agg(F.min("node").alias("a"))
        spokes = crowd.join(lead, "clique").where("node <> a").select("a", F.col("node").alias("b"))
        links = links.unionByName(spokes).distinct()
    labels = clusters.connected(links)
    alone = weights.where("weight > 1").join(labels, "node", "left_anti").select("node", F.col("node").alias("seed"))
    every = checkpointed(labels.select("node", "seed").unionByName(alone))
    sizes = every.join(weights, "node").groupBy("seed").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_size)
    return lookup_join(every, sizes.select("seed"), ["seed"], "inner")


def cluster_summary(clustered: DataFrame, population: int, similarity: float = 0.92) -> DataFrame:
    """One row per cluster: id, seed, size, number of sources, flooding flag and risk.

    ``clustered`` needs ``seed`` and ``source_id``. Cluster numbers follow seed order.
    """
    sizes = clustered.groupBy("seed").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.count_distinct("source_id").alias("sources")
    )
    flooding = (F.col("cluster_size") >= 4) | (F.col("cluster_size") / max(1, population) > 0.08)
    numbered = ordered_scan(checkpointed(sizes), [], "seed", index="_i")
    return numbered.select(
        F.format_string("DUP-CLUSTER-%03d", F.col("_i") + 1).alias("cluster_id"),
        "seed",
        "cluster_size",
        F.lit(round(1.0 - max_distance(similarity) / 64.0, 3)).alias("similarity"),
        "sources",
        flooding.alias("is_flooding"),
        F.when(flooding, "HIGH").when(F.col("cluster_size") >= 3, "MEDIUM").otherwise("LOW").alias("risk"),
    )


def cluster_sources(clustered: DataFrame) -> DataFrame:
    """Sources of each cluster, one row each."""
    return clustered.groupBy("seed", "source_id").agg(F.count(F.lit(1)).alias("samples"))
