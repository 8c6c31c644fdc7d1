"""Greedy star clusters over a neighbour graph.

Rows are taken in order. A row not yet taken starts a cluster of itself and every later
neighbour not yet taken; the cluster counts if its weight reaches the minimum, otherwise
the row is passed over. That is sequential, but only within a connected component: the
components are found first, in few rounds, and then many of them are settled per task, in
order. A component too large for one task is settled by joins. There every undecided row
points to its earliest undecided neighbour, and whether it becomes a seed is a function of
whether that one does: the opposite, never, or not known yet. Pointer doubling composes
these functions along whole chains of rows, so a chain of any length takes a round of as
many joins as its length has binary digits. Only rows with several undecided earlier
neighbours wait for a later round; an order in which those follow each other throughout
still takes a round for each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

#: Links and clique members of the largest component that one task settles, and the
#: number of rows of small components that are dealt to one task.
COMPONENT_ROWS = 500_000
TASK_ROWS = 50_000


def star_clusters(
    links: DataFrame,
    weights: DataFrame,
    min_size: int,
    members: DataFrame | None = None,
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """Assign nodes to cluster seeds: columns node, seed (a seed is its own).

    links: (a, b) with a < b, each pair once; weights: (node, weight) of the nodes with
    weight above 1; members: optional (clique, node), all members mutual neighbours.
    Components with more than ``component_rows`` rows go by joins, the others by tasks.
    """
    heavy = weights.where("weight > 1").select("node", "weight")
    live = _weigh(_weigh(links, heavy, "a", "wa"), heavy, "b", "wb").withColumn("a_seed", F.lit(False))
    live, crowd = checkpointed(live), None
    edges = live.select("a", "b")
    if members is not None:
        crowd = checkpointed(_weigh(members, heavy, "node", "w").withColumn("seed", F.lit(False)))
        edges = edges.unionByName(_lead_edges(crowd).select("a", "b"))
    labels = connected(edges).select("node", F.col("seed").alias("component"))
    labels = checkpointed(labels)
    live = live.join(labels.withColumnRenamed("node", "a"), "a")
    rows = live.select("component")
    if crowd is not None:
        crowd = crowd.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = rows.unionAll(crowd.select("component"))
    sizes = checkpointed(rows.groupBy("component").count())
    large = sizes.where(F.col("count") > component_rows).select("component")
    n_small, n_large = sizes.agg(
        F.sum(F.when(F.col("count") <= component_rows, F.col("count"))), F.count_if(F.col("count") > component_rows)
    ).first()
    settled = []
    if n_small:
        dealt = F.pmod(F.xxhash64("component"), F.lit(-(-n_small // TASK_ROWS)))
        small = [None if part is None else _without(part, large, n_large) for part in (live, crowd)]
        settled.append(_in_order(*small, min_size, dealt))
    if n_large:
        big = [None if part is None else part.join(large, "component", "left_semi").drop("component") for part in (live, crowd)]
        settled += _by_fronts(*map(_stored, big), min_size)
    own = F.col("node").alias("seed")
    if not settled:
        return heavy.where(F.col("weight") >= min_size).select("node", own)
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    # a seed may be reported again by the last step
    found = checkpointed(found.distinct())
    # a heavy node nobody claimed is a cluster on its own
    alone = heavy.where(F.col("weight") >= min_size).join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", own))


def _stored(part: DataFrame | None) -> DataFrame | None:
    return None if part is None else checkpointed(part)


def _without(part: DataFrame, large: DataFrame, n_large: int) -> DataFrame:
    return part.join(large, "component", "left_anti") if n_large else part


def _by_fronts(live: DataFrame, crowd: DataFrame | None, min_size: int) -> list[DataFrame]:
    """Settle components of any size, whole trees of dependent rows per round."""
    settled = []
    while True:
        edges = live.withColumn("hidden", F.lit(False))
        if crowd is not None:
            # members after the earliest have neighbours that these links don't show
            shown = _lead_edges(crowd).withColumn("hidden", F.lit(True))
            merged = [F.max(c).alias(c) for c in ("wa", "wb", "a_seed", "hidden")]
            edges = checkpointed(edges.unionByName(shown).groupBy("a", "b").agg(*merged))
        if edges.isEmpty():
            return settled
        updates = checkpointed(_decide(edges, min_size))
        settled.append(updates.where("state IN ('claimed', 'seed')").select("node", "seed"))
        live = checkpointed(_advance(live, updates))
        if crowd is not None:
            crowd = checkpointed(_advance_crowd(crowd, updates))


def _weigh(rows: DataFrame, heavy: DataFrame, node: str, out: str) -> DataFrame:
    renamed = heavy.select(F.col("node").alias(node), F.col("weight").alias(out))
    joined = lookup_join(rows, renamed, [node])
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(1).cast("long")))


def _lead_edges(crowd: DataFrame) -> DataFrame:
    """Links from the earliest live member of each clique to the others: all a round needs."""
    leads = checkpointed(crowd.groupBy("clique").agg(F.min(F.struct("node", "w", "seed")).alias("lead")))
    return (
        lookup_join(crowd, leads, ["clique"], "inner")
        .where(F.col("node") > F.col("lead.node"))
        .select(
            F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.w").alias("wa"),
            F.col("w").alias("wb"), F.col("lead.seed").alias("a_seed"),
        )
    )


#: What is known of a row: no seed, a seed, or neither yet.
NO, YES, OPEN = 0, 1, 2


def _decide(edges: DataFrame, min_size: int) -> DataFrame:
    """(node, state, seed) for every node about which this round finds something.

    States: seed, claimed, out (neither), and barred for a node that can't be a seed but
    may be claimed by one of several neighbours still undecided.
    """
    rows = _resolved(checkpointed(_pointers(edges, min_size)))
    values = rows.select(F.col("node").alias("first"), F.col("f0").alias("first_is"))
    # nodes without earlier neighbours have nothing to look up
    top, below = rows.where("first IS NULL"), rows.where("first IS NOT NULL")
    joined = lookup_join(below, values, ["first"]).unionByName(top.withColumn("first_is", F.lit(NO)))
    state = (
        F.when(F.col("first_seed") | (F.col("first_is") == YES), "claimed")
        .when(F.col("f0") == YES, "seed")
        .when((F.col("f0") == NO) & (F.col("n_in") <= 1) & ~F.col("hidden") & (F.col("first_is") == NO), "out")
        .when(F.col("f0") == NO, "barred")
    )
    decided = joined.withColumn("state", state).where("state IS NOT NULL")
    return decided.select("node", "state", F.when(F.col("state") == "claimed", F.col("first")).otherwise(F.col("node")).alias("seed"))


def _pointers(edges: DataFrame, min_size: int) -> DataFrame:
    """Undecided nodes with their earliest neighbour and what they are if it is none (f0) or a seed (f1).

    ``up`` is the node that f0 and f1 depend on, null where they are the same.
    """
    into = edges.groupBy(F.col("b").alias("node")).agg(
        F.min(F.struct("a", "a_seed")).alias("f"), F.max("wb").alias("w_in"), F.count(F.lit(1)).alias("n_in"),
        F.max("a_seed").alias("reached"), F.max("hidden").alias("hidden"),
    )
    out = edges.where("NOT a_seed").groupBy(F.col("a").alias("node")).agg(
        F.max("wa").alias("w_out"), F.sum("wb").alias("most")
    )
    # later neighbours that nothing earlier than the node can take
    sure = into.where("NOT f.a_seed").groupBy(F.col("f.a").alias("node")).agg(F.sum("w_in").alias("sure"))
    joined = into.join(out, "node", "full").join(sure, "node", "left").fillna(0, ["most", "sure", "n_in"])
    joined = joined.fillna(False, ["reached", "hidden"]).withColumn("w", F.coalesce("w_in", "w_out"))
    never = F.col("reached") | (~F.col("hidden") & (F.col("w") + F.col("most") < min_size))
    alone = (F.col("n_in") <= 1) & ~F.col("hidden") & (F.col("w") + F.col("sure") >= min_size)
    f0 = F.when(never, NO).when(alone, YES).otherwise(OPEN)
    root = F.col("n_in") == 0
    return joined.select(
        "node", F.col("f.a").alias("first"), F.coalesce("f.a_seed", F.lit(False)).alias("first_seed"), "n_in", "hidden",
        f0.alias("f0"), F.when(root, f0).otherwise(NO).alias("f1"), F.when(~root & ~never, F.col("f.a")).alias("up"),
    )


def _resolved(rows: DataFrame) -> DataFrame:
    """Pointer doubling: afterwards f0 = f1 says what each node is, by what this round knows."""
    while not rows.where("up IS NOT NULL").isEmpty():
        above = rows.select(F.col("node").alias("up"), F.col("f0").alias("u0"), F.col("f1").alias("u1"), F.col("up").alias("next"))
        joined = lookup_join(rows.where("up IS NOT NULL"), above, ["up"], "inner")

        def through(value: str) -> Column:
            return F.when(F.col(value) == NO, F.col("f0")).when(F.col(value) == YES, F.col("f1")).otherwise(OPEN)

        stepped = joined.withColumns({"f0": through("u0"), "f1": through("u1")}).withColumn(
            "up", F.when(F.col("f0") != F.col("f1"), F.col("next"))
        )
        rows = checkpointed(rows.where("up IS NULL").unionByName(stepped.select(*rows.columns)))
    return rows


def _advance(live: DataFrame, updates: DataFrame) -> DataFrame:
    """Links still undecided, with new seeds marked."""
    on_a = updates.select(F.col("node").alias("a"), F.col("state").alias("sa"))
    on_b = updates.where("state <> 'barred'").select(F.col("node").alias("b"), F.lit(True).alias("gone"))
    joined = lookup_join(lookup_join(live, on_a, ["a"]), on_b, ["b"])
    return joined.where(
        F.col("gone").isNull() & (F.col("sa").isNull() | (F.col("sa") == "seed"))
    ).select("a", "b", "wa", "wb", (F.col("a_seed") | F.col("sa").isNotNull()).alias("a_seed"))


def _advance_crowd(crowd: DataFrame, updates: DataFrame) -> DataFrame:
    known = updates.where("state <> 'barred'").select("node", F.col("state").alias("s"))
    kept = lookup_join(crowd, known, ["node"]).where(F.col("s").isNull() | (F.col("s") == "seed"))
    return kept.select("clique", "node", "w", (F.col("seed") | F.col("s").isNotNull()).alias("seed"))


def _in_order(live: DataFrame, crowd: DataFrame | None, min_size: int, dealt: Column) -> DataFrame:
    """Settle whole components row by row, those of one ``dealt`` number in one task."""
    rows = live.select(
        dealt.alias("g"), F.lit(False).alias("is_crowd"), "a", "b", "wa", "wb", "a_seed"
    )
    if crowd is not None:
        rows = rows.unionByName(
            crowd.select(
                dealt.alias("g"), F.lit(True).alias("is_crowd"), F.col("clique").alias("a"),
                F.col("node").alias("b"), F.lit(1).cast("long").alias("wa"), F.col("w").alias("wb"),
                F.col("seed").alias("a_seed"),
            )
        )

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        later: dict[int, set[int]] = {}
        groups: dict[int, list[int]] = {}
        of_node: dict[int, list[int]] = {}
        weight: dict[int, int] = {}
        fixed: set[int] = set()
        for is_crowd, a, b, wa, wb, seed in zip(
            pdf["is_crowd"], pdf["a"], pdf["b"], pdf["wa"], pdf["wb"], pdf["a_seed"]
        ):
            weight[b] = wb
            if is_crowd:
                groups.setdefault(a, []).append(b)
                of_node.setdefault(b, []).append(a)
                if seed:
                    fixed.add(b)
            else:
                weight[a] = wa
                later.setdefault(a, set()).add(b)
                if seed:
                    fixed.add(a)
        seed_of: dict[int, int] = {}
        for node in sorted(weight):
            if node in seed_of:
                continue
            near = set(later.get(node, ()))
            for group in of_node.get(node, ()):
                near.update(m for m in groups[group] if m > node)
            fresh = [m for m in near if m not in seed_of and m not in fixed]
            if node in fixed or weight[node] + sum(weight[m] for m in fresh) >= min_size:
                seed_of[node] = node
                seed_of.update(dict.fromkeys(fresh, node))
        return pd.DataFrame(
            {"node": pd.Series(list(seed_of), dtype="int64"), "seed": pd.Series(list(seed_of.values()), dtype="int64")}
        )

    return rows.groupBy("g").applyInPandas(settle, "node BIGINT, seed BIGINT")


def expand(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clustered rows with their ``seed``."""
    return lookup_join(members, assigned, ["node"], "inner")


def connected(links: DataFrame) -> DataFrame:
    """Connected components instead of stars: columns node, seed (the lowest node).

    Every link is held as (hi, lo). In turn all links are moved to the lowest neighbour of
    their lower end, then all lower ends of a node are linked to the lowest of them, until
    each component is a star around its lowest node. The number of rounds grows with the
    square of the logarithm of a component's size at most; there is no cap. The lowest
    neighbours are sums per node, so a hub of any degree is one row after map-side combine.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = checkpointed(links.where("a <> b").select(high.alias("hi"), low.alias("lo")).distinct())
    while True:
        lowest = edges.groupBy(F.col("hi").alias("_of")).agg(F.min("lo").alias("_low"))
        moved = edges.join(lowest, F.col("lo") == F.col("_of"), "left").select(
            "hi", F.coalesce("_low", "lo").alias("lo")
        ).distinct()
        lowest = moved.groupBy(F.col("hi").alias("_of")).agg(F.min("lo").alias("_low"))
        met = moved.join(lowest, F.col("hi") == F.col("_of"))
        ends = F.explode(
            F.array(F.struct(F.col("hi"), F.col("_low").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("_low").alias("lo")))
        )
        stepped = met.select(ends.alias("e")).select("e.*").where("hi <> lo").distinct()
        last, edges = edges, checkpointed(stepped)
        if _digest(last) == _digest(edges):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("seed")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("seed")).distinct()
            )


def _digest(edges: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal sets of links."""
    hashed = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashed).first())
