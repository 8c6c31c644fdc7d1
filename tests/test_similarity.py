"""Similarity joins and clustering against sequential loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import duplicates, knn, labels, outliers, patches
from assaykit.operators.clusters import star_clusters
from assaykit.plans.registry import Tables
from assaykit.plans.similarity_queries import (
    _quadrants, cluster_sources, near_duplicate_clusters, near_duplicate_components, near_duplicate_summary,
)


def _hamming(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _stars(order, near, min_size):
    seed_of = {}
    for i, node in enumerate(order):
        if node in seed_of:
            continue
        group = [node] + [m for m in order[i + 1 :] if m not in seed_of and near(node, m)]
        if len(group) >= min_size:
            seed_of.update(dict.fromkeys(group, node))
    return seed_of


def _hash_rows(seed, n=120):
    rnd = random.Random(seed)
    base = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(4)]
    rows = {}
    for o in range(n):
        p, q = rnd.choice(base) if rnd.random() < 0.85 else (rnd.getrandbits(64), rnd.getrandbits(64))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
            p ^= 1 << rnd.randrange(64)
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            q ^= 1 << rnd.randrange(64)
        rows[o] = (p, q)
    return rows


# tile_rows=8 makes almost every key crowded; component_rows=0 settles every component in fronts
@pytest.mark.parametrize("seed,min_size,tile_rows,component_rows", [(1, 2, 4000, 50_000), (2, 3, 4000, 0), (3, 2, 8, 0), (4, 4, 8, 50_000)])
def test_near_duplicates_match_loop(spark, seed, min_size, tile_rows, component_rows):
    rows = _hash_rows(seed)
    df = spark.createDataFrame([(o, _signed(p), _signed(q)) for o, (p, q) in rows.items()], "ord BIGINT, h1 BIGINT, h2 BIGINT")
    got = duplicates.near_duplicates(df, 0.92, min_size, tile_rows=tile_rows, component_rows=component_rows)
    near = lambda a, b: _hamming(rows[a][0], rows[b][0]) <= 5 and _hamming(rows[a][1], rows[b][1]) <= 5
    assert {r["ord"]: r["seed"] for r in got.collect()} == _stars(sorted(rows), near, min_size)


def test_exploded_keys_are_not_broadcast(spark):
    """Rows meet on 36 keys each, which the optimiser counts as one: a broadcast would send all of them to the driver."""
    hashes = [F.xxhash64("id", F.lit(i)).alias(f"h{i}") for i in (1, 2)]
    nodes = duplicates.checkpointed(spark.range(2_000).select(F.col("id").alias("node"), *hashes))
    links, members = duplicates.near_links(nodes, 5)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert members is None and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_of_one_number_stay_apart(spark, folder):
    """Beyond 100 000 embeddings, planted copies of one row carry the numbers of another and of its copies."""
    vectors = np.random.default_rng(3).normal(size=(2, 64)).tolist()
    rows = [(25, vectors[0]), (100_025, vectors[1])]
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").write.parquet(f"{folder}/embeddings.parquet")
    t = Tables(spark, folder)
    groups = sorted((v + c * 100_000, v) for v, _ in rows for c in range(5))
    assert sorted(tuple(r) for r in near_duplicate_clusters(t).collect()) == groups
    assert sorted(tuple(r) for r in near_duplicate_components(t).collect()) == groups
    assert sorted((r["seed"], r["cluster_size"]) for r in near_duplicate_summary(t).collect()) == [(25, 5), (100_025, 5)]
    assert sorted({r["seed"] for r in cluster_sources(t).collect()}) == [25, 100_025]


def test_identical_flood_is_one_cluster(spark):
    df = spark.range(20_000).select(F.col("id").alias("ord"), F.lit(7).cast("long").alias("h1"), F.lit(9).cast("long").alias("h2"), F.lit("s").alias("source_id"))
    clustered = duplicates.near_duplicates(df)
    row = duplicates.cluster_summary(clustered, 20_000).collect()
    assert len(row) == 1 and row[0]["cluster_size"] == 20_000 and row[0]["is_flooding"]


@pytest.mark.parametrize("seed", [1, 2])
def test_star_rounds_on_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)}
    links = spark.createDataFrame(sorted(edges), "a BIGINT, b BIGINT")
    none = spark.createDataFrame([], "node BIGINT, weight BIGINT")
    for min_size in (2, 3):
        got = star_clusters(links, none, min_size, component_rows=0)
        want = _stars(list(range(60)), lambda a, b: (min(a, b), max(a, b)) in edges, min_size)
        assert {r["node"]: r["seed"] for r in got.collect()} == want


@pytest.mark.parametrize("shuffled", [True, False])
def test_long_chains_settle_in_few_rounds(spark, monkeypatch, shuffled):
    from assaykit.operators import clusters

    ids = list(range(5_000))
    if shuffled:
        random.Random(4).shuffle(ids)
    links = spark.createDataFrame([(min(x, y), max(x, y)) for x, y in zip(ids, ids[1:])], "a BIGINT, b BIGINT")
    stored, rounds = clusters.checkpointed, []
    monkeypatch.setattr(clusters, "checkpointed", lambda df: rounds.append(1) or stored(df))
    found = clusters.connected(links).agg(F.count("*"), F.max("seed")).first()
    assert tuple(found) == (5_000, 0) and len(rounds) < 25
    if not shuffled:
        none = spark.createDataFrame([], "node BIGINT, weight BIGINT")
        got = {r["node"]: r["seed"] for r in star_clusters(links, none, 2).collect()}
        assert got == {n: n - n % 2 for n in range(5_000)}


def _weighted_stars(near, weight, min_size):
    """Greedy loop: node -> seed, over (earlier, later) links and node weights."""
    seed_of = {}
    for node in sorted(weight):
        fresh = [m for m in near.get(node, ()) if m not in seed_of]
        if node not in seed_of and weight[node] + sum(weight[m] for m in fresh) >= min_size:
            seed_of.update(dict.fromkeys([node, *fresh], node))
    return seed_of


def _later(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    return near


@pytest.mark.parametrize("order,min_size", [("shuffled", 3), ("ordered", 2), ("both", 3)])
def test_giant_chains_settle_by_pointer_doubling(spark, monkeypatch, order, min_size):
    from assaykit.operators import clusters

    ids = list(range(50_000))
    if order == "shuffled":
        random.Random(4).shuffle(ids)
    elif order == "both":
        # rising to the middle, then falling: two long paths of dependent rows meet
        ids = ids[::2] + ids[1::2][::-1]
    edges = [(min(x, y), max(x, y)) for x, y in zip(ids, ids[1:])]
    heavy = {n: 2 for n in range(0, 50_000, 3)} if order != "ordered" else {}
    links = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    weights = spark.createDataFrame(list(heavy.items()), "node BIGINT, weight BIGINT")
    decide, double, rounds = clusters._decide, clusters.checkpointed, []
    monkeypatch.setattr(clusters, "_decide", lambda *a: rounds.append("decide") or decide(*a))
    monkeypatch.setattr(clusters, "connected", lambda e: stand_in(e))

    def stand_in(edges):
        # one component; the rounds of ``connected`` have their own test
        nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
        return nodes.select("node", F.lit(0).cast("long").alias("seed"))

    monkeypatch.setattr(clusters, "checkpointed", lambda df: rounds.append("stored") or double(df))
    got = {r["node"]: r["seed"] for r in star_clusters(links, weights, min_size, component_rows=1).collect()}
    assert got == _weighted_stars(_later(edges), {n: heavy.get(n, 1) for n in range(50_000)}, min_size)
    assert rounds.count("decide") <= 8 and len(rounds) < 80, (rounds.count("decide"), len(rounds))


@pytest.mark.parametrize("seed,min_size", [(1, 2), (3, 4)])
def test_stars_by_joins_with_weights_and_cliques(spark, seed, min_size):
    """Weighted nodes, sparse links and overlapping cliques, all by joins, against the loop."""
    rnd = random.Random(seed)
    weight = {n: rnd.choice([1, 1, 1, 2, 4]) for n in range(80)}
    edges = {tuple(sorted(rnd.sample(range(80), 2))) for _ in range(70)}
    cliques = [sorted(rnd.sample(range(80), rnd.randint(2, 7))) for _ in range(8)]
    inside = {(a, b) for c in cliques for i, a in enumerate(c) for b in c[i + 1 :]}
    members = spark.createDataFrame([(100 + i, n) for i, c in enumerate(cliques) for n in c], "clique BIGINT, node BIGINT")
    links = spark.createDataFrame(sorted(edges), "a BIGINT, b BIGINT")
    weights = spark.createDataFrame(list(weight.items()), "node BIGINT, weight BIGINT")
    linked = {n for e in edges | inside for n in e}
    want = _weighted_stars(_later(edges | inside), weight, min_size)
    got = {r["node"]: r["seed"] for r in star_clusters(links, weights, min_size, members, component_rows=0).collect()}
    assert got == {n: s for n, s in want.items() if n in linked or weight[n] >= min_size}
    by_tasks = {r["node"]: r["seed"] for r in star_clusters(links, weights, min_size, members).collect()}
    assert by_tasks == got


def test_lookup_is_broadcast_by_bytes(spark):
    from assaykit.operators.skew import lookup_join

    big = spark.range(10).withColumnRenamed("id", "k")
    wide = spark.range(150_000).select(F.col("id").alias("k"), *[F.rand().alias(f"c{i}") for i in range(300)])
    small = spark.range(100).withColumnRenamed("id", "k")
    hints = lambda t: lookup_join(big, t, ["k"])._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hints(small) and "broadcast" not in hints(wide)


def test_hashed_neighbours_are_found_with_little_work(spark, monkeypatch):
    from assaykit.operators import knn

    monkeypatch.setattr(knn, "BUCKET_ROWS", 60)
    compared, nearest = spark.sparkContext.accumulator(0), knn._nearest

    def counting(left, right, keep):
        compared.add(len(left) * len(right))
        return nearest(left, right, keep)

    monkeypatch.setattr(knn, "_nearest", counting)
    monkeypatch.setattr(knn._hashed, "__defaults__", (knn.HASH_TABLES, 60))
    work = {}
    for families in (200, 800):
        rng = np.random.default_rng(2)
        centre = np.repeat(rng.normal(size=(families, 32)), 6, axis=0)
        v = centre + 0.1 * rng.normal(size=centre.shape)
        df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in enumerate(v)], "id BIGINT, v ARRAY<DOUBLE>")
        before = compared.value
        found = knn.nearest_neighbours(df, "id", "v", 5, standardise=False).collect()
        work[families] = compared.value - before
        hits = sum(r["id"] // 6 == r["neighbour"] // 6 for r in found)
        assert hits / (families * 30) >= 0.95
    assert work[800] < work[200] * 4**1.3


def test_rows_of_buckets_are_not_broadcast(spark):
    """A point has a row per bucket and tile; they go to its vector by a merge join, whatever the optimiser takes them for."""
    points = duplicates.checkpointed(spark.range(500).select(F.col("id").alias("pid"), F.array(F.sin("id"), F.cos("id")).alias("vec")))
    placed = duplicates.checkpointed(knn._placed(points, 1, 0, 2, 100).withColumn("asks", F.lit(True)))
    plan = knn._met(placed, points, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [pid" in plan


def test_hashed_neighbours_that_are_not_close(spark, monkeypatch):
    monkeypatch.setattr(knn._hashed, "__defaults__", (knn.HASH_TABLES, 10))
    rng = np.random.default_rng(4)
    # neighbours at cosines around 0.7, and rows with nothing near
    v = np.repeat(rng.normal(size=(150, 24)), 8, axis=0) + 0.65 * rng.normal(size=(1200, 24))
    v[::40] = rng.normal(size=(30, 24))
    df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in enumerate(v)], "id BIGINT, v ARRAY<DOUBLE>")
    found = {(r["id"], r["neighbour"]) for r in knn.nearest_neighbours(df, "id", "v", 5, standardise=False).collect()}
    true = {(a, b) for a, b, _ in _knn_loop(list(range(1200)), v, 5)}
    lone = set(range(0, 1200, 40))
    assert len(found) == 6000 and len(found & true) / len(true) >= 0.95
    assert {p for p in found if p[0] in lone} == {p for p in true if p[0] in lone}


def test_tables_follow_the_row_count():
    for rows in (10**4, 10**6, 3 * 10**7):
        bits = int(np.ceil(np.log2(rows / knn.BUCKET_ROWS)))
        meet = (1 - np.arccos(0.8) / np.pi) ** bits
        assert 1 - (1 - meet) ** knn._tables(bits, knn.HASH_TABLES) >= 0.95


def test_rows_are_sent_once_to_a_bin_of_cells():
    """Whole vectors far from each other ask nearly all cells, but go once to each bin, a bounded number at a time."""
    import pandas as pd

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(2_500, 48))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    gaps = knn._distances(vectors, vectors[:50])
    cell = gaps.argmin(axis=1)
    cells = [{"cell": c, "n": int((cell == c).sum()), "radius": gaps[cell == c, c].max()} for c in range(50)]
    shape, ways = knn._binned(cells, vectors[:50], 100)
    bins = {b for _, bins in shape for b in bins}
    pdf = pd.DataFrame({"pid": range(2_500), "vec": list(vectors), "bound": 1.2})
    sent = asked = 0
    for part in knn._slices(iter([pdf])):
        assert len(part) <= knn.ROUTED_ROWS
        for _, rows, _, which in knn._ways(part, *ways):
            sent, asked = sent + len(rows), asked + which.sum()
    assert len(bins) <= 8 and sent <= 2_500 * len(bins) and asked > 5 * sent


def test_rows_with_near_neighbours_stay_in_the_first_tables(spark, monkeypatch):
    """Copies are settled by a fixed number of tables, however many the row count asks for."""
    sent, nearest = spark.sparkContext.accumulator(0), knn._nearest

    def counting(queries, targets, keep):
        sent.add(len(targets))
        return nearest(queries, targets, keep)

    monkeypatch.setattr(knn, "_nearest", counting)
    monkeypatch.setattr(knn._hashed, "__defaults__", (knn.HASH_TABLES, 10))
    v = np.repeat(np.random.default_rng(5).normal(size=(100, 24)), 6, axis=0)
    v = v * (1 + 1e-4 * np.random.default_rng(6).normal(size=v.shape))
    df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in enumerate(v)], "id BIGINT, v ARRAY<DOUBLE>")
    found = knn.nearest_neighbours(df, "id", "v", 5, standardise=False).collect()
    assert len(found) == 3_000 and all(r["id"] // 6 == r["neighbour"] // 6 for r in found)
    assert sent.value == 600 * knn.FIRST_TABLES < 600 * knn.HASH_TABLES


def _knn_loop(ids, vectors, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    gaps = np.round(1.0 - unit @ unit.T, 12)
    out = set()
    for i, own in enumerate(ids):
        near = sorted((gaps[i, j], other) for j, other in enumerate(ids) if other != own)[:k]
        out.update((own, other, rank) for rank, (_, other) in enumerate(near, start=1))
    return out


@pytest.mark.parametrize("block_rows,pivots", [(4000, 2048), (7, 5)])
def test_neighbours_match_brute_force(spark, block_rows, pivots):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 4))
    vectors[50:80] = vectors[50]  # a group of copies
    ids = [int(i) for i in rng.permutation(150)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "id BIGINT, v ARRAY<DOUBLE>")
    got = knn.nearest_neighbours(df, "id", "v", 5, block_rows, pivots, standardise=False, method="exact")
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == _knn_loop(ids, vectors, 5)


def test_label_suspects_find_planted(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    found = labels.label_suspects(knn.labelled_neighbours(_quadrants(t), "vec_id", "features", "label", method="exact"))
    planted = {r["vec_id"] for r in t.embeddings.where("vec_id % 17 = 0").select("vec_id").collect()}
    assert planted <= {r["id"] for r in found.collect()}


def test_few_rows_have_no_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "a") for i in range(7)], "id BIGINT, v ARRAY<DOUBLE>, l STRING")
    assert knn.labelled_neighbours(df, "id", "v", "l").count() == 0


def test_unlabelled_votes_but_is_not_flagged(spark):
    rows = [(1, "unlabelled", r, "a") for r in range(1, 6)] + [(2, "b", r, "unlabelled") for r in range(1, 6)]
    found = labels.label_suspects(spark.createDataFrame(rows, "id BIGINT, label STRING, rank INT, neighbour_label STRING")).collect()
    assert [(r["id"], r["consensus_neighbor_label"], r["confidence"]) for r in found] == [(2, "unlabelled", "HIGH")]


def test_vote_tie_goes_to_nearest(spark):
    rows = [(1, "c", 1, "b"), (1, "c", 2, "a"), (1, "c", 3, "a"), (1, "c", 4, "b"), (1, "c", 5, "c")]
    got = labels.neighbour_consensus(spark.createDataFrame(rows, "id BIGINT, label STRING, rank INT, neighbour_label STRING")).first()
    assert (got["consensus"], got["own_votes"], got["k"]) == ("b", 1, 5)


@pytest.mark.parametrize("dims,tile_rows", [(12, 4000), (40, 4000), (40, 10), (12, 10)])
def test_patch_clusters_match_loop(spark, dims, tile_rows):
    rng = np.random.default_rng(dims)
    rows, order = [], 0
    for region in ("TL", "C"):
        centres = rng.normal(size=(4, dims))
        for _ in range(60):
            v = centres[rng.integers(4)] + rng.normal(scale=rng.choice([0.0, 0.03, 0.1, 1.0]), size=dims)
            rows.append((order, f"s{order}", region, str(rng.integers(3)), v / np.linalg.norm(v)))
            order += 1
    df = spark.createDataFrame(
        [(o, s, r, l, [float(x) for x in v]) for o, s, r, l, v in rows], "ord BIGINT, sample_id STRING, region STRING, label STRING, vec ARRAY<DOUBLE>")
    got = patches.patch_clusters(df, population=100, tile_rows=tile_rows, component_rows=0)
    by = {o: (r, v) for o, _, r, _, v in rows}
    near = lambda a, b: by[a][0] == by[b][0] and by[a][1] @ by[b][1] >= 0.98
    stars = _stars(sorted(by), near, 3)
    label = {o: l for o, _, _, l, _ in rows}
    keep = {}
    for seed in set(stars.values()):
        members = [o for o, s in stars.items() if s == seed]
        single = by[seed][0] == "C" and len({label[m] for m in members}) == 1
        if len(members) <= 25 and not single:
            keep.update(dict.fromkeys(members, seed))
    assert {r["ord"]: r["seed"] for r in got.collect()} == keep


@pytest.mark.parametrize("dims, similarity", [(3, 0.9), (16, 0.98), (30, 0.8)])
def test_block_index_meets_all_near_pairs(dims, similarity):
    """Whatever blocks are chosen, near pairs share a cell: one row's own cell, touched by the other."""
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(150, dims)) / np.arange(1, dims + 1) ** 0.5
    rows = np.concatenate([base, base + rng.normal(scale=0.08, size=base.shape)])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    radius = (2 - 2 * similarity) ** 0.5
    a, b = np.nonzero(np.triu(rows @ rows.T >= similarity, 1))
    assert len(a) > 20
    basis = patches.block_index(rows, radius, 1_000).basis
    for blocks, axes in [(1, 1), (1, 3), (basis.shape[1] // 2, 2), (basis.shape[1] // 3, 3)]:
        index = patches.BlockIndex(basis, blocks, axes, radius)
        own, cells = {}, {}
        for row, block, cell in index.touched(rows @ basis):
            for i, (r, k, c) in enumerate(zip(row, block, map(tuple, cell))):
                cells.setdefault((k, c), set()).add(r)
                if i < len(rows):
                    own[r, k] = c
        assert all(any(y in cells[k, own[x, k]] for k in range(blocks)) for x, y in zip(a, b))


def test_patch_candidates_follow_the_true_pairs(spark, monkeypatch):
    """Rows with one near copy each: pairs whose vectors are fetched grow with the rows, not their square."""
    counts, shares = [], []
    near_pairs, chosen = patches.pairs.near_pairs, patches.block_index
    monkeypatch.setattr(patches.pairs, "near_pairs", lambda *a: counts.append(near_pairs(*a).distinct().count()) or near_pairs(*a))
    monkeypatch.setattr(patches, "block_index", lambda s, r, n: shares.append(chosen(s, r, n).share_met(s[:400] @ chosen(s, r, n).basis)[1]) or chosen(s, r, n))
    for n in (1_000, 4_000):
        rng = np.random.default_rng(n)
        rows = rng.normal(size=(n // 2, 20))
        rows = np.concatenate([rows, rows + rng.normal(scale=0.01, size=rows.shape)])
        rows /= np.linalg.norm(rows, axis=1)[:, None]
        df = spark.createDataFrame([(i, "TL", v.tolist()) for i, v in enumerate(rows)], "node BIGINT, region STRING, vec ARRAY<DOUBLE>")
        links = {tuple(r) for r in patches.similar_links(df)[0].collect()}
        assert links == {(i, i + n // 2) for i in range(n // 2)}
    assert counts[1] < counts[0] * 4**1.3 and shares[1] < 0.7 * shares[0]


@pytest.mark.parametrize("expected", [50_000, 600_000])
def test_patches_go_to_few_cells(spark, expected):
    """However many rows are expected, a row is stored in few cells, and near pairs still meet."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 16))
    rows = np.concatenate([rows, rows + rng.normal(scale=0.02, size=rows.shape)])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, "TL", v.tolist()) for i, v in enumerate(rows)], "node BIGINT, region STRING, vec ARRAY<DOUBLE>")
    reach = patches.placed(df, patches.block_index(rows, 0.2, expected)).select("key", "node", "own").collect()
    assert len(reach) <= 14 * len(rows)
    cells, own = {}, {}
    for key, node, mine in reach:
        cells.setdefault(node, set()).add(key)
        if mine:
            own.setdefault(node, set()).add(key)
    near = np.argwhere(np.triu(rows @ rows.T >= 0.98, 1))
    assert len(near) >= 400 and all(own[a] & cells[b] or own[b] & cells[a] for a, b in near)


def test_links_inside_cliques_are_listed(spark):
    """Crowded cells keep near rows as cliques: with them every link is there once."""
    rng = np.random.default_rng(8)
    rows = np.concatenate([rng.normal(size=6) + 0.1 * rng.normal(size=(40, 6)), rng.normal(size=(40, 6))])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, "TL", v.tolist()) for i, v in enumerate(rows)], "node BIGINT, region STRING, vec ARRAY<DOUBLE>")
    links, members = patches.similar_links(df, 0.8, tile_rows=10)
    found = [tuple(r) for r in patches.pairs.all_links(links, members).collect()]
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(rows @ rows.T >= 0.8, 1)))}
    assert members is not None and links.count() < len(true)
    assert len(found) == len(true) and set(found) == true


def test_every_cluster_of_a_sample_is_a_suspect_row(spark):
    clustered = spark.createDataFrame([("s1", 0), ("s2", 0), ("s1", 7)], "sample_id STRING, seed BIGINT")
    summary = spark.createDataFrame(
        [(0, "TL", "a", 0.92, 2), (7, "BR", "b", 0.78, 1)], "seed BIGINT, location STRING, associated_class STRING, confidence DOUBLE, cluster_size BIGINT")
    samples = spark.createDataFrame([("s1", "f", "b"), ("s2", "f", "b")], "sample_id STRING, source_id STRING, batch_id STRING")
    last, every = {("s1", "BR"), ("s2", "TL")}, [("s1", "BR"), ("s1", "TL"), ("s2", "TL")]
    kept = patches.patch_suspects(clustered, summary).collect()
    assert {tuple(r)[:2] for r in kept} == last and len(kept) == 2
    assert sorted(tuple(r)[:2] for r in patches.patch_suspects(clustered, summary, every=True).collect()) == every
    assert sorted(tuple(r)[:2] for r in patches.suspect_details(clustered, summary, samples, 4, every=True).collect()) == every


def test_isolation_forest_properties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300, [9.0] * 6)]
    df = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>")
    scored = outliers.scored_outliers(df, "id", "v").collect()
    assert max(scored, key=lambda r: r["anomaly_score"])["id"] == 300
    assert min(r["anomaly_score"] for r in scored) == 0.0 and max(r["anomaly_score"] for r in scored) == 1.0
    again = outliers.scored_outliers(df.repartition(7), "id", "v").collect()
    assert sorted(map(tuple, scored)) == sorted(map(tuple, again))
    flagged = outliers.outliers(df, "id", "v").collect()
    assert 300 in {r["id"] for r in flagged}
    assert outliers.outliers(df.where("id < 4"), "id", "v").count() == 0


@pytest.mark.parametrize("parts, rows", [(1, 900), (6, 900), (3, 20)])
def test_every_row_competes_for_every_tree(spark, parts, rows):
    df = spark.range(rows).select("id", F.array(F.col("id").cast("double")).alias("v")).repartition(parts)
    found = outliers.forest_sample(df, "id", "v", trees=12, seed=3, tree_rows=40).collect()
    hashes = {r["h"]: r["id"] for r in df.select("id", F.xxhash64("id", F.lit(3)).alias("h")).collect()}
    lists = outliers.LowestPriorities(12, rows)
    lists.offer(np.array(list(hashes), dtype=np.int64).view(np.uint64), 0)
    names = np.array(list(hashes.values()))
    for tree in range(12):
        wanted = [float(n) for n in names[lists.row[tree]][:40]]
        assert [r["x"][0] for r in sorted((r for r in found if r["tree"] == tree), key=lambda r: r["_n"])] == wanted
    assert len(found) == 12 * min(40, rows)
    # over all trees the sample reaches far beyond a pool of one tree's size
    assert rows < 100 or len({r["x"][0] for r in found}) > 300


def test_planted_outliers_rank_first(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    stretched = F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: x * 5)).otherwise(F.col("embedding"))
    scored = outliers.scored_outliers(t.embeddings.select("vec_id", stretched.alias("f")), "vec_id", "f")
    top = scored.orderBy(F.col("anomaly_score").desc()).limit(10).collect()
    assert all(r["vec_id"] % 50 == 0 for r in top)
