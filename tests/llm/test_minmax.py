"""Min-max near-duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from assaykit.llm import minmax
from plain_texts import near, prose

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UP, UP.lower())))
    return frozenset(" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))) if words else frozenset()


def plain_components(rows):
    """(id, text) rows as [(id, set size, component id)], in the order of rows."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, len(s), smallest.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def test_minima_and_maxima_of_each_permutation():
    hashing, hashes = minmax.MinMax(bands=3), minmax.shingle_hashes(prose(1, 6_000))
    wanted = []
    for times, plus in zip(hashing.times.tolist(), hashing.plus.tolist()):
        image = [(times * h + plus) % (1 << 64) for h in hashes.tolist()]
        wanted += [min(image), max(image)]
    assert hashing.signature(hashes).tolist() == wanted and all(t % 2 for t in hashing.times.tolist())


def test_share_of_equal_values_estimates_similarity():
    hashing, r = minmax.MinMax(bands=400), np.random.default_rng(4)
    common, own = r.integers(0, 1 << 63, 160, dtype=np.uint64), r.integers(0, 1 << 63, 40, dtype=np.uint64)
    one, two = (hashing.signature(np.r_[common, part]) for part in (own[:20], own[20:]))
    assert abs((one == two).mean() - 0.8) < 0.05
    # both ends are unbiased
    assert abs((one == two)[::2].mean() - 0.8) < 0.06 and abs((one == two)[1::2].mean() - 0.8) < 0.06


def test_components_of_edge_documents(edge_docs, edge_rows):
    found = minmax.near_duplicates(edge_docs).collect()
    rows = [(i, t) for i, t, _ in edge_rows]
    wanted = sorted(((i, t, n, c) for (i, t), (_, n, c) in zip(rows, plain_components(rows))), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == wanted
    assert all(r["doc_id"] == r["component_id"] for r in found if r["is_first"])
    assert all(r["is_first"] for r in found if not r["n_shingles"])
    firsts = [r["component_id"] for r in found if r["is_first"] and r["n_shingles"]]
    assert len(firsts) == len(set(firsts))


@pytest.mark.parametrize("tile", [1_000, 3])
def test_links_beyond_the_leader_are_found(spark, tile):
    """Chains and families of unlike members, where one comparison with a leader isn't enough."""
    r, rows = random.Random(8), []
    for family in range(6):
        words = prose(100 + family, 120).split(" ")
        for step in range(12):
            rows.append((len(rows), " ".join(words)))
            for at in r.sample(range(len(words)), 5):
                words[at] = f"w{r.random()}"
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    found = {d["doc_id"]: (d["doc_id"], d["n_shingles"], d["component_id"]) for d in minmax.near_duplicates(docs, tile=tile).collect()}
    assert [found[i] for i, _ in rows] == plain_components(rows)


def test_copies_and_near_copies_of_one_text(spark):
    text = prose(5, 200)
    rows = [(n, text if n % 3 else near(text, n)) for n in range(300)]
    found = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"])
    assert found.columns == ["doc_id", "n_shingles", "component_id", "is_first"]
    assert {r["component_id"] for r in found.collect()} == {0} and found.where("is_first").count() == 1


def test_no_documents(no_docs):
    assert minmax.near_duplicates(no_docs).count() == 0


def test_tallies_bound_what_sets_have_in_common():
    import pandas as pd

    r = np.random.default_rng(6)
    pool = r.integers(0, 1 << 63, 9_000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(r.choice(pool[: 3 * n], n)) for n in (1, 2, 3, 50, 60, 130, 900, 3_000, 3_000)]
    tallies = minmax._Tallies(pd.Series([minmax.tally(s) for s in sets]))
    for k, own in enumerate(sets):
        common = tallies.common(k, np.arange(len(sets)))
        assert all(c >= len(np.intersect1d(own, s)) for c, s in zip(common, sets)) and common[k] == len(own)
