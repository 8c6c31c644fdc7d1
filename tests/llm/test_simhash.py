"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from assaykit.llm import simhash

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UP, UP.lower())))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, max_bits=4):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= max_bits:
                root[find(b)] = find(a)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b C d", "a b c d É ß\x0bF", "x y z " * 4_000, "aAİ k " * 30])
def test_fingerprint_is_the_majority_of_hashes(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_golay_code_is_perfect():
    code = simhash.Golay()
    words = (np.arange(4096) << 11) | code.check
    assert min(int(w).bit_count() for w in words[1:]) == 7
    some = np.random.default_rng(1).integers(0, 1 << 23, 5_000)
    assert (np.bitwise_count(some ^ words[code.index(some)]) <= 3).all()


def test_keys_meet_within_four_bits():
    r, code = random.Random(3), simhash.Golay()
    for n in range(2_000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), n % 5):
            y ^= 1 << b
        keys = [set(simhash.golay_keys(np.array([v], dtype=np.uint64), code)[1].tolist()) for v in (x, y)]
        assert keys[0] & keys[1] and len(keys[0]) <= 33


@pytest.mark.parametrize("tile", [2_000, 12])
def test_links_connect_what_all_pairs_connect(spark, tile):
    r = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(25):
            value = centre
            for b in r.sample(range(64), r.randint(0, 5)):
                value ^= 1 << b
            values.add(value)
    chain = r.getrandbits(64)
    for b in range(0, 64, 4):
        chain ^= 0b1111 << b
        values.add(chain)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "_print long"), tile=tile).collect()
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in map(tuple, found)]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    wanted = plain_components(values)
    for a in values:
        for b in values:
            assert (find(a) == find(b)) == (wanted[a] == wanted[b])


def test_components_of_edge_documents(edge_docs, edge_rows):
    found = simhash.near_duplicates(edge_docs).collect()
    prints = [plain_print(t) for _, t, _ in edge_rows]
    root = plain_components(prints)
    smallest = {}
    for (doc_id, _, _), p in zip(edge_rows, prints):
        if doc_id is not None:
            smallest[root[p]] = min(doc_id, smallest.get(root[p], doc_id))
    wanted = sorted(((i, t, f"{p:016x}", smallest.get(root[p])) for (i, t, _), p in zip(edge_rows, prints)), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["fingerprint"], r["component_id"]) for r in found), key=repr) == wanted
    assert sum(r["is_first"] for r in found) == len(set(root.values()))
    assert all(r["doc_id"] == r["component_id"] for r in found if r["is_first"])


def test_keep_narrows_the_result(edge_docs, no_docs):
    assert simhash.near_duplicates(edge_docs, keep=["doc_id"]).columns == ["doc_id", "fingerprint", "component_id", "is_first"]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_fewer_keys_than_links_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "_print long"), max_bits=5)
