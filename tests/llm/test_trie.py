"""The prefix trie against plain dictionaries of whole prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from assaykit.llm import trie

COLUMNS = "conv_id long, turn int, role string, text string, depth string, n_convs int, _part int, d1 string"


def plain_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows without ties in turn."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for head, ids in members.items():
        below = [p for p in members if p[: len(head)] == head]
        leaf = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(head))
        out.append((
            min(ids), len(head), min(members[head[:-1]]) if head else None, len(ids),
            sum(len(p) == len(head) + 1 for p in below), len(leaf),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed, hosts=3, per=12):
    r, rows = random.Random(seed), []
    stock = [("user", t) for t in ("", "hä?", "one two", "x" * 40)] + [("", "a"), (None, None), ("user", None)]
    for host in range(hosts):
        for c in r.sample(range(100), per) + [0] * (host != 1):
            n = r.choice([0, 1, 2, 4, 7, 11])
            turns = [r.choice(stock[:3] if r.random() < 0.7 else stock) for _ in range(n)]
            numbers = r.sample([None, *range(-3, 40)], n)
            rows += [(host * 100 + c, t, *x) for t, x in zip(numbers, turns)]
    return list({(c, t): (c, t, *x) for c, t, *x in rows}.values())


def nodes(spark, rows, **options):
    table = spark.createDataFrame([(*r, "own", 5, 6, "x") for r in rows], COLUMNS).repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(table, **options).collect()), key=repr)


def test_slots_are_minimal_and_perfect():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1_000, 20_000):
        first = r.integers(0, 1 << 63, n, dtype=np.uint64)
        slots = trie.perfect_slots(first % np.uint64(50), first)
        assert sorted(slots.tolist()) == list(range(n))


@pytest.mark.parametrize("options", [{}, {"band": 2, "shard_rows": 7, "chunk": 2}])
def test_trie_equals_plain_prefixes(spark, options):
    rows = conversations(3) + [(None, 1, "user", "no conversation")]
    rows += [(700 + c, t, "user", f"turn {t // 2}") for c in range(15) for t in range(c % 4 + 7)]
    assert nodes(spark, rows, **options) == plain_trie(rows)


def test_one_long_conversation(spark):
    """Many turns of one id, over several partitions and bands, ties in turn included."""
    rows = [(900, t, "user", f"t{t % 7}") for t in range(3_000)] + [(900 + c, t, "user", f"t{t % 7}") for c in (1, 2) for t in range(40 * c)]
    found = nodes(spark, rows, band=64, shard_rows=500)
    assert len(found) == 3_001 and [f[1] for f in sorted(found, key=lambda f: f[1])] == list(range(3_001))
    by_depth = {f[1]: f for f in found}
    assert by_depth[0][3] == 3 and by_depth[0][5] == 1
    assert by_depth[0][6] == sum((2 if d <= 40 else 1) * len(f"t{(d - 1) % 7}") for d in range(1, 81))
    ties = [(900, None, "user", "same")] * 500 + [(900, 5, "user", "late")] * 2
    found = nodes(spark, ties)
    assert len(found) == 503 and all(f[0] == 900 and f[3] == 1 for f in found)


def test_no_conversations(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "x")]) == []
