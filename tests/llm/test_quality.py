"""Quality trees and weakly supervised rules."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from assaykit.llm import quality_trees, rules


def junk(text, n):
    kind = n % 3
    words = text.split()
    if kind == 0:
        return " ".join(f"{w}{'#$%&'[k % 4] * 3}" for k, w in enumerate(words))
    if kind == 1:
        return " | ".join(words)
    return " ".join(f"{w.upper()}!!" for w in words)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    vocabulary = ["the", "of", "a", "to"] * 30 + ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(4, 9))) for _ in range(300)]
    docs, labels = [], []
    for n in range(500):
        text = " ".join(r.choice(vocabulary) + (r.choice(".,") if r.random() < 0.1 else "") for _ in range(r.randint(60, 200)))
        good = n % 5 != 3
        docs.append((n, text if good else junk(text, n)))
        if n % 3:
            labels.append((n, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_trees_on_held_out_documents(corpus):
    docs, labels = corpus
    forest = quality_trees.fit(docs, labels)
    rows = docs.select("doc_id", quality_trees.is_held_out(docs.doc_id).alias("h"), quality_trees.score(docs.text, forest).alias("s")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [((r["doc_id"] % 5 != 3), r["s"]) for r in rows if r["h"]]
    assert len(held) > 50 and np.mean([(s >= 0.3) == good for good, s in held]) >= 0.97
    again = docs.repartition(7).select("doc_id", quality_trees.score(docs.text, forest).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {r["doc_id"]: r["s"] for r in again}


def test_held_out_labels_are_never_read(corpus):
    docs, labels = corpus
    held = quality_trees.is_held_out(labels.doc_id)
    flipped = labels.withColumn("quality", (1 - labels.quality) * held.cast("int") + labels.quality * (~held).cast("int"))
    a, b = quality_trees.fit(docs, labels), quality_trees.fit(docs, flipped)
    assert (a.value == b.value).all() and (a.threshold == b.threshold).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 3)), None
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality_trees.train(x, y, trees=12, depth=3)
    for row, score in zip(x[:50], forest.score(x[:50])):
        total = forest.prior
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9


def test_trees_without_labels_or_with_one_class(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for docs, known in ((edge_docs, labels), (edge_docs, labels.limit(0)), (no_docs, labels)):
        forest = quality_trees.fit(docs, known)
        scores = [r[0] for r in docs.select(quality_trees.score(docs.text, forest)).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)


def plain_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    lines = (text or "").split("\n")
    dup = sum(bool(x.strip(" \t\n\x0b\x0c\r")) and x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


@pytest.mark.parametrize("text", [None, "", "a b c a b c a", "a a a a", "é# é# é#\né# é# é#\n \n\n", "x y z x y z x y\nx y z", "one|two <b>"])
def test_counts(text):
    assert rules.measure(text)[:5] == plain_counts(text)


def test_rules_drop_junk_and_keep_clean_documents(corpus):
    docs, _ = corpus
    rows = rules.judge(docs).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 3) for r in rows if not r["base_failed"])
    for r in rows:
        n, repeated = plain_counts(r["text"])[0], plain_counts(r["text"])[4]
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
    assert sum(r["kept"] for r in rows) > 350


def test_estimates_follow_the_votes():
    patterns = [("11-" + "-" * 7, 900), ("00-" + "-" * 7, 80), ("10-" + "-" * 7, 15), ("--0" + "-" * 7, 5)]
    prior, chances = rules.estimate(patterns)
    good = rules.posterior(rules.vote_table([p for p, _ in patterns]), prior, chances)
    assert good[0] > 0.99 and good[1] < 0.01 and 0.8 < prior < 0.97


def test_rules_on_edge_documents(edge_docs, edge_rows, no_docs):
    rows = rules.judge(edge_docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    cache = {t: plain_counts(t) for _, t, _ in edge_rows if len(t or "") < 10_000}
    small = Counter()
    for i, t, _ in edge_rows:
        if t in cache:
            c = cache[t]
            small[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert all(got[k] == n for k, n in small.items()) and sum(got.values()) == len(edge_rows)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert rules.judge(no_docs).count() == 0
