"""Packing: exact ids, gapless sequences, few of them."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assaykit.llm import packing


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_pieces_are_the_documents_ids(edge_docs, edge_rows, model):
    rows = packing.pieces(edge_docs, with_ids=True, length=512).collect()
    got = Counter()
    for doc_id, text, _ in edge_rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at : at + 512], dtype="<u4").tobytes()
            got[(doc_id, n, at, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in rows) == got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab'sS é́ßΣς.<|>#0_-\n\t\x1c 中")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_tokenizers(model, text):
    ids = np.array(model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert packing.encoder()(text) == ids


def test_encoder_forgets_within_bounds(model, monkeypatch):
    monkeypatch.setattr(packing, "UNITS_KEPT", 50)
    monkeypatch.setattr(packing, "WORDS_KEPT", 30)
    encoder = packing.Encoder(packing.tokenizer_path())
    for n in range(30):
        text = " ".join(f"w{chr(97 + n % 26)}x{chr(97 + k % 26)}" for k in range(20))
        assert encoder(text) == np.array(model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert len(encoder.units) <= 50 and len(encoder.words) <= 30


def check(rows, length):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
    return len(places)


@pytest.mark.parametrize("group_rows", [30_000, 40])
def test_sequences_are_gapless_and_few(spark, group_rows):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in np.minimum(2048, rng.lognormal(6, 1, 400) + 1)]
    rows = [(n if n % 50 else None, 0, 0, x, 0) for n, x in enumerate(lengths)] + [(7, 0, 0, 100, 5)] * 5
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(found, group_rows=group_rows).collect()
    assert len(packed) == len(rows)
    used, bound = check(packed, 2048), -(-sum(r[3] for r in rows) // 2048)
    assert bound <= used <= bound + (1 if group_rows == 30_000 else 3)


@pytest.mark.parametrize("size", [2048, 1500])
def test_equal_rows_are_spread_over_the_groups(spark, size):
    found = spark.range(2000).selectExpr(
        "CAST(null AS BIGINT) AS doc_id", "0 AS piece", "0L AS start", f"CAST({size} AS BIGINT) AS length", "5L AS ids_crc32"
    )
    packed = packing.pack(found, group_rows=100).collect()
    # the group stands in the upper bits, above the level
    groups = Counter(r["sequence_id"] >> 33 for r in packed)
    assert len(packed) == 2000 and len(groups) == 20 and max(groups.values()) <= 200


def test_local_search_frees_bins():
    # best fit leaves 6+3 | 6+3 | 4+4 of 10; exchanges fill two bins whole
    lengths = np.array([6, 6, 4, 4, 3, 3])
    bins = packing.improve(np.array([0, 1, 2, 2, 0, 1]), lengths, 10)
    fills = np.bincount(bins, weights=lengths)
    assert fills.max() <= 10 and (fills**2).sum() > 81 + 81 + 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_search_never_uses_more_bins(sizes):
    lengths = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    first = packing.best_fit(lengths, 40)
    after = packing.improve(first, lengths, 40)
    if len(lengths):
        fills = np.bincount(after, weights=lengths)
        assert fills.max() <= 40 and fills.min() > 0 and after.max() <= first.max()
        assert (fills**2).sum() >= (np.bincount(first, weights=lengths) ** 2).sum()


def test_edge_documents_and_no_documents(edge_docs, edge_rows, no_docs):
    packed = packing.pack(packing.pieces(edge_docs)).collect()
    check(packed, 2048)
    assert sum(r["piece"] == 0 for r in packed) == len(edge_rows)
    assert packing.pack(packing.pieces(no_docs)).count() == 0
