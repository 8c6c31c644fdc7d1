"""Line dedup, source mixing and chat snapshots against plain loops."""

from collections import Counter

import pytest

from assaykit.llm import chat, linededup, mixing

SPACE = " \t\n\x0b\x0c\r"
UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key_of(line):
    return line.strip(SPACE).translate(str.maketrans(UP, UP.lower()))


def plain_dedup(texts, least):
    found = Counter(k for t in texts for k in {key_of(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if found[key_of(x)] < least or not key_of(x)]
        out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup_matches_plain_loop(edge_docs, edge_rows, least):
    found = linededup.dedup_lines(edge_docs, min_docs=least)
    rows = found.select("kept", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, rows)) == plain_dedup([t for _, t, _ in edge_rows], least)
    assert found.columns.count("n_lines") == 1 and "_key" in found.columns


def test_line_dedup_counts_rows_not_lines(spark):
    docs = spark.createDataFrame([(1, "same\nsame\nsame"), (2, "Same \nother")], "doc_id long, text string")
    rows = {r["doc_id"]: r["kept"] for r in linededup.dedup_lines(docs, min_docs=3).collect()}
    assert rows == {1: "same\nsame\nsame", 2: "Same \nother"}
    rows = {r["doc_id"]: (r["kept"], r["n_dropped"]) for r in linededup.dedup_lines(docs, min_docs=2).collect()}
    assert rows == {1: ("", 3), 2: ("other", 1)}


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        level = (total - sum(fixed.values())) / max(1, sum(w for s, w in weight.items() if s not in fixed))
        over = [s for s in order if s not in fixed and level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * weight[s]) for s in order}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_hits_targets(edge_docs, edge_rows):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    words = Counter()
    for _, t, s in edge_rows:
        words[s] += len((t or "").split())
    target = plain_targets(words)
    taken = Counter()
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in words:
        assert abs(taken[s] - target[s]) <= 0.5
    again = mixing.mix(edge_docs.repartition(5)).collect()
    pick = lambda rs: Counter((r["doc_id"], r["size"], r["taken"]) for r in rs)
    assert pick(rows) == pick(again)


def test_mixing_clamps_small_sources_and_repeats(spark):
    rows = [(n, "w " * 10, "big") for n in range(60)] + [(100, "v " * 5, "aaa"), (101, None, "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    by = {r["source"]: r["target"] for r in mixed.collect()}
    assert by["aaa"] == 15 and by["zero"] == 0 and by["big"] == pytest.approx(590)
    repeated = mixing.repeated(mixed, docs.columns).collect()
    assert sum(r["doc_id"] == 100 for r in repeated) == 3 and not any(r["doc_id"] == 101 for r in repeated)


def test_mixing_reads_prefixes_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PREFIX_ROWS", 20)
    rows = [(n, "w " * (1 + n % 7), "hot") for n in range(900)] + [(10_000 + n, "u " * 40, "cold") for n in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def plain_chat(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    convs = {c: tuple(x[1:] for x in sorted(v)) for c, v in convs.items()}
    heads = {v[:k] for v in convs.values() for k in range(1, len(v))}
    best = {}
    for c, v in convs.items():
        if v not in heads and (v not in best or best[v] is None or (c is not None and c < best[v])):
            best[v] = c
    return {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v) for v, c in best.items()}


def test_chat_keeps_maximal_conversations(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), (None, None)]
    rows = []
    for c, turns in {1: a[:1], 2: a[:2], 3: a, 4: a, 5: a[:2] + [("user", "other")], 6: a[1:], 7: [("user", "hi ")]}.items():
        rows += [(c, n, *t) for n, t in enumerate(turns)]
    rows += [(None, 0, "user", "lonely"), (8, None, "user", "tie"), (8, None, "user", "a tie"), (9, 5, "user", "hi"), (9, 9, "assistant", "hello")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r["text"] for r in chat.render(chat.collapse(turns)).collect()}
    assert found == plain_chat(rows)


def test_chat_in_slices_is_the_same(spark):
    rows = [(1, n, "user", f"t{n}") for n in range(25)] + [(2, n, "user", f"t{n}") for n in range(24)] + [(3, n, "user", f"t{n % 24}") for n in range(25)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.render(chat.collapse(turns, slice_turns=4)).collect()
    texts = {}
    for r in sorted(parts, key=lambda r: (r["conv_id"], r["part"])):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
    assert texts == plain_chat(rows) and sorted(texts) == [1, 3]


def test_empty_tables(spark, no_docs):
    assert linededup.dedup_lines(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.collapse(turns)).count() == 0
