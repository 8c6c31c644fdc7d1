"""Secrets and personal data: fixed patterns by plain search, and what the models add."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assaykit.llm import pii, queries, secrets

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def plain_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) % 10 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "secret", "passwd", ":", "=", " ", '"', "'", "AKIA", "AKIA" * 5, "0a" * 12, "f", "é", "ſ", "Key", "Xy.9", "longer_value", "\n"]), max_size=12).map("".join))
def test_fixed_secret_patterns(text):
    assert secrets.base_spans(text) == plain_secrets(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", "x.org", ".", "-", " ", "1", "10.0.0.", "255", "256", "4111 1111 1111 1111", "+1 (603) 555-8791", "+", "(", "é", "%", "0"]), max_size=12).map("".join))
def test_fixed_personal_patterns(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1 " * 50_000, "token " * 50_000, "f" * 23 + "g" * 300_000):
        pii.base_spans(text)
        secrets.base_spans(text)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows = []
    for n in range(240):
        text = [r.choice(words) for _ in range(60)]
        if n % 4 == 0:
            text[10] = 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'
        if n % 4 == 1:
            text[10] = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        if n % 4 == 2:
            text[10] = f"{r.choice(words)}.{n}@mail{n % 9}.example.com"
        if n % 4 == 3:
            text[10] = ".".join(str(r.randint(1, 254)) for _ in range(4))
            text[20] = "CC BY 4.0 of 1999"
        rows.append((n, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_random_strings_are_told_from_words(corpus):
    models = secrets.fit(corpus)
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(letters) for _ in range(32)) for _ in range(200)]
    found = [secrets.spans(f"and {k} the", models) for k in keys]
    assert sum(s == [("markov", 4, 36)] for s in found) >= 190
    words = [row["text"].split()[n % 9] + row["text"].split()[1 + n % 7] * 3 for n, row in enumerate(corpus.collect())]
    assert not any(s for w in words for s in secrets.spans(f"and {w} the", models) if s[0] == "markov")
    assert secrets.spans(None, models) == [] and secrets.spans("4111111111111111111111", models) == []


def test_keys_of_letters_are_told_from_identifiers(corpus):
    models = secrets.fit(corpus)
    r = random.Random(19)
    small = "abcdefghijklmnopqrstuvwxyz"
    for letters in (small, small.upper(), small + small.upper(), small + small.upper() + "0123456789"):
        for size in (16, 20):
            keys = ["".join(r.choice(letters) for _ in range(size)) for _ in range(200)]
            found = [secrets.spans(f"and {k} the", models) for k in keys]
            assert sum(s == [("markov", 4, 4 + size)] for s in found) >= 190
    for row in corpus.collect():
        words = [w for w in row["text"].split() if w.isalpha() and w.islower() and len(w) > 4][:5]
        camel = "".join(w.capitalize() for w in words)
        for name in (camel[0].lower() + camel[1:], camel, "_".join(words), "-".join(words), "/".join(words), "".join(words)):
            assert len(name) >= 16 and secrets.spans(f"and {name} the", models) == []


def test_models_without_samples(spark):
    models = secrets.fit(spark.createDataFrame([], "doc_id long, text string"))
    assert secrets.spans("token=abcdef", models) == [("assign", 0, 12)]


def test_field_learns_spans_and_forms_beyond_the_patterns(corpus):
    field = pii.fit(corpus)
    r = random.Random(10)
    for _ in range(40):
        a, b = r.randint(200, 999), r.randint(1000, 9999)
        text = f"so ({a}) 555-{b} nil"
        assert pii.spans(text, field) == [("crf_phone", 3, 17)]
    assert pii.spans("under CC BY 4.0 of 1999", field) == []
    text = "x +1 (300) 555-1234 and me@mail.example.com"
    assert pii.spans(text, field)[:2] == sorted(pii.base_spans(text), key=lambda s: pii.KINDS.index(s[0]))[:2]
    assert pii.spans(None, field) == []


def test_dynamic_program_finds_the_best_segmentation(corpus):
    field = pii.fit(corpus)
    for window in ("so (300) 555-1234 nil", "10.20.30.40 (300) 555-1234 x"):
        tokens, spans, scores = field.lattice(window)

        def best(at):
            if at == len(tokens):
                return 0.0
            here = [best(at + 1)]
            here += [best(s[1] + 1) + w.max() for s, w in zip(spans, scores) if s[0] == at]
            return max(here)

        chosen = field.best(window)
        where = {(tokens[s[0]][0], tokens[s[1]][1]): w for s, w in zip(spans, scores)}
        assert sum(where[s, e][pii.KINDS.index(k)] for k, s, e, _ in chosen) == pytest.approx(best(0))


def test_scans_of_edge_documents(edge_docs, edge_rows, no_docs):
    models, field = secrets.fit(edge_docs), pii.fit(edge_docs)
    for found, base in ((secrets.scan(edge_docs, models), secrets.base_spans), (pii.scan(edge_docs, field), pii.base_spans)):
        rows = found.collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in edge_rows)
        assert all(base(t or "") == [] for _, t, _ in edge_rows) and all(r["spans"] == [] for r in rows)
    assert secrets.scan(no_docs, models).count() == 0 and pii.scan(no_docs, field).count() == 0


def test_query_digests(spark, tmp_path):
    import hashlib

    text = 'é token = "' + "ab" * 20 + '" 10.1.2.3 +1 (300) 555-1234 a@b.c AKIA' + "A1" * 9
    spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    for op, plain, order in ((queries.op4, plain_secrets, lambda s: (s[1], secrets.KINDS.index(s[0]))), (queries.op7, plain_pii, lambda s: (pii.KINDS.index(s[0]), s[1]))):
        rows = {r["doc_id"]: r for r in op(spark, str(tmp_path)).collect()}
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(plain(text), key=order))
        assert joined and rows[1]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert rows[2]["base_sha256"] == rows[None]["base_sha256"] == empty and rows[2]["spans"] == ""
