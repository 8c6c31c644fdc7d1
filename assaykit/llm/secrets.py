"""Secrets in text: fixed patterns, and random strings told from ordinary identifiers.

Two kinds of character Markov models are trained from labelled samples that cover the whole
corpus: transitions in ordinary text, and transitions in random strings per alphabet, from
the values of pattern matches on top of uniform counts. A long token outside the patterns
is a secret where the log-likelihood ratio speaks for random. A token without a digit has to
come nearer to what random letters score, and the joints of identifiers don't count in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import Ranges, each, map_rows

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 6
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: A token long enough to be told apart; shorter ones are left to the patterns.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16,}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
_SIZE = len(_ALPHABET) + 1
#: Alphabets random strings are drawn from.
_RANDOM = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": _ALPHABET,
}
#: Weight of the uniform counts per character of a random alphabet, and of single
#: characters' frequencies in the ordinary model.
PRIOR, BACKOFF = 200.0, 50.0
#: The ratio needed in all and per character, in nats.
MIN_RATIO, MIN_RATE = 12.0, 0.5
#: The share of random letters' mean ratio that a token without a digit needs.
LETTERS_SHARE = 0.45
#: Alphabets of such tokens. Their models are uniform: values of letters alone are mostly words.
_LETTERS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}

_CODES = np.zeros(256, dtype=np.int64)
for _n, _c in enumerate(_ALPHABET, start=1):
    _CODES[ord(_c)] = _n


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns as (kind, start, end), per kind from left to right.

    Code points, end exclusive. ASCII letters of the key may have either case. Matches that
    fail a length are dropped, and the search goes on behind them.
    """
    spans = []
    lower = text.lower()
    if any(hint in lower for hint in _ASSIGN_HINTS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def _transitions(text: str) -> np.ndarray:
    """Counts of character pairs, flat; anything outside the alphabet is one boundary sign."""
    codes = _CODES[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    return np.bincount(codes[:-1] * _SIZE + codes[1:], minlength=_SIZE * _SIZE)


def _value(text: str, kind: str, start: int, end: int) -> str:
    return ASSIGN.match(text, start, end)[2] if kind == "assign" else text[start:end]


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Transition counts of the labelled samples in all texts: kind, cell, n.

    Kind is ordinary, for text outside pattern matches, or the smallest random alphabet that
    holds a match's value. Every task sends a table of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {kind: np.zeros(_SIZE * _SIZE, dtype=np.int64) for kind in ("ordinary", *_RANDOM)}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                at = 0
                for kind, start, end in sorted(base_spans(text), key=lambda s: s[1:]):
                    value = _value(text, kind, start, end)
                    for name, letters in _RANDOM.items():
                        if set(value) <= set(letters):
                            tables[name] += _transitions(value)
                            break
                    if start > at:
                        tables["ordinary"] += _transitions(text[at:start])
                    at = max(at, end)
                tables["ordinary"] += _transitions(text[at:])
        for kind, table in tables.items():
            cells = np.flatnonzero(table)
            yield pa.record_batch(
                {"kind": pa.array([kind] * len(cells), pa.string()), "cell": pa.array(cells, pa.int64()), "n": pa.array(table[cells], pa.int64())}
            )

    return docs.select(text_col).mapInArrow(count, "kind string, cell bigint, n bigint")


class Models:
    """Log-likelihood ratios of tokens, from summed transition counts."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        tables = {kind: np.zeros(_SIZE * _SIZE) for kind in ("ordinary", *_RANDOM)}
        for kind, cell, n in counts:
            tables[kind][cell] += n
        plain = tables["ordinary"].reshape(_SIZE, _SIZE)
        single = (plain.sum(axis=0) + 1) / (plain.sum() + _SIZE)
        ordinary = np.log((plain + BACKOFF * single) / (plain.sum(axis=1, keepdims=True) + BACKOFF))
        self.ratio = {}
        for name, letters in _RANDOM.items():
            uniform = np.zeros(_SIZE)
            uniform[[_ALPHABET.index(c) + 1 for c in letters]] = 1 / len(letters)
            table = tables[name].reshape(_SIZE, _SIZE).copy()
            # a token's end depends on its length, not on its letters
            table[:, 0] = 0
            known = (table + PRIOR * uniform) / (table.sum(axis=1, keepdims=True) + PRIOR)
            inside = np.log(np.maximum(known, 1e-300))
            self.ratio[frozenset(letters)] = (inside - ordinary).ravel()
        held = {}
        for name, letters in _LETTERS.items():
            held[name] = np.zeros(_SIZE, dtype=bool)
            held[name][[_ALPHABET.index(c) + 1 for c in letters]] = True
        # words of an identifier meet at signs and at capitals
        inside = np.outer(held["mixed"], held["mixed"]) & ~np.outer(held["lower"], held["upper"])
        self.inside = inside.ravel()
        self.letters = {}
        for name, letters in _LETTERS.items():
            table = np.where(inside, -np.log(len(letters)) - ordinary, 0.0)
            self.letters[name] = table.ravel(), float(table[inside & np.outer(held[name], held[name])].mean())

    def of(self, token: str) -> float:
        """How far the token speaks for the likeliest random alphabet that holds it."""
        codes = np.r_[0, _CODES[np.frombuffer(token.encode(), dtype=np.uint8)]]
        cells = codes[:-1] * _SIZE + codes[1:]
        held = set(token)
        return max((float(table[cells].sum()) for letters, table in self.ratio.items() if held <= letters), default=-np.inf)

    def is_random(self, token: str) -> bool:
        """Whether the ratio suffices, with a digit or without one."""
        if any(c.isdigit() for c in token):
            return self.of(token) >= max(MIN_RATIO, MIN_RATE * len(token))
        codes = _CODES[np.frombuffer(token.encode(), dtype=np.uint8)]
        cells = codes[:-1] * _SIZE + codes[1:]
        table, mean = self.letters["lower" if token.islower() else "upper" if token.isupper() else "mixed"]
        needed = LETTERS_SHARE * mean * np.count_nonzero(self.inside[cells])
        return float(table[cells].sum()) >= max(MIN_RATIO, needed)


def fit(docs: DataFrame, text_col: str = "text") -> Models:
    """Train on all texts; without any match the random models are uniform."""
    summed = samples(docs, text_col).groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    # at most (alphabets + 1) x (letters + 1) squared rows
    return Models([tuple(r) for r in summed.collect()])


def spans(text: str | None, models: Models) -> list[tuple[str, int, int]]:
    """All secrets of a text: pattern matches, and tokens of 16 characters or more that touch
    none of them and that the models find random. By start, then kind. Null is empty."""
    text = text or ""
    found = base_spans(text)
    taken = Ranges([(s, e) for _, s, e in found])
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        token = m[0].strip("=-/+_") if m[0][0] in "=-/+_" or m[0][-1] in "-/+_" else m[0]
        if token.isdigit() or len(token) < 16:
            continue
        start += m[0].index(token)
        end = start + len(token)
        if taken.touch(start, end):
            continue
        if models.is_random(token):
            found.append(("markov", start, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans (kind, start, end), empty for null, empty and clean texts.

    Repeated rows give repeated results, null ids stay null.
    """

    def make():
        return each(lambda doc_id, text: (doc_id, [{"kind": k, "start": s, "end": e} for k, s, e in spans(text, models)]))

    kind = docs.select(id_col).dtypes[0][1]
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(docs.select(id_col, text_col), make, schema)
