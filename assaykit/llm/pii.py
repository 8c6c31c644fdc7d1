"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The field scores whole candidate spans (shape, digits, checks on the number, what stands
around) and a dynamic program over entities of bounded length chooses boundaries and types
together. It is trained on windows of text whose labels are the fixed patterns' matches,
some of them rewritten in looser forms, so that it also finds forms the patterns miss.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import Ranges, each, map_rows

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that only the field finds, listed behind the fixed ones.
ADDED = tuple(f"crf_{k}" for k in KINDS)
#: Windows used for training at most, chosen by hash of their text.
TRAIN_WINDOWS = 1_500
#: An entity is at most so many tokens and characters.
MAX_TOKENS, MAX_CHARS = 16, 64
#: Probability a found entity has to have.
MIN_CHANCE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns as (kind, start, end), kind by kind from left to right.

    Code points, end exclusive. A match that fails its check is dropped, and the search goes
    on behind it.
    """
    spans = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            spans.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


_TRIGGER = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_HINT = re.compile(r"[0-9]+|@")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, with a word or two to either side."""
    found: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - 24), min(len(text), m.end() + 16)
        if found and start <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([start, end])
    return [(s, e) for s, e in found]


@lru_cache(maxsize=50_000)
def span_features(span: str, before: str, after: str) -> tuple[str, ...]:
    """Features of a whole candidate span between two characters (empty at the text's ends)."""
    digits = _digits(span)
    letters = sum(c.isalpha() for c in span)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", span))
    runs = "-".join(str(min(len(r), 9)) for r in re.findall("[0-9]+", span)[:6])
    features = [
        "bias", f"digits={min(len(digits), 20)}", f"marks={marks}", f"shape={shape[:24]}", f"first={_class(span[0])}",
        f"before={_class(before)}", f"after={_class(after)}", f"letters={letters * 4 // len(span)}",
    ]
    if not letters:
        features += [f"runs={runs}", f"luhn={13 <= len(digits) <= 19 and luhn(digits)}"]
    if "." in span:
        parts = span.split(".")
        octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
        features.append(f"octets={octets}")
    if "@" in span:
        local, _, host = span.partition("@")
        features.append(f"mail={bool(local and _LOCAL.match(local[0]) and _DOMAIN.fullmatch(host))}")
    return tuple(features)


def _class(c: str) -> str:
    return "end" if not c else "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c


def candidates(window: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, str, str]]]:
    """Tokens of a window and the spans (first, last token, text, before, after) that may be entities."""
    tokens = [m.span() for m in _TOKEN.finditer(window)]
    spans = []
    for i, (start, _) in enumerate(tokens):
        if not (window[start].isalnum() or window[start] in "+("):
            continue
        hot = False
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            end = tokens[j][1]
            piece = window[tokens[j][0] : end]
            if end - start > MAX_CHARS or (j > i and "\n" in window[tokens[j - 1][1] : tokens[j][0]]):
                break
            hot = hot or piece == "@" or any("0" <= c <= "9" for c in piece)
            if hot and window[end - 1].isalnum():
                spans.append((i, j, window[start:end], window[start - 1 : start] if start else "", window[end : end + 1]))
    return tokens, spans


class Field:
    """Weights per (type, feature); a token outside entities scores zero."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or {}
        self._memo: dict[tuple, np.ndarray] = {}

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            total = total + w if w is not None else total - 0.5 * (f[:5] in ("shape", "marks"))
        return total

    def lattice(self, window: str):
        tokens, spans = candidates(window)
        rows = []
        for i, j, span, before, after in spans:
            key = (span, before, after)
            if key not in self._memo:
                if len(self._memo) > 50_000:
                    self._memo.clear()
                self._memo[key] = self.scores(span_features(*key))
            rows.append(self._memo[key])
        return tokens, spans, np.array(rows).reshape(-1, len(KINDS))

    def sums(self, n: int, spans, scores: np.ndarray):
        """Log sums of all segmentations of tokens before, and from, every place; span chances."""
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        begins: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, *_) in enumerate(spans):
            ends[j + 1].append(k)
            begins[i].append(k)
        each_span = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        ahead, back = np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, n + 1):
            ahead[t] = np.logaddexp.reduce([ahead[t - 1], *(ahead[spans[k][0]] + each_span[k] for k in ends[t])])
        for t in range(n - 1, -1, -1):
            back[t] = np.logaddexp.reduce([back[t + 1], *(back[spans[k][1] + 1] + each_span[k] for k in begins[t])])
        first = np.array([s[0] for s in spans], dtype=int)
        last = np.array([s[1] + 1 for s in spans], dtype=int)
        chances = np.exp(scores + (ahead[first] + back[last] - ahead[n])[:, None]) if len(spans) else scores
        return chances

    def best(self, window: str) -> list[tuple[str, int, int, float]]:
        """The best joint choice of spans and types: (kind, start, end, chance) in the window."""
        tokens, spans, scores = self.lattice(window)
        n = len(tokens)
        if not spans or scores.max() <= 0:
            return []
        top, kind = scores.max(axis=1), scores.argmax(axis=1)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j, *_rest) in enumerate(spans):
            if top[k] > 0:
                ends[j + 1].append(k)
        value, come = np.zeros(n + 1), [-1] * (n + 1)
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            for k in ends[t]:
                v = value[spans[k][0]] + top[k]
                if v > value[t]:
                    value[t], come[t] = v, k
        chosen, t = [], n
        while t > 0:
            if come[t] < 0:
                t -= 1
            else:
                chosen.append(come[t])
                t = spans[come[t]][0]
        chances = self.sums(n, spans, scores)
        return [
            (KINDS[kind[k]], tokens[spans[k][0]][0], tokens[spans[k][1]][1], float(chances[k, kind[k]])) for k in reversed(chosen)
        ]


def looser(window: str, gold: list[tuple[str, int, int]], turn: int) -> tuple[str, list[tuple[str, int, int]]]:
    """A window with its phones and cards written another way, labels moved along."""
    out, moved, at = [], [], 0
    for kind, start, end in gold:
        out.append(window[at:start])
        span = window[start:end]
        if kind == "phone":
            span = re.sub(r"^\+[0-9]{1,3}\x20?", "", span)
            span = span if turn % 2 else re.sub(r"[()]", "", span).replace(" ", "-")
        elif kind == "card" and span.isdigit() and turn % 2:
            span = " ".join(span[k : k + 4] for k in range(0, len(span), 4))
        place = sum(map(len, out))
        moved.append((kind, place, place + len(span)))
        out.append(span)
        at = end
    out.append(window[at:])
    return "".join(out), moved


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximise the likelihood of labelled windows by adaptive gradient steps, in the order given."""
    field = Field()
    squares: dict[str, np.ndarray] = {}
    lattices = []
    for window, gold in examples:
        tokens, spans = candidates(window)
        if not spans:
            continue
        wanted = {(s, e): KINDS.index(k) for k, s, e in gold}
        truth = np.zeros((len(spans), len(KINDS)))
        for row, (i, j, *_rest) in enumerate(spans):
            kind = wanted.get((tokens[i][0], tokens[j][1]))
            if kind is not None:
                truth[row, kind] = 1
        if truth.sum() < len(wanted):
            continue  # an entity beyond the bounds can't be chosen
        lattices.append((len(tokens), spans, [span_features(*s[2:]) for s in spans], truth))
    for _ in range(rounds):
        for n, spans, features, truth in lattices:
            chances = field.sums(n, spans, np.array([field.scores(f) for f in features]))
            step: dict[str, np.ndarray] = {}
            for fs, delta in zip(features, truth - chances):
                if np.abs(delta).max() < 1e-4:
                    continue
                for f in fs:
                    step[f] = step.get(f, 0) + delta
            for f, g in step.items():
                w = field.weights.setdefault(f, np.zeros(len(KINDS)))
                g = g - decay * w
                squares[f] = squares.get(f, 1e-8) + g * g
                w += rate * g / np.sqrt(squares[f])
    return Field(field.weights)


def fit(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_WINDOWS) -> Field:
    """Train on at most ``rows`` different windows of all texts, chosen by hash.

    Half of them hold pattern matches, as far as there are; without any the field finds nothing.
    """

    def make():
        def cut(text):
            text = text or ""
            gold = base_spans(text)
            found = []
            for start, end in windows(text):
                if end - start <= 400:
                    inside = [(k, s - start, e - start) for k, s, e in gold if s >= start and e <= end]
                    if not _overlapping(inside):
                        found.append((text[start:end], [{"kind": k, "start": s, "end": e} for k, s, e in sorted(inside, key=lambda x: x[1])], bool(inside)))
            return found

        return lambda rows: [w for (text,) in rows for w in cut(text)]

    schema = "window string, gold array<struct<kind:string,start:bigint,end:bigint>>, marked boolean"
    found = map_rows(docs.select(text_col), make, schema)
    picked = []
    for marked in (True, False):
        some = found.where(F.col("marked") == marked).groupBy("window").agg(F.min("gold").alias("gold"))
        picked += some.orderBy(F.xxhash64(F.lit(3), "window"), "window").limit(rows // 2).collect()
    examples = []
    for turn, row in enumerate(picked):
        gold = [(g["kind"], g["start"], g["end"]) for g in row["gold"]]
        examples.append((row["window"], gold))
        if any(k in ("phone", "card") for k, *_ in gold):
            examples.append(looser(row["window"], gold, turn))
    return train(sorted(examples, key=lambda x: hash_text(x[0])))


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _overlapping(spans: list[tuple[str, int, int]]) -> bool:
    ordered = sorted((s, e) for _, s, e in spans)
    return any(b[0] < a[1] for a, b in zip(ordered, ordered[1:]))


def spans(text: str | None, field: Field) -> list[tuple[str, int, int]]:
    """Pattern matches and, where they touch none, entities of the field. By kind, then start. Null is empty."""
    text = text or ""
    base = base_spans(text)
    taken = Ranges([(s, e) for _, s, e in base])
    added = []
    for start, end in windows(text):
        if all(taken.cover(start + m.start(), start + m.end()) for m in _HINT.finditer(text[start:end])):
            continue
        for kind, s, e, chance in field.best(text[start:end]):
            s, e = s + start, e + start
            if chance >= MIN_CHANCE and not taken.touch(s, e):
                added.append((f"crf_{kind}", s, e))
    order = KINDS + ADDED
    return sorted(base + added, key=lambda x: (order.index(x[0]), x[1]))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans (kind, start, end), empty for null, empty and clean texts.

    Repeated rows give repeated results, null ids stay null.
    """
    weights = field.weights

    def make():
        own = Field(weights)
        return each(lambda doc_id, text: (doc_id, [{"kind": k, "start": s, "end": e} for k, s, e in spans(text, own)]))

    kind = docs.select(id_col).dtypes[0][1]
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(docs.select(id_col, text_col), make, schema)
