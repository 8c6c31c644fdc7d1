"""Quality rules combined by weak supervision instead of all-must-pass.

Each rule votes good or bad or abstains. Documents are counted per pattern of votes;
expectation-maximisation over the counts estimates how far each rule can be trusted for
good and for bad documents, and a document is kept by its posterior probability.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from assaykit.llm.common import WORD, masked, unmasked
from assaykit.session import checkpointed

SYMBOLS = "#*$%&|<>"
KEEP_FROM = 0.5
_WORDS = re.compile(WORD)

#: Words of letters, with a hyphen or apostrophe inside and one mark at either end at most.
_PLAIN = re.compile(r"[\"'(]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?\"')]?")

#: name, measure, bad at, good at. A rule votes at or beyond its limits and abstains between
#: them and where the measure is None; one without a good limit only ever votes bad.
RULES: tuple[tuple[str, Callable[[dict], float | None], float, float | None], ...] = (
    ("symbols", lambda m: m["symbols"] / m["words"] if m["words"] else None, 0.15, 0.03),
    ("plain_words", lambda m: 1 - m["plain"] / m["words"] if m["words"] else None, 0.4, 0.1),
    ("short_words", lambda m: 1 - m["short"] / m["words"] if m["words"] >= 50 else None, 0.97, 0.85),
    ("repeated_words", lambda m: m["repeated"] / m["words"] if m["words"] else None, 0.4, None),
    ("repeated_lines", lambda m: m["dup_lines"] / m["lines"] if m["lines"] > 1 else None, 0.3, None),
    ("capitals", lambda m: m["upper"] / m["letters"] if m["letters"] else None, 0.4, None),
    ("exclamations", lambda m: m["exclamations"] / m["words"] if m["words"] else None, 0.3, None),
    ("long_words", lambda m: m["chars"] / m["words"] if m["words"] else None, 14.0, None),
    ("top_word", lambda m: m["top"] / m["words"] if m["words"] >= 50 else None, 0.3, None),
    ("digits", lambda m: m["digits"] / m["chars"] if m["chars"] else None, 0.3, None),
)

_FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, votes string"


def measure(text: str | None) -> tuple[int, int, int, int, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' votes.

    Repeated words are those in windows of three that the text holds twice or more, the
    first time included. Repeated lines hold a word and equal an earlier line. Null is empty.
    """
    text = text or ""
    words = _WORDS.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    counts: dict[tuple, int] = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    repeated, end = 0, 0
    if len(counts) < len(windows):
        for at, w in enumerate(windows):
            if counts[w] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=128)
    upper = int(raw[65:91].sum())
    m = {
        "words": len(words), "chars": sum(map(len, words)), "symbols": int(sum(raw[ord(c)] for c in SYMBOLS)),
        "lines": len(lines), "dup_lines": len(lines) - len(set(lines)), "repeated": repeated, "upper": upper,
        "letters": upper + int(raw[97:123].sum()), "exclamations": int(raw[ord("!")]), "digits": int(raw[48:58].sum()),
        "top": max(seen.values(), default=0),
        "plain": sum(n for w, n in seen.items() if _PLAIN.fullmatch(w)),
        "short": sum(n for w, n in seen.items() if len(w) <= 3),
    }
    votes = []
    for _, rule, bad, good in RULES:
        value = rule(m)
        votes.append("-" if value is None else "0" if value >= bad else "1" if good is not None and value <= good else "-")
    return m["words"], m["chars"], m["symbols"], m["dup_lines"], m["repeated"], "".join(votes)


#: Outcomes of a rule, as they stand in a pattern of votes.
_OUTCOMES = "01-"


def estimate(patterns: list[tuple[str, int]], rounds: int = 500) -> tuple[float, np.ndarray]:
    """Prior of good, and per rule and class the chances that it votes bad, good or abstains.

    Expectation-maximisation over (votes, documents) until it settles. It starts from rules
    that are mostly right, and a rule's vote is never held to speak against what it says,
    which keeps the two classes apart. Counts are smoothed.
    """
    start = np.array([[0.4, 0.1, 0.5], [0.01, 0.49, 0.5]])
    prior, chances = 0.9, np.tile(start, (len(RULES), 1, 1))
    if not patterns:
        return prior, chances
    votes = vote_table([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], dtype=np.float64)
    cast = np.eye(3)[votes]
    for _ in range(rounds):
        good = posterior(votes, prior, chances)
        before, was = prior, chances
        prior = float((weight @ good + 1) / (weight.sum() + 2))
        counts = np.stack([np.einsum("p,prv->rv", weight * share, cast) for share in (1 - good, good)], axis=1) + 0.5
        chances = counts / counts.sum(axis=2, keepdims=True)
        # a bad vote is no likelier on good documents than on bad ones, nor a good one on bad
        chances[:, 1, 0] = np.minimum(chances[:, 1, 0], chances[:, 0, 0])
        chances[:, 0, 1] = np.minimum(chances[:, 0, 1], chances[:, 1, 1])
        if abs(prior - before) + np.abs(chances - was).max() < 1e-9:
            break
    return prior, chances


def vote_table(patterns: list[str]) -> np.ndarray:
    return np.array([[_OUTCOMES.index(v) for v in p] for p in patterns], dtype=np.int64).reshape(-1, len(RULES))


def posterior(votes: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    """Probability of good per row of outcomes. An abstention says nothing."""
    ratio = np.log(chances[:, 1]) - np.log(chances[:, 0])
    ratio[:, 2] = 0.0
    odds = np.log(prior / (1 - prior)) + ratio[np.arange(len(RULES)), votes].sum(axis=1)
    return 1 / (1 + np.exp(-odds))


def judge(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_words: int = 50, max_repeat: int = 50,
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Documents with their counts, ``base_failed``, ``probability`` and ``kept``.

    ``base_failed``: under ``min_words`` words or over ``max_repeat`` per cent of them in
    repeated windows. The accuracies are estimated over all documents; what reaches the
    driver is one row per pattern of votes, three to the number of rules at most. Null
    texts are empty and thus fail. Every row is kept in the result, repeated ones too.
    The columns in ``keep``, all by default, pass through; those named like a result give way.
    """
    kept = docs.select(*(docs.columns if keep is None else keep))
    rows, name = masked(docs)

    @F.pandas_udf(_FIELDS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[f.split()[0] for f in _FIELDS.split(", ")])

    seen = rows.select(*[name[c] for c in kept.columns], measured(name[text_col]).alias("_m"))
    stored = checkpointed(seen.toDF(*[f"_c{i}" for i in range(len(kept.columns))], "_m").select("*", "_m.*").drop("_m"))
    counted = [tuple(r) for r in stored.groupBy("votes").count().collect()]
    good = posterior(vote_table([p for p, _ in counted]), *estimate(counted))
    schema = StructType([StructField("votes", StringType()), StructField("_chance", DoubleType())])
    known = docs.sparkSession.createDataFrame([(p, float(c)) for (p, _), c in zip(counted, good)], schema)
    joined = stored.join(F.broadcast(known), "votes")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return unmasked(
        joined,
        kept,
        {c: F.col(c) for c in counts}
        | {"base_failed": failed, "probability": F.col("_chance"), "kept": ~failed & (F.col("_chance") >= keep_from), "votes": F.col("votes")},
    )
