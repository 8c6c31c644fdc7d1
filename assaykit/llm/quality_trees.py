"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed next to the data. Trees are grown from a bounded,
seeded sample of labelled rows by sums over histogram bins, and are flattened into arrays
of complete binary trees, so that scoring is a few numpy gathers per tree and level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for training at most, chosen by hash of their id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "longest_word", "words_per_line",
    "distinct_words", "top_word", "short_words", "repeated_lines", "upper", "digits", "other_ascii", "non_ascii",
    "full_stops", "commas", "exclamations", "pipes", "markup", "hashes", "quotes", "brackets", "digit_words", "dots_run",
)


def statistics(text: str | None) -> list[float]:
    """The features of a whole text; null counts as empty, and empty gives zeros."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    words = text.split()
    n, chars, size = len(words), max(1, len(text)), max(1, int(raw.sum()))
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    some = max(1, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1

    def of(characters: str) -> float:
        return float(sum(raw[ord(c)] for c in characters)) / some

    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        float(lengths.mean()) if n else 0.0,
        float(lengths.std()) if n else 0.0,
        float(np.log1p(lengths.max())) if n else 0.0,
        n / max(1, len(lines)),
        len(counts) / some,
        max(counts.values()) / some if n else 0.0,
        float((lengths <= 3).sum()) / some,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(raw[65:91].sum()) / letters,
        float(raw[48:58].sum()) / size,
        float(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / size,
        1 - len(text) / size if text else 0.0,
        of("."), of(","), of("!"), of("|"), of("<>"), of("#*$%&"), of("\"'"), of("()[]{}"),
        float(sum(w.isdigit() for w in counts)) / some,
        text.count("..") / chars,
    ]


def feature_matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Forest:
    """Boosted trees as arrays: row per tree, complete binary trees level by level."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1,
    penalty: float = 2.0, least: float = 3.0,
) -> Forest:
    """Boost the logistic loss; one class only, or no row at all, gives a constant score.

    ``penalty`` is added to the second derivatives of a leaf, ``least`` is the smallest sum
    of them on either side of a split. Ties go to the first feature and lowest bin.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    if len(y) == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    features, thresholds, values = [], [], []
    margin = np.full(len(y), forest.prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature = np.zeros(inner, dtype=np.int64)
        threshold = np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            at = node - first
            best = _best_splits(binned, at, 2**level, grad, hess, bins, penalty, least)
            cut = np.full(2**level, bins, dtype=np.int64)
            for k, (gain, f, b) in enumerate(best):
                if gain > 1e-9 and b < len(edges[f]):
                    feature[first + k], threshold[first + k], cut[k] = f, edges[f][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[at])
        leaf = node - inner
        g = np.bincount(leaf, weights=grad, minlength=leaves)
        h = np.bincount(leaf, weights=hess, minlength=leaves)
        value = rate * g / (h + penalty)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(forest.prior, np.array(features), np.array(thresholds), np.array(values), depth)


def _best_splits(binned, at, nodes, grad, hess, bins, penalty, least) -> list[tuple[float, int, int]]:
    """(gain, feature, bin) per node: rows up to the bin go left."""
    best = [(0.0, 0, 0)] * nodes
    for f in range(binned.shape[1]):
        slot = at * bins + binned[:, f]
        g = np.bincount(slot, weights=grad, minlength=nodes * bins).reshape(nodes, bins).cumsum(axis=1)
        h = np.bincount(slot, weights=hess, minlength=nodes * bins).reshape(nodes, bins).cumsum(axis=1)
        whole_g, whole_h = g[:, -1:], h[:, -1:]
        gain = g**2 / (h + penalty) + (whole_g - g) ** 2 / (whole_h - h + penalty) - whole_g**2 / (whole_h + penalty)
        gain[(h < least) | (whole_h - h < least)] = 0
        for k, b in enumerate(gain.argmax(axis=1)):
            if gain[k, b] > best[k][0] + 1e-12:
                best[k] = (float(gain[k, b]), f, int(b))
    return best


def is_held_out(doc_id: Column) -> Column:
    """One id in five, by CRC-32 of its text; a null id counts as empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rows: int = TRAIN_ROWS, **settings,
) -> Forest:
    """Train on at most ``rows`` labelled documents that are not held out.

    A document with several labels takes the lowest; an id with several texts takes one of
    them. Null ids and labels are left out. Only statistics and labels reach the driver.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col)))
    picked = (
        known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64(F.lit(7), "_id"), "_id").limit(rows)
    )

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(feature_matrix(texts)))

    # at most ``rows`` rows of two numbers are broadcast
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    found = (
        sample.select("_id", "_label", measured("_text").alias("_x"))
        .groupBy("_id", "_label").agg(F.min("_x").alias("_x")).orderBy("_id").toPandas()
    )
    x = np.array(found["_x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return train(x, found["_label"].to_numpy(dtype=np.float64), **settings)


def score(texts: Column, forest: Forest) -> Column:
    """Probability from 0 to 1 that a text is of good quality, for every text, also null or empty."""

    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        return pd.Series(
            np.concatenate([forest.score(feature_matrix(values.iloc[at : at + 512])) for at in range(0, len(values), 512)] or [[]])
        )

    return scored(texts)
