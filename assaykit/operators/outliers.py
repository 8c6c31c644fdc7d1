"""Outlier scores by isolation forest, min-max scaling and quantile cut-off.

Every row competes for every tree: the rows with the lowest priorities, hashes of id and
tree, are a tree's sample. One pass keeps them, each task the lowest of its own rows, and
these short lists are merged. A tree is grown in one task, scoring is a map over the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.scan import exact_quantiles
from assaykit.session import checkpointed

TREES = 100
TREE_ROWS = 256
MIN_ROWS = 5
MIN_SCORE = 0.65
HIGH_SCORE = 0.85
EULER = 0.5772156649015329

FOREST = "tree INT, rows INT, split INT, cut DOUBLE, low INT, high INT, depth DOUBLE, node INT"


def mean_path(rows: float) -> float:
    """Average path length of an unsuccessful search among ``rows`` rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (np.log(rows - 1.0) + EULER) - 2.0 * (rows - 1.0) / rows


def grow(features: np.ndarray, seed: int) -> list[tuple]:
    """One isolation tree as rows (split, cut, low, high, depth, node); split -1 is a leaf."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, len(features)))))
    nodes: list[tuple] = []
    work = [(0, np.arange(len(features)), 0)]
    taken = 1
    while work:
        node, rows, level = work.pop()
        low, high = features[rows].min(axis=0), features[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append((-1, 0.0, -1, -1, level + mean_path(len(rows)), node))
            continue
        split = int(rng.choice(varying))
        cut = float(rng.uniform(low[split], high[split]))
        below = features[rows, split] <= cut
        nodes.append((split, cut, taken, taken + 1, 0.0, node))
        work.append((taken, rows[below], level + 1))
        work.append((taken + 1, rows[~below], level + 1))
        taken += 2
    return nodes


class LowestPriorities:
    """The ``size`` rows of lowest priority per tree of those offered, as row numbers."""

    def __init__(self, trees: int, size: int):
        self.size = size
        self.salts = _mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.priority = [np.zeros(0, dtype=np.uint64) for _ in range(trees)]
        self.row = [np.zeros(0, dtype=np.int64) for _ in range(trees)]
        self.limit = [np.uint64(0xFFFFFFFFFFFFFFFF)] * trees

    def offer(self, hashes: np.ndarray, first: int) -> None:
        """Rows with these hashes of their ids, numbered from ``first``."""
        for tree, salt in enumerate(self.salts):
            priority = _mixed(hashes ^ salt)
            better = np.flatnonzero(priority <= self.limit[tree])
            if len(better):
                both = np.concatenate([self.priority[tree], priority[better]])
                rows = np.concatenate([self.row[tree], better + first])
                kept = np.argsort(both, kind="stable")[: self.size]
                self.priority[tree], self.row[tree] = both[kept], rows[kept]
                if len(kept) == self.size:
                    self.limit[tree] = self.priority[tree][-1]


def _mixed(words: np.ndarray) -> np.ndarray:
    words = (words ^ words >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    words = (words ^ words >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return words ^ words >> np.uint64(31)


def forest_sample(
    df: DataFrame, key: str, features: str, trees: int = TREES, seed: int = 42, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """``tree_rows`` rows for each of ``trees`` trees (all, if fewer): tree, _n, x.

    They are chosen among all rows by hashes of the unique ``key``, so that a rerun picks the
    same. A task sends on ``trees * tree_rows`` rows at most, however many it reads.
    """
    rows = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(features).cast("array<double>").alias("x"))

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists, held, seen = LowestPriorities(trees, tree_rows), {}, 0
        for pdf in batches:
            if not len(pdf):
                continue
            lists.offer(pdf["h"].to_numpy().view(np.uint64), seen)
            vectors = pdf["x"].to_numpy()
            wanted = np.unique(np.concatenate(lists.row))
            held = {r: held[r] if r < seen else (pdf["h"].iat[r - seen], vectors[r - seen]) for r in wanted.tolist()}
            seen += len(pdf)
        for tree, (priority, row) in enumerate(zip(lists.priority, lists.row)):
            if len(row):
                hashes, vectors = zip(*(held[r] for r in row.tolist()))
                signed = (priority ^ np.uint64(1 << 63)).view(np.int64)
                yield pd.DataFrame({"tree": tree, "priority": signed, "h": hashes, "x": vectors})

    offered = rows.mapInPandas(lowest, "tree INT, priority BIGINT, h BIGINT, x ARRAY<DOUBLE>")
    pick = W.partitionBy("tree").orderBy("priority", "h")
    return offered.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= tree_rows).select("tree", "_n", "x")


def grow_forest(sample: DataFrame, seed: int = 42) -> DataFrame:
    """Node table of the forest: one group per tree, its sample in each."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("_n")
        matrix = np.array(ordered["x"].tolist(), dtype=np.float32).astype(np.float64)
        tree = int(ordered["tree"].iloc[0])
        out = pd.DataFrame(grow(matrix, seed + tree), columns=["split", "cut", "low", "high", "depth", "node"])
        return out.assign(tree=tree, rows=len(matrix))[["tree", "rows", "split", "cut", "low", "high", "depth", "node"]]

    return sample.groupBy("tree").applyInPandas(one, FOREST)


def forest_scores(df: DataFrame, features: str, forest: DataFrame, out: str = "raw_score") -> DataFrame:
    """Add the anomaly score 2**(-mean depth / expected depth) of every row."""
    # at most trees * (2 * tree_rows - 1) node rows
    nodes = forest.orderBy("tree", "node").toPandas()
    trees = [g for _, g in nodes.groupby("tree")]
    packed = [tuple(g[c].to_numpy() for c in ("split", "cut", "low", "high", "depth")) for g in trees]
    expected = mean_path(int(nodes["rows"].max())) if len(nodes) else 1.0
    shared = df.sparkSession.sparkContext.broadcast((packed, expected or 1.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest_arrays, scale = shared.value
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series(dtype="float64")})
                continue
            matrix = np.array(pdf[features].tolist(), dtype=np.float32).astype(np.float64)
            depth = np.zeros(len(matrix))
            for split, cut, low, high, leaf in forest_arrays:
                at = np.zeros(len(matrix), dtype=np.int64)
                moving = np.flatnonzero(split[at] >= 0)
                while len(moving):
                    here = at[moving]
                    down = matrix[moving, split[here]] <= cut[here]
                    at[moving] = np.where(down, low[here], high[here])
                    moving = moving[split[at[moving]] >= 0]
                depth += leaf[at]
            yield pdf.assign(**{out: 2.0 ** (-depth / len(forest_arrays) / scale)})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return df.mapInPandas(run, schema)


def scaled(df: DataFrame, value: str, out: str) -> DataFrame:
    """Min-max scale over the whole table; a constant column becomes zero."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    score = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    # one-row table
    return df.join(F.broadcast(bounds), how="cross").withColumn(out, F.coalesce(score, F.lit(0.0))).drop("_lo", "_hi")


def above_cutoff(df: DataFrame, score: str, share: float) -> DataFrame:
    """Rows at or above the exact quantile ``share`` and above 0.65, with a confidence."""
    cut = exact_quantiles(df.select(score), [], score, [share]).select(F.col("quantile").alias("_cut"))
    # one-row table
    return (
        df.join(F.broadcast(cut), how="cross")
        .where((F.col(score) >= F.col("_cut")) & (F.col(score) > MIN_SCORE))
        .withColumn("confidence", F.when(F.col(score) > HIGH_SCORE, "HIGH").otherwise("MEDIUM"))
        .drop("_cut")
    )


def scored_outliers(
    candidates: DataFrame,
    key: str,
    features: str,
    reference: DataFrame | None = None,
    seed: int = 42,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Candidates (all columns but the features) with ``anomaly_score`` in 0..1.

    The forest of ``trees`` trees learns from ``reference`` where it has at least five rows,
    else from the candidates themselves, each tree from ``tree_rows`` rows drawn from all.
    """
    use_reference = reference is not None and len(reference.select(key).take(MIN_ROWS)) >= MIN_ROWS
    sample = forest_sample(reference if use_reference else candidates, key, features, trees, seed, tree_rows)
    forest = grow_forest(sample, seed)
    method = "IsolationForest (Reference Trained)" if use_reference else "IsolationForest (Internal Population)"
    raw = forest_scores(candidates, features, forest).drop(features).withColumn("method", F.lit(method))
    return scaled(checkpointed(raw), "raw_score", "anomaly_score").drop("raw_score")


def outliers(
    candidates: DataFrame,
    key: str,
    features: str,
    reference: DataFrame | None = None,
    share: float = 0.95,
    seed: int = 42,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Flagged candidates; none where there are fewer than five."""
    if len(candidates.select(key).take(MIN_ROWS)) < MIN_ROWS:
        empty = candidates.drop(features).where(F.lit(False))
        return empty.withColumns(
            {"method": F.lit(""), "anomaly_score": F.lit(0.0), "confidence": F.lit("")}
        )
    scored = scored_outliers(candidates, key, features, reference, seed, trees, tree_rows)
    return above_cutoff(scored, "anomaly_score", share)


def outlier_summary(scored: DataFrame, flagged: DataFrame, has_reference: bool) -> DataFrame:
    """Mean score, confidence and counts as one row."""
    overall = scored.agg(
        F.round(F.avg("anomaly_score"), 2).alias("ood_score"), F.count(F.lit(1)).alias("total_evaluated")
    )
    return overall.join(flagged.agg(F.count(F.lit(1)).alias("affected_count")), how="cross").withColumn(
        "confidence",
        F.when(F.col("total_evaluated") < MIN_ROWS, 0.3).otherwise(0.88 if has_reference else 0.75),
    )
