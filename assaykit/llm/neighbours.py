"""Approximate nearest neighbours by collision counting over single projections.

A block of vectors is indexed by sorted arrays, one per projection. A query opens a window
around its own projection in every array and widens all of them step by step (virtual
rehashing: the same arrays serve every radius). A vector inside two thirds of the
windows is a candidate; when enough are found they are verified by their exact scores.
Blocks of vectors and blocks of queries of bounded size meet pair by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import checkpointed

#: Vectors per index and queries that meet it in one task.
BLOCK_ROWS = 16_000
QUERY_ROWS = 2_000
#: Projections, as whole orthonormal bases of at least so many directions.
PROJECTIONS = 64
#: Share of the windows a candidate has to be in; of a block at least this share, and this
#: many times the wanted partners, are verified.
THRESHOLD = 0.66
VERIFY, MANY = 0.2, 6
#: First half-width of the windows, in standard deviations of the projections, and its growth.
START, GROWTH = 0.9, 1.15
SEED = 5


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors = vectors
        norms = (vectors**2).sum(axis=1)
        # one more coordinate gives all vectors one length, so that near means large inner product
        self.top = norms.max() if len(norms) else 0.0
        self.scale = np.sqrt(self.top) or 1.0
        lifted = np.c_[vectors, np.sqrt(np.maximum(0.0, self.top - norms))] / self.scale
        d = lifted.shape[1]
        rng = np.random.default_rng(seed)
        bases = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(max(1, -(-projections // d)))]
        self.axes = np.concatenate(bases, axis=1)[:, : max(projections, d)] * np.sqrt(d)
        projected = (lifted @ self.axes).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        self.spread = float(projected.std()) or 1.0

    def candidates(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """Per query the places of the vectors in at least THRESHOLD of its windows, from the
        first width at which at least ``least`` of them are, or at which all are."""
        n = len(self.vectors)
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        at = np.c_[queries / np.where(lengths > 0, lengths, 1.0), np.zeros(len(queries))] @ self.axes
        need = THRESHOLD * at.shape[1]
        low = np.stack([np.searchsorted(row, v) for row, v in zip(self.sorted, at.T)], axis=1)
        high = low.copy()
        counts = np.zeros((len(queries), n), dtype=np.int16)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        active = np.arange(len(queries))
        width = START * self.spread
        while len(active):
            inner_low, inner_high = low[active], high[active]
            for j, row in enumerate(self.sorted):
                low[active, j] = np.minimum(np.searchsorted(row, at[active, j] - width), inner_low[:, j])
                high[active, j] = np.maximum(np.searchsorted(row, at[active, j] + width, side="right"), inner_high[:, j])
            going = []
            for k, q in enumerate(active):
                bounds = zip(self.order, low[q].tolist(), inner_low[k].tolist(), inner_high[k].tolist(), high[q].tolist())
                rings = [part for o, a, b, c, d in bounds for part in (o[a:b], o[c:d])]
                counts[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int16)
                found = np.flatnonzero(counts[q] >= need)
                if len(found) >= least or (low[q].max() == 0 and high[q].min() == n):
                    out[q] = found
                else:
                    going.append(q)
            active = np.array(going, dtype=np.int64)
            width *= GROWTH
        return out


def search(index: Index, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best verified candidates of every query within one block."""
    out_q, out_v, out_s = [], [], []
    least = min(len(ids), max(MANY * k, int(np.ceil(VERIFY * len(ids)))))

    def add(query_id, query, found):
        scores = np.einsum("ij,j->i", index.vectors[found], query)
        best = np.lexsort((ids[found], -scores))[:k]
        out_q.append(np.full(len(best), query_id))
        out_v.append(ids[found][best])
        out_s.append(scores[best])

    # a few queries at a time: each holds a count per vector of the block
    for start in range(0, len(query_ids), 128):
        some = queries[start : start + 128]
        for query_id, query, found in zip(query_ids[start : start + 128], some, index.candidates(some, least)):
            add(query_id, query, found[ids[found] != query_id])
    empty = [np.zeros(0, np.int64)]
    return pd.DataFrame(
        {
            "query_id": np.concatenate(out_q or empty).astype(np.int64),
            "vec_id": np.concatenate(out_v or empty).astype(np.int64),
            "score": np.concatenate(out_s or empty).astype(np.float64),
        }
    )


def usable(id_col: str, vec_col: str) -> Column:
    """Rows with an id and a vector of finite numbers, not all of them zero."""
    number = F.col(vec_col).cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(id_col).isNotNull() & finite & F.exists(number, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Per query its ``k`` best found partners: query_id, rank from 1, vec_id, score.

    ``queries`` says which rows ask; all usable rows are indexed and can be found. Scores
    are inner products of the original vectors in double precision, ties go to the smaller
    id. Rows with the query's id are never its partners, and a repeated row can be found as
    often as it comes. Unusable rows (see ``usable``) take no part. Vectors of different
    lengths never meet. A query without partners has no row. The search is approximate in
    which candidates it verifies; tests hold its recall against brute force.
    """
    rows = vectors.where(usable(id_col, vec_col)).select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(vec_col).cast("array<double>").alias("_vec"),
        F.size(vec_col).alias("_dim"),
        F.coalesce(queries, F.lit(False)).alias("_asks"),
    )
    stored = checkpointed(rows)
    n, asking = stored.agg(F.count(F.lit(1)), F.count_if("_asks")).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-asking // query_rows))
    block = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(query_blocks)).cast("int")
    data = stored.select(
        "_dim", block.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_q"), "_id", "_vec"
    )
    asks = stored.where("_asks").select(
        "_dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), query_block.alias("_q"), "_id", "_vec"
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return search(None, np.zeros(0), [], [], k)
        left = left.sort_values("_id", kind="stable")
        right = right.drop_duplicates("_id")
        return search(
            Index(np.stack(left["_vec"].to_numpy())), left["_id"].to_numpy(),
            right["_id"].to_numpy(), np.stack(right["_vec"].to_numpy()), k,
        )

    keys = ("_dim", "_b", "_q")
    found = data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
