"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation of the hash space gives two values of a set: its minimum and its maximum.
Either agrees between two sets with a chance equal to their Jaccard similarity, so a
signature of 2K values costs K hash evaluations and varies less than K minima. Bands of two
permutations (four values) are the bucket keys. Candidates of the buckets are confirmed in
two steps: first every set against the one earlier set it shares most buckets with, and then
all pairs of a bucket that are still in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import map_rows, masked, unmasked
from assaykit.operators.clusters import connected
from assaykit.operators.skew import lookup_join, salted_join
from assaykit.session import checkpointed

SHINGLE = 2
#: Links have 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: Bands of two permutations each. A pair at the similarity of a link misses every band with
#: a chance of (1 - 0.8 ** 4) ** 24 = 3e-6, which falls quickly above it.
BANDS = 24
SEED = 20
#: Sets of one bucket compared in one go; larger buckets are dealt into tiles that meet in pairs.
TILE = 1_000
#: Most classes of a tally. Larger sets have a coarser tally, which rules out fewer pairs.
TALLY = 4_096


class MinMax:
    """Signatures of hashed sets: minimum and maximum under each permutation."""

    def __init__(self, bands: int = BANDS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.bands = bands
        self.times = draw.integers(0, 1 << 63, 2 * bands, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.plus = draw.integers(0, 1 << 63, 2 * bands, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Minima and maxima, alternating, under the permutations h -> times * h + plus of 64-bit words."""
        low = np.full(2 * self.bands, np.iinfo(np.uint64).max, dtype=np.uint64)
        high = np.zeros(2 * self.bands, dtype=np.uint64)
        for at in range(0, len(hashes), 4_096):
            part = self.times[:, None] * hashes[None, at : at + 4_096] + self.plus[:, None]
            np.minimum(low, part.min(axis=1), out=low)
            np.maximum(high, part.max(axis=1), out=high)
        return np.stack([low, high], axis=1).ravel()

    def keys(self, signature: np.ndarray) -> list[int]:
        """One bucket key per band, a hash of its four values and its number."""
        mixed = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in signature.reshape(self.bands, 4).T:
            mixed = (mixed ^ column) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
        return mixed.view(np.int64).tolist()


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles.

    A-Z are lower-cased, words are runs without ASCII white space. Fewer words than a
    shingle are one shingle; null or no word gives the empty set.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    digest = xxhash.xxh64_intdigest
    found = {digest(s) for s in set(joined)}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def signatures(texts: Column, shingle: int = SHINGLE, bands: int = BANDS) -> Column:
    """Per text a struct of its set: size, 128-bit digest, bucket keys; only the size for the empty set."""
    kind = "struct<n: int, d1: bigint, d2: bigint, keys: array<bigint>>"

    @F.arrow_udf(kind)
    def signed(values: pa.Array) -> pa.Array:
        import xxhash

        hashing = MinMax(bands)
        out = []
        for value in values:
            hashes = shingle_hashes(value.as_py(), shingle)
            if not len(hashes):
                out.append((0, None, None, None))
                continue
            d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype=np.int64).tolist()
            out.append((len(hashes), d1, d2, hashing.keys(hashing.signature(hashes))))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*out)) or [()] * 4
        arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
        return pa.StructArray.from_arrays(arrays, ["n", "d1", "d2", "keys"])

    return signed(texts)


def tally(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each class of equal leading bits, about one class a hash.

    Two sets have at most as many hashes in common as the smaller counts of all classes add
    up to, which rules out most pairs below a similarity without the sets themselves.
    """
    bits = min(TALLY, max(2, len(hashes))).bit_length() - 1
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint16).tobytes()


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(_node, _text) as (_node, _set, _tally), the sorted distinct shingle hashes and their tally."""

    def of(node: int, text: str) -> tuple:
        hashes = shingle_hashes(text, shingle)
        return node, hashes.view(np.int64), tally(hashes)

    return map_rows(texts, lambda: lambda rows: [of(*r) for r in rows], "_node bigint, _set array<bigint>, _tally binary")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    tile: int = TILE,
) -> DataFrame:
    """Documents with ``n_shingles``, ``component_id`` and ``is_first``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of
    distinct word shingles; a component's id is its smallest document id, null only if all
    its ids are null. ``is_first`` is true for one row of every component, one with that id.
    Null and empty texts and those of white space have no shingles and are linked with
    nothing: each such row is a component of its own. Equal sets are folded before any
    search, so copies, ties and repeated rows cost one comparison. Whole texts count,
    however long. An empty table gives an empty result. The columns in ``keep``, all by
    default, pass through; those named like a result give way to it.

    A link is found if the sets share a bucket, see ``BANDS``; every link reported is true.
    """
    kept = docs.select(*(docs.columns if keep is None else keep))
    rows, name = masked(docs)
    text = F.col(name[text_col])
    signed = rows.select(
        *[F.col(name[c]).alias(f"_k{i}") for i, c in enumerate(kept.columns)],
        F.col(name[id_col]).alias("_id"), *_text_key(text), F.monotonically_increasing_id().alias("_row"),
        signatures(text, shingle, bands).alias("_s"),
    )
    # written once, so the row numbers stay what they are
    found = checkpointed(signed.toDF(*[f"_c{i}" for i in range(len(kept.columns))], *signed.columns[len(kept.columns) :]))
    texts = rows.select(text.alias("_text"), *_text_key(text))
    joined = salted_join(
        found.withColumns({"_d1": F.col("_s.d1"), "_d2": F.col("_s.d2"), "_n": F.col("_s.n")}).drop("_s"),
        components(found, texts, shingle, percent, tile), ["_d1", "_d2"], "left",
    )
    empty = F.col("_n") == 0
    return unmasked(
        joined,
        kept,
        {
            "n_shingles": F.col("_n").cast("long"),
            "component_id": F.when(empty, F.col("_id")).otherwise(F.col("_first._id")),
            "is_first": empty | (F.col("_first._row") == F.col("_row")),
        },
    )


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("second"), text).alias("_h2")]


def components(found: DataFrame, texts: DataFrame, shingle: int, percent: int, tile: int) -> DataFrame:
    """(_d1, _d2, _first) per distinct set: the row with the smallest id of its component.

    ``found`` has (_id, _row, _h1, _h2, _s) per document; ``texts`` (_text, _h1, _h2).
    """
    sized = found.where("_s.n > 0")
    rep = F.struct("_row", "_h1", "_h2", "_s.n", "_s.keys")
    nodes = checkpointed(
        sized.groupBy("_s.d1", "_s.d2")
        .agg(F.min(rep).alias("_rep"), F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_first"))
        .select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "_first", "_rep.*")
        .withColumnRenamed("_row", "_node")
    )
    members = _shared_buckets(nodes)
    sets = _candidate_sets(nodes, members, texts, shingle)
    best = checkpointed(_best_pivots(members, percent))
    pairs = best.select(F.col("_pivot").alias("a"), F.col("_node").alias("b"))
    sure = checkpointed(_confirmed(pairs, sets, percent))
    merged = checkpointed(connected(sure))
    while True:
        # the nearest first: most of what belongs together is then joined by few comparisons
        likely = _open_pairs(sets, nodes, members, best, merged, percent, tile, nearest=True)
        more = checkpointed(_confirmed(likely, sets, percent))
        if more.limit(1).count() == 0:
            break
        sure = checkpointed(sure.unionByName(more))
        merged = checkpointed(connected(sure))
    rest = _confirmed(_open_pairs(sets, nodes, members, best, merged, percent, tile), sets, percent)
    roots = connected(checkpointed(sure.unionByName(rest))).select(F.col("node").alias("_node"), F.col("seed").alias("_root"))
    rooted = checkpointed(
        nodes.select("_d1", "_d2", "_node", "_first").join(roots, "_node", "left").select(
            "_d1", "_d2", "_first", F.coalesce("_root", "_node").alias("_root")
        )
    )
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("_first"))
    return salted_join(rooted.select("_root", "_d1", "_d2"), smallest, ["_root"], "inner").select("_d1", "_d2", "_first")


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """(_key, _node, _n, _pivot, _pivot_n) of buckets with several sets.

    The pivot of a bucket is the set that meets most others in all its buckets, ties to the
    earliest: the text that others were copied from, where there is one.
    """
    keyed = nodes.select(F.explode("keys").alias("_key"), "_node", F.col("n").alias("_n"))
    shared = checkpointed(
        keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    )
    met = checkpointed(lookup_join(keyed, shared, ["_key"], "inner"))
    known = met.groupBy("_node").agg(F.sum("_size").alias("_known"))
    ranked = F.struct("_known", (-F.col("_node")).alias("_late"), F.col("_n").alias("_pivot_n"))
    pivots = checkpointed(
        met.join(known, "_node").groupBy("_key").agg(F.max(ranked).alias("_p"))
        .select("_key", (-F.col("_p._late")).alias("_pivot"), F.col("_p._pivot_n").alias("_pivot_n"))
    )
    return checkpointed(lookup_join(met.drop("_size"), pivots, ["_key"], "inner"))


def _candidate_sets(nodes: DataFrame, members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(_node, _set) of the sets that share a bucket, made again from one text of each."""
    wanted = checkpointed(
        nodes.select("_node", "_h1", "_h2").join(members.select("_node").distinct(), "_node", "left_semi")
    )
    near = lookup_join(texts, wanted, ["_h1", "_h2"], "inner")
    one = near.groupBy("_node").agg(F.first("_text").alias("_text"))
    return checkpointed(_shingle_sets(one, shingle))


def _alike_in_size(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _best_pivots(members: DataFrame, percent: int) -> DataFrame:
    """(_node, _pivot): the bucket leader a set shares most buckets with, ties to the earliest."""
    met = members.where((F.col("_node") != F.col("_pivot")) & _alike_in_size(F.col("_n"), F.col("_pivot_n"), percent))
    shared = met.groupBy("_node", "_pivot").agg(F.count(F.lit(1)).alias("_times"))
    best = shared.groupBy("_node").agg(F.max(F.struct("_times", (-F.col("_pivot")).alias("_late"))).alias("_m"))
    return best.select("_node", (-F.col("_m._late")).alias("_pivot"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that are similar enough, by their full sets."""
    left = sets.select(F.col("_node").alias("a"), F.col("_set").alias("_a"))
    right = sets.select(F.col("_node").alias("b"), F.col("_set").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    met = pairs.join(right, "b").join(left, "a")
    return met.where(both * 100 >= (F.size("_a") + F.size("_b") - both) * percent).select("a", "b")


def _open_pairs(
    sets: DataFrame, nodes: DataFrame, members: DataFrame, best: DataFrame, merged: DataFrame, percent: int, tile: int, nearest: bool = False
) -> DataFrame:
    """Pairs (a, b) of one bucket, not compared yet and in different components so far.

    Pairs are left out where sizes or tallies rule a link out. A pair counts in the first
    bucket it shares only. With ``nearest`` a set has at most one pair of each bucket, the
    likeliest by its tally.
    A bucket with more than ``tile`` sets is dealt into tiles by hash and every two
    tiles meet in a task of their own.
    """
    labels = merged.select(F.col("node").alias("_node"), F.col("seed").alias("_label"))
    labelled = (
        members.join(labels, "_node", "left").join(best.withColumnRenamed("_pivot", "_best"), "_node", "left")
        .select("_key", "_node", "_n", "_best", F.coalesce("_label", "_node").alias("_label"))
    )
    labelled = checkpointed(labelled)
    mixed = checkpointed(
        labelled.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"), F.min("_label").alias("_low"), F.max("_label").alias("_high"))
        .where("_low < _high")
        .select("_key", F.ceil(F.col("_size") / tile).cast("int").alias("_tiles"))
    )
    dealt = (
        lookup_join(labelled, mixed, ["_key"], "inner")
        .join(nodes.select("_node", "keys"), "_node")
        .join(sets.select("_node", "_tally"), "_node")
        .withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_tiles")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .select(
            "_key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
            "_own", "_node", "_n", "_best", "_label", "keys", "_tally",
        )
    )

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames):
            yield _unlike_labels(group, percent, nearest)

    grouped = dealt.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_node")
    return grouped.mapInPandas(meet, "a bigint, b bigint").distinct()


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole runs of (_key, _i, _j) from frames sorted by them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        marks = frame[["_key", "_i", "_j"]].to_numpy()
        starts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        if held and (held[-1][["_key", "_i", "_j"]].to_numpy()[-1] != marks[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        for start, end in zip(np.r_[0, starts], np.r_[starts, len(frame)]):
            held.append(frame.iloc[start:end])
            if end < len(frame):
                yield pd.concat(held, ignore_index=True)
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _unlike_labels(group: pd.DataFrame, percent: int, nearest: bool) -> pd.DataFrame:
    """Pairs of one bucket (or two tiles of one) that are worth a look at the full sets."""
    node, size, label = (group[c].to_numpy() for c in ("_node", "_n", "_label"))
    best = group["_best"].fillna(-1).to_numpy().astype(np.int64)
    own = group["_own"].to_numpy()
    across = group["_i"].iat[0] != group["_j"].iat[0]
    keys = np.stack(group["keys"].to_numpy())
    band = int(np.argmax(keys[0] == group["_key"].iat[0]))
    tallies = _Tallies(group["_tally"])
    left, right = [], []
    for k in range(len(group) - (not nearest)):
        later = slice(0 if nearest else k + 1, None)
        open_ = (label[later] != label[k]) & (best[later] != node[k]) & (node[later] != best[k])
        open_ &= np.minimum(size[later], size[k]) * 100 >= np.maximum(size[later], size[k]) * percent
        if across:
            open_ &= own[later] != own[k]
        at = np.flatnonzero(open_) + later.start
        at = at[np.argmax(keys[at] == keys[k], axis=1) == band]
        common = tallies.common(k, at)
        union = size[at] + size[k] - common
        good = common * 100 >= union * percent
        at = at[good]
        if nearest and len(at):
            at = at[np.argmax(common[good] / union[good])][None]
        left.append(np.full(len(at), node[k]))
        right.append(node[at])
    a, b = (np.concatenate(side or [node[:0]]) for side in (left, right))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


class _Tallies:
    """Tallies of one bucket's sets, folded to fewer classes where two differ in number."""

    def __init__(self, packed: pd.Series):
        self.own = [np.frombuffer(p, dtype=np.uint16) for p in packed]
        self.classes = np.array([len(t) for t in self.own])
        self.stacks = {int(c): np.stack([_folded(t, c) for t in self.own]) for c in np.unique(self.classes)}

    def common(self, k: int, at: np.ndarray) -> np.ndarray:
        """An upper bound of what set k has in common with each of the sets ``at``."""
        out = np.zeros(len(at), dtype=np.int64)
        classes = np.minimum(self.classes[at], self.classes[k])
        for c in np.unique(classes):
            stack, here = self.stacks[int(c)], np.flatnonzero(classes == c)
            for part in range(0, len(here), 512):
                some = here[part : part + 512]
                out[some] = np.minimum(stack[at[some]], stack[k]).sum(axis=1, dtype=np.int64)
        return out


def _folded(counts: np.ndarray, classes: int) -> np.ndarray:
    """Counts in ``classes`` classes of fewer leading bits; a coarser one stays as it is, unused."""
    if len(counts) <= classes:
        return np.resize(counts, classes)
    return counts.reshape(classes, -1).sum(axis=1, dtype=np.uint16)
