"""Near-duplicate documents by SimHash, found with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into three segments. The perfect binary Golay code decodes
every 23-bit word to one codeword at most three bits away, so nearby segments decode to few
codewords. With at most four differing bits some two segments differ in at most two bits
together, and then the fingerprints share one of the keys made here from the codeword
indices of two segments. Fingerprints meet on the keys and are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import masked, unmasked
from assaykit.operators.clusters import connected
from assaykit.operators.skew import salted_join
from assaykit.session import checkpointed

SHINGLE = 4
MAX_BITS = 4
HASH_SEED = 42
#: Fingerprints of one key compared in one go; keys with more are dealt into tiles.
TILE = 2_000
_SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: a bit is set where over half of the shingles' hashes have it.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are kept with
    repeats. Fewer words than a shingle are one shingle; null or no word gives zero.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 20_000):
        last = min(n, at + 20_000)
        spans = zip(starts[at:last], ends[at + shingle - 1 : last + shingle - 1] if len(words) >= shingle else ends[-1:])
        counts += _bit_counts(b"".join([digest(joined[s : e - 1], HASH_SEED) for s, e in spans]))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte hashes have each bit, highest first."""
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
    spare = -len(bits) % 255
    lanes = np.concatenate([bits, np.zeros((spare, 64), np.uint8)]).view(np.uint64).reshape(-1, 255, 8)
    return lanes.sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


class Golay:
    """The (23, 12) Golay code, its tables made from the generator polynomial."""

    GENERATOR = 0b101011100011

    def __init__(self):
        high = np.arange(4096, dtype=np.int64) << 11
        rest = high.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, self.GENERATOR << (bit - 11), 0)
        self.check = rest  # remainder of every message at its place
        errors = np.zeros(2048, dtype=np.int64)
        ones = 1 << np.arange(23, dtype=np.int64)
        pairs = ones[:, None] | ones[None, :]
        triples = pairs[:, :, None] | ones[None, None, :]
        patterns = np.unique(triples)  # one, two or three bits
        errors[self.syndrome(patterns)] = patterns
        self.errors = errors

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.check[words >> 11] ^ (words & 0x7FF)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit message of the only codeword within three bits."""
        return (words ^ self.errors[self.syndrome(words)]) >> 11


def golay_keys(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint's keys, each once.

    Per pair of segments a key holds the index of one segment and an index that the other
    decodes to when at most one of its bits is flipped, for either segment as the first.
    """
    own, near = [], []
    for start, width in _SEGMENTS:
        words = (prints >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
        flips = words[:, None] ^ np.r_[0, 1 << np.arange(width, dtype=np.int64)][None, :]
        found = np.sort(code.index(flips), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        own.append(code.index(words))
        near.append(found)
    rows, keys = [], []
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        base = np.int64(n) << 24
        at, k = np.nonzero(near[j] >= 0)
        rows.append(at)
        keys.append(base | own[i][at] << 12 | near[j][at, k])
        at, k = np.nonzero((near[i] >= 0) & (near[i] != own[i][:, None]))
        rows.append(at)
        keys.append(base | near[i][at, k] << 12 | own[j][at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(texts: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of every text as a signed long."""

    @F.pandas_udf("bigint")
    def prints(values: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(v, shingle) for v in values), dtype=np.uint64, count=len(values))
        return pd.Series(found.view(np.int64))

    return prints(texts)


def links(prints: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``max_bits`` (4 at most).

    Per key a spanning forest of its links is given, not all pairs. Keys with more than
    ``tile`` fingerprints are dealt by hash into tiles and every two tiles meet in a task of
    their own, so no task holds more than about two tiles and no link is lost.
    """
    if max_bits > 4:
        raise ValueError("the keys are complete for at most 4 differing bits")

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Golay()
        for frame in frames:
            values = frame["_print"].to_numpy()
            for at in range(0, len(values), 4_000):
                part = values[at : at + 4_000]
                row, key = golay_keys(part.view(np.uint64), code)
                yield pd.DataFrame({"_key": key, "_print": part[row]})

    keyed = checkpointed(prints.mapInPandas(keys, "_key bigint, _print bigint"))
    crowded = checkpointed(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile))
    tiles = F.coalesce(F.ceil(F.col("_n") / tile), F.lit(1)).cast("int")
    met = keyed.join(crowded, "_key", "left").withColumn("_tiles", tiles).withColumn(
        "_own", F.pmod(F.xxhash64("_print"), F.col("_tiles")).cast("int")
    )
    dealt = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select(
        "_key", "_print", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    )

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            group = _group_numbers(frame)
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = frame.iloc[cut:]
            yield _linked(frame["_print"].to_numpy()[:cut], group[:cut], max_bits)
        if held is not None:
            yield _linked(held["_print"].to_numpy(), _group_numbers(held), max_bits)

    grouped = dealt.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_print")
    return grouped.mapInPandas(verify, "a bigint, b bigint").distinct()


def _group_numbers(frame: pd.DataFrame) -> np.ndarray:
    if not len(frame):
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(len(frame), dtype=bool)
    for column in ("_key", "_i", "_j"):
        values = frame[column].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _linked(values: np.ndarray, group: np.ndarray, max_bits: int) -> pd.DataFrame:
    """Links within each run of a group: small groups side by side, larger ones one by one."""
    prints = values.view(np.uint64)
    left, right = [], []
    if len(prints):
        sizes = np.bincount(group)
        small = np.flatnonzero(sizes[group] <= 8)
        own, of = prints[small], group[small]
        for d in range(1, 8):
            same = np.flatnonzero(of[d:] == of[:-d]) if len(of) > d else np.zeros(0, np.int64)
            hit = same[np.bitwise_count(own[same] ^ own[same + d]) <= max_bits]
            left.append(own[hit])
            right.append(own[hit + d])
        ends = np.cumsum(sizes)
        for g in np.flatnonzero(sizes > 8):
            _forest(prints[ends[g] - sizes[g] : ends[g]], max_bits, left, right)
    a = np.concatenate(left) if left else np.zeros(0, np.uint64)
    b = np.concatenate(right) if right else np.zeros(0, np.uint64)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _forest(prints: np.ndarray, max_bits: int, left: list, right: list) -> None:
    """Breadth first over one group; every fingerprint is met once, by the first that links to it."""
    open_ = np.unique(prints)
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            here = queue.pop()
            hit = np.bitwise_count(open_ ^ here) <= max_bits
            if hit.any():
                found, open_ = open_[hit], open_[~hit]
                left.append(np.full(len(found), here))
                right.append(found)
                queue.extend(found)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Documents with ``fingerprint`` (16 hex digits), ``component_id`` and ``is_first``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; a
    component's id is its smallest document id, null only if all its ids are null.
    ``is_first`` is true for one row of every component, one with that id. Every row is
    kept, repeated ones and empty texts too (all of fingerprint zero). The columns in
    ``keep``, all by default, pass through; those named like a result give way to it.
    """
    kept = docs.select(*(docs.columns if keep is None else keep))
    rows, name = masked(docs)
    numbered = rows.select(
        *[name[c] for c in kept.columns],
        F.col(name[id_col]).alias("_id"),
        fingerprints(F.col(name[text_col]), shingle).alias("_print"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # written once, so the row numbers stay what they are
    found = checkpointed(numbered.toDF(*[f"_c{i}" for i in range(len(kept.columns))], "_id", "_print", "_row"))
    joined = salted_join(found, components(found, max_bits), ["_print"], "inner")
    return unmasked(
        joined,
        kept,
        {
            "fingerprint": F.lpad(F.lower(F.hex("_print")), 16, "0"),
            "component_id": F.col("_first._id"),
            "is_first": F.col("_first._row") == F.col("_row"),
        },
    )


def components(found: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(_print, _first) per distinct fingerprint of rows (_id, _print, _row).

    ``_first`` names the row with the smallest id (null last) of the whole component.
    """
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_first")
    nodes = checkpointed(found.groupBy("_print").agg(first))
    joined = connected(checkpointed(links(nodes.select("_print"), max_bits)))
    roots = joined.select(F.col("node").alias("_print"), F.col("seed").alias("_root"))
    rooted = checkpointed(
        nodes.join(roots, "_print", "left").select("_print", F.coalesce("_root", "_print").alias("_root"), "_first")
    )
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("_first"))
    return salted_join(rooted.select("_root", "_print"), smallest, ["_root"], "inner").select("_print", "_first")
