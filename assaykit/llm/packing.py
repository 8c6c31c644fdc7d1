"""Pack documents into fixed-length sequences: best fit, then swap-based local search.

Documents become runs of token ids; only longer ones are cut. Pieces are dealt by hash into
groups of bounded size and every group is packed on its own: best-fit decreasing first, then
exchanges of pieces between underfull bins that raise the sum of squared fills, so that some
bins fill up and others empty. What is still underfull in any group is packed again together
with other groups' leavings, so that hardly a bin is lost to the grouping.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import WORD, map_rows
from assaykit.session import checkpointed

LENGTH = 2048
END_ID = 0
#: Pieces packed together by one task.
GROUP_ROWS = 30_000
#: Distinct words and parts of words whose ids a worker process remembers.
WORDS_KEPT = 400_000
UNITS_KEPT = 1_000_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters, digits, marks and white space whose borders the vocabulary surely cuts at. Not
#: here: apostrophes (contractions), "<" (special tokens), combining marks, other scripts.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = "!-&(-/:;=-@\\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9\\x20\\x09-\\x0D]*")
_UNITS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|[0-9]")
_WORDS = re.compile(WORD)


def _byte_signs() -> dict[int, str]:
    """The vocabulary's signs for accented Latin letters: one per UTF-8 byte, printable ones
    standing for themselves, the others numbered from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    sign = {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTES = _byte_signs()


class Encoder:
    """Text to little-endian unsigned 32-bit ids.

    The vocabulary drops white space, never joins across it and lower-cases; within a plain
    word it cuts between letters, marks and digits. So the ids of a text are those of such
    units. Units are encoded once per worker process and remembered, and so are the words
    met first, in two tables of bounded size. A word with other characters is a unit as it
    stands, and the tokenizer encodes it in full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = self.model.model
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        words = text.split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    found[at] = self._word(words[at])
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        """Ids of what stands between two blanks."""
        if _PLAIN.fullmatch(word):
            units = _UNITS.findall(word.lower())
        else:
            units = []
            for part in _WORDS.findall(word):
                units += _UNITS.findall(part.lower()) if _PLAIN.fullmatch(part) else [part]
        known = self.units
        ids = b"".join([known.get(unit) or self._unit(unit) for unit in units])
        if len(self.words) < WORDS_KEPT and len(word) < 40:
            self.words[word] = ids
        return ids

    def _unit(self, unit: str) -> bytes:
        if _PLAIN.fullmatch(unit):
            # already normalised and cut, so the merges alone give its ids
            found = [t.id for t in self.merges.tokenize(unit if unit.isascii() else unit.translate(_BYTES))]
        else:
            found = self.model.encode(unit, add_special_tokens=False).ids
        if len(self.units) >= UNITS_KEPT:
            # frequent units are met first, so the later half is forgotten
            for old in list(islice(self.units, UNITS_KEPT // 2, None)):
                del self.units[old]
        ids = self.units[unit] = array("I", found).tobytes()
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    path = path or tokenizer_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    with_ids: bool = False,
    path: str | None = None,
) -> DataFrame:
    """Runs of at most ``length`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids and then id 0; a null or empty text is that id alone. ``ids``
    are little-endian unsigned 32-bit. ``path`` names the tokenizer file on the executors.
    """

    def make() -> Callable[..., list[tuple]]:
        encode = encoder(path)

        def cut(doc_id, text):
            ids = encode(text or "") + END_ID.to_bytes(4, "little")
            rows = []
            for n, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                row = (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part))
                rows.append((*row, part) if with_ids else row)
            return rows

        return lambda batch: [piece for row in batch for piece in cut(*row)]

    kind = docs.select(id_col).dtypes[0][1]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return map_rows(docs.select(id_col, text_col), make, schema)


def pack(found: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``; other columns pass through.

    Rows are the unit: repeated ones are packed as often as they come, null ids as well.
    Full pieces are sequences of their own. Groups are cut by hash and so stay even; a
    row number, stored with the pieces, makes equal rows different.
    """
    columns = found.columns
    stored = checkpointed(found.withColumn("_row", F.monotonically_increasing_id()))
    rows = stored.count()
    keyed = stored.withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), F.lit(max(1, -(-rows // group_rows))))
    )
    first = checkpointed(_packed(keyed, length, 0))
    # bins that stayed underfull meet those of other groups; their share is small, and so are these groups
    total = first.groupBy("sequence_id").agg(F.sum("length").alias("_fill"))
    open_bins = total.where(F.col("_fill") < length * 0.97)
    loose = first.join(open_bins.select("sequence_id"), "sequence_id", "left_semi")
    n_loose = loose.count()
    if n_loose == 0 or rows <= group_rows:
        return first.select(*columns, "sequence_id", "offset")
    groups = max(1, -(-n_loose // group_rows))
    again = loose.drop("sequence_id", "offset").withColumn(
        "_group", F.pmod(F.xxhash64(F.lit(2), "doc_id", "piece", "ids_crc32", "_row"), F.lit(groups))
    )
    second = _packed(again, length, 1)
    settled = first.join(open_bins.select("sequence_id"), "sequence_id", "left_anti")
    return settled.select(*columns, "sequence_id", "offset").unionByName(second.select(*columns, "sequence_id", "offset"))


def _packed(keyed: DataFrame, length: int, level: int) -> DataFrame:
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*keyed.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = place(pdf["length"].to_numpy(), length)
        base = (int(pdf["_group"].iloc[0]) * 2 + level) << 32
        return pdf.assign(sequence_id=bins + base, offset=offsets)

    return keyed.groupBy("_group").applyInPandas(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, given piece lengths in falling order."""
    bins = best_fit(lengths, capacity)
    bins = improve(bins, lengths, capacity)
    order = np.argsort(bins, kind="stable")
    sizes = lengths[order].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(starts, ends - sizes, 0))
    offsets = np.empty(len(order), dtype=np.int64)
    offsets[order] = ends - sizes - base
    return bins.astype(np.int64), offsets


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Each piece goes to the fullest bin that still takes it."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    bins = np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = made, capacity
            made += 1
        else:
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                rooms.pop(at)
        bins[i] = b
        room -= size
        if room:
            if not with_room[room]:
                insort(rooms, room)
            with_room[room].append(b)
    return bins


def improve(bins: np.ndarray, lengths: np.ndarray, capacity: int, rounds: int = 8) -> np.ndarray:
    """Local search over underfull bins until no exchange raises the squared fill.

    The fullest underfull bin takes what fits it best from the emptier ones: a piece moved
    whole, one of its pieces for a longer one, or two of its pieces for one longer (and one
    for two). Every exchange moves length towards the fuller bin, so the sum of squares
    rises and the search ends; bins that lose all pieces vanish.
    """
    fills = np.bincount(bins, weights=lengths).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    loose = np.flatnonzero(fills < capacity)
    content: dict[int, list[int]] = {int(b): [] for b in loose}
    for i in np.flatnonzero(np.isin(bins, loose)).tolist():
        content[int(bins[i])].append(i)
    size = lengths.tolist()
    bins = bins.copy()
    for _ in range(rounds):
        changed = False
        order = sorted(content, key=lambda b: -fills[b])
        # emptiest first: their pieces are offered to the fuller bins
        for donor in reversed(order):
            if not content[donor]:
                continue
            for taker in order:
                if taker == donor or not content[donor]:
                    break
                room = capacity - int(fills[taker])
                if room <= 0 or fills[taker] < fills[donor]:
                    continue
                move = _exchange([size[i] for i in content[taker]], [size[i] for i in content[donor]], room)
                if move is None:
                    continue
                give, take = move
                out = [content[taker][k] for k in give]
                into = [content[donor][k] for k in take]
                content[taker] = [i for i in content[taker] if i not in out] + into
                content[donor] = [i for i in content[donor] if i not in into] + out
                shift = sum(size[i] for i in into) - sum(size[i] for i in out)
                fills[taker] += shift
                fills[donor] -= shift
                bins[into], bins[out] = taker, donor
                changed = True
        content = {b: c for b, c in content.items() if c and fills[b] < capacity}
        if not changed:
            break
    used = np.unique(bins)
    return np.searchsorted(used, bins)


def _exchange(mine: list[int], theirs: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """The exchange that fills ``room`` furthest: places given and places taken."""
    best, found = 0, None
    firsts: dict[int, int] = {}
    for k, x in enumerate(theirs):
        firsts.setdefault(x, k)
        if best < x <= room:
            best, found = x, ([], [k])
    values = sorted(firsts)

    def top(limit: int) -> int:
        at = bisect_left(values, limit + 1)
        return values[at - 1] if at else -1

    own = sorted({x: k for k, x in enumerate(mine)}.items())[:64]
    for x, k in own:
        y = top(x + room)
        if y - x > best:
            best, found = y - x, ([k], [firsts[y]])
    for n, (x, k) in enumerate(own):
        for x2, k2 in own[n + 1 :]:
            y = top(x + x2 + room)
            if y - x - x2 > best:
                best, found = y - x - x2, ([k, k2], [firsts[y]])
            if y == values[-1] if values else True:
                break
    for n, y in enumerate(values[:64]):
        for y2 in values[n + 1 : 64]:
            for x, k in own:
                gain = y + y2 - x
                if best < gain <= room:
                    best, found = gain, ([k], [firsts[y], firsts[y2]])
    return found
