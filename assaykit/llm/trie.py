"""A trie of conversation prefixes as a minimal-perfect-hash node table.

Every prefix of a conversation has a digest, the running sum of hashes of its turns and
their places. Equal digests are one node. Sums over subtrees are taken in shards: a shard
holds the paths of some conversations, gives each of its distinct digests a slot by a
minimal perfect hash, checks every slot against the digest it was made for, scatters the
nodes' own values into flat arrays and adds them up along an array of parent slots, deepest
first. A node's own value lies in the one shard of its smallest member, so the shards'
partial sums add up.

Nothing here holds a whole conversation: turns are put in order by range partitions, and
paths of more than ``BAND`` turns go through the shards band by band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed, shuffle_partitions

#: Conversations share the first turns of the first of each hundred, up to five.
HUNDRED = 100
SHARED = 6
#: Turns of a path that one shard looks at together; longer paths are cut into bands.
BAND = 1_024
#: Path rows of a shard on average.
SHARD_ROWS = 100_000
#: Member ids that are joined to one piece of text before they are hashed.
CHUNK = 1_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def perfect_slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Slots 0 to n - 1, each once, for n distinct digests of two 64-bit words.

    Level by level the digests are thrown at a table half as large again; those alone in
    their place take the next slots in order of place, the others go on to the next level.
    """
    slots = np.full(len(first), -1, dtype=np.int64)
    left, taken = np.arange(len(first)), 0
    for level in range(64):
        if not len(left):
            return slots
        size = len(left) + len(left) // 2 + 1
        place = (_scrambled(first[left] ^ np.uint64(level), second[left]) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        hit = alone[place]
        slots[left[hit]] = taken + np.cumsum(alone)[place[hit]] - 1
        taken += int(hit.sum())
        left = left[~hit]
    # digests that no level told apart keep their order
    slots[left] = taken + np.arange(len(left))
    return slots


def _scrambled(words: np.ndarray, salt: np.ndarray) -> np.ndarray:
    words = (words ^ salt >> np.uint64(29)) * _MIX[0] + salt
    words = (words ^ words >> np.uint64(32)) * _MIX[1]
    return words ^ words >> np.uint64(31)


def subtree_sums(frame: pd.DataFrame, values: list[str]) -> pd.DataFrame:
    """Sums of ``values`` over the subtrees of a shard's node table.

    Rows (path, depth, d1, d2, values) sorted by path and depth: the nodes of each path from
    one depth on, without gaps. Gives (depth, d1, d2, values), each distinct node once.
    """
    path, depth = frame["path"].to_numpy(), frame["depth"].to_numpy()
    d1, d2 = (frame[c].to_numpy().view(np.uint64) for c in ("d1", "d2"))
    order = np.lexsort((d2, d1, depth))
    fresh = np.ones(len(order), dtype=bool)
    for word in (d1, d2, depth):
        fresh[1:] &= word[order][1:] == word[order][:-1]
    fresh[1:] = ~fresh[1:]
    heads = order[fresh]
    of_row = np.empty(len(order), dtype=np.int64)
    of_row[order] = np.cumsum(fresh) - 1
    slot = perfect_slots(d1[heads] ^ depth[heads].view(np.uint64) * _MIX[1], d2[heads])
    n, at = len(heads), slot[of_row]
    table1, table2, level = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.int64)
    table1[slot], table2[slot], level[slot] = d1[heads], d2[heads], depth[heads]
    if not ((table1[at] == d1) & (table2[at] == d2) & (level[at] == depth)).all():
        raise ValueError("two nodes share a slot")
    inner = np.r_[False, path[1:] == path[:-1]]
    parent = np.full(n, -1, dtype=np.int64)
    parent[at[inner]] = at[:-1][inner[1:]]
    if not (parent[at[inner]] == at[:-1][inner[1:]]).all():
        raise ValueError("two prefixes share a digest")
    sums = []
    for value in values:
        flat = np.zeros(n, dtype=np.int64)
        np.add.at(flat, at, frame[value].to_numpy())
        sums.append(flat)
    deepest = np.argsort(-level, kind="stable")
    for part in np.split(deepest, np.flatnonzero(np.diff(level[deepest])) + 1):
        part = part[parent[part] >= 0]
        for flat in sums:
            np.add.at(flat, parent[part], flat[part])
    return pd.DataFrame({"depth": level, "d1": table1.view(np.int64), "d2": table2.view(np.int64)} | dict(zip(values, sums)))


def in_order(rows: DataFrame, key: str, order: list[str], keep: list[str], scan: Callable, added: str) -> DataFrame:
    """Columns ``keep`` of rows range-partitioned and sorted by ``key`` and ``order``, scanned.

    ``scan(frame, state)`` gets frames of the sorted rows and what it gave with the frame
    before, None at a partition's start, and gives the frame with the columns ``added``.
    ``_part`` numbers the partitions in order of the keys.
    """
    count = max(2, shuffle_partitions(rows.sparkSession))
    ranged = rows.repartitionByRange(count, key, *order).sortWithinPartitions(key, *order).select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for frame in frames:
            if len(frame):
                result, state = scan(frame, state)
                yield result

    numbered = ranged.withColumn("_part", F.spark_partition_id())
    return checkpointed(numbered.mapInPandas(run, f"{schema}, _part int, {added}"))


def _running(weights: Callable[[pd.DataFrame], dict[str, np.ndarray]], key: str):
    """A scan for ``in_order``: inclusive running sums per key, modulo 2 ** 64."""

    def scan(frame: pd.DataFrame, state):
        keys = frame[key].to_numpy()
        start = np.r_[True, keys[1:] != keys[:-1]]
        group = np.cumsum(start) - 1
        at = np.flatnonzero(start)
        out, carried = {}, {}
        for name, values in weights(frame).items():
            values = values.astype(np.uint64)
            sums = np.cumsum(values)
            before = sums[at] - values[at]
            sums = sums - before[group]
            if state is not None and state[0] == keys[0]:
                sums = sums + np.where(group == 0, state[1][name], np.uint64(0))
            carried[name] = sums[-1]
            out[name] = sums.view(np.int64)
        return frame.assign(**out), (keys[-1], carried)

    return scan


def _carries(stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, _part, columns) that earlier partitions bring along, for keys in several of them.

    A partition holds at most two such keys, so the table has two rows a partition at most.
    """
    width = F.count(F.lit(1)).over(W.partitionBy(key))
    last = stored.groupBy(key, "_part").agg(*[F.max_by(c, "_seq").alias(c) for c in columns])
    spread = checkpointed(last.withColumn("_parts", width).where("_parts > 1").drop("_parts"))

    def shift(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_part", ignore_index=True)
        for c in columns:
            values = frame[c].to_numpy().view(np.uint64)
            frame[c] = (np.cumsum(values) - values).view(np.int64)
        return frame

    return spread.groupBy(key).applyInPandas(shift, spread.schema)


def _wrapped_sum(a: Column, b: Column) -> Column:
    """Sum of two longs modulo 2 ** 64."""
    low = a.bitwiseAND(0xFFFFFFFF) + b.bitwiseAND(0xFFFFFFFF)
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def _carried(stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    before = _carries(stored, key, columns)
    renamed = before.select(key, "_part", *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = lookup_join(stored, checkpointed(renamed), [key, "_part"], "left")
    zero = F.lit(0).cast("long")
    return joined.withColumns({c: _wrapped_sum(F.col(c), F.coalesce(F.col(f"_b_{c}"), zero)) for c in columns}).drop(
        *[f"_b_{c}" for c in columns]
    )


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, a, b, chars) of turns with a conv_id, by turn, null first.

    a and b hash role and text, null as empty; ties go by role, then by hash. Rows without a
    conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn", F.xxhash64(role).alias("_role"),
        F.xxhash64(F.lit("first"), role, text).alias("a"), F.xxhash64(F.lit("second"), text, role).alias("b"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("_row"),
    )
    one = _running(lambda frame: {"_seq": np.ones(len(frame), np.uint64)}, "conv_id")
    order = ["turn", "_role", "a", "b", "_row"]
    stored = in_order(rows, "conv_id", order, ["conv_id", "a", "b", "chars"], one, "_seq bigint").withColumn("_n", F.col("_seq"))
    return _carried(stored, "conv_id", ["_n"]).select("conv_id", (F.col("_n") - 1).alias("pos"), "a", "b", "chars")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (conv_id, depth from 1, a, b, chars) and conversations (conv_id, n_turns).

    A conversation takes the first h turns of the first one of its hundred, all if that has
    fewer and none if it is absent, and its own turns after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED
    sizes = ordered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("_host"))
    hosts = sizes.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("_host"), F.col("own").alias("_there"))
    taken = F.least("h", F.coalesce("_there", F.lit(0)))
    convs = checkpointed(
        convs.join(hosts, "_host", "left").select(
            "conv_id", "h", "_host", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")
        )
    )
    heads = ordered.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < SHARED - 1)).withColumnRenamed("conv_id", "_host")
    lent = convs.join(heads, "_host").where(F.col("pos") < F.col("taken")).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "chars"
    )
    kept = ordered.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "chars"
    )
    return lent.unionByName(kept), convs.select("conv_id", "n_turns")


def prefix_digests(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, d1, d2, p1, p2): the digest of every prefix and of its parent.

    Every conversation has a row of depth 0, the root, with the digest zero.
    """
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars"))

    def placed(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        depth = frame["depth"].to_numpy().astype(np.uint64)
        inside = (depth > 0).astype(np.uint64)
        words = {"a": frame["a"], "b": frame["b"]}
        hashed = {c: _scrambled(v.to_numpy().view(np.uint64), depth * _MIX[0]) * inside for c, v in words.items()}
        return {"d1": hashed["a"], "d2": hashed["b"], "_seq": np.ones(len(frame), np.uint64), "own1": hashed["a"], "own2": hashed["b"]}

    def scan(frame, state):
        weights = placed(frame)
        own = {c: weights.pop(c).view(np.int64) for c in ("own1", "own2")}
        result, state = _running(lambda _: weights, "conv_id")(frame, state)
        return result.assign(**own)[[*frame.columns, "d1", "d2", "_seq", "own1", "own2"]], state

    rows, added = roots.unionByName(paths), "d1 bigint, d2 bigint, _seq bigint, own1 bigint, own2 bigint"
    stored = in_order(rows, "conv_id", ["depth"], rows.columns, scan, added)
    whole = _carried(stored, "conv_id", ["d1", "d2"])
    less = [_wrapped_sum(F.col(f"d{n}"), _negated(F.col(f"own{n}"))).alias(f"p{n}") for n in (1, 2)]
    return checkpointed(whole.select("conv_id", "depth", "chars", "d1", "d2", *less))


def _negated(a: Column) -> Column:
    return _wrapped_sum(F.bitwise_not(a), F.lit(1).cast("long"))


def _subtree_totals(paths: DataFrame, values: list[str], band: int, shard_rows: int) -> DataFrame:
    """(depth, d1, d2, values): sums over subtrees for all nodes with a sum other than zero.

    ``paths`` has (conv_id, depth, d1, d2, values) for every conversation and depth from 0
    on, a node's own values in one of its rows. Paths longer than a band are settled from
    above: sums of the band ends come from a trie of band ends alone, a band's length
    shorter, and are then own values in their band.
    """
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    if deepest > band:
        end = F.ceil(F.col("depth") / band) * band
        ends = paths.where((F.col("depth") % band == 0) | (F.col("depth") == 0))
        # everything below a band end as far as the next, by the end's row on the same path
        top = paths.withColumn("_end", (end - band).cast("long")).where("depth > 0")
        below = top.groupBy("conv_id", "_end").agg(*[F.sum(v).alias(v) for v in values])
        marks = ends.select("conv_id", "depth", "d1", "d2")
        step = checkpointed(
            marks.join(below.withColumnRenamed("_end", "depth"), ["conv_id", "depth"], "left")
            .withColumn("depth", (F.col("depth") / band).cast("long")).fillna(0, values)
        )
        carried = _subtree_totals(step, values, band, shard_rows).select(
            (F.col("depth") * band).alias("depth"), "d1", "d2", *[F.col(v).alias(f"_{v}") for v in values]
        )
        # one row of each band end takes the sum of what is below it
        first = marks.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("conv_id")).where("depth > 0")
        given = checkpointed(first.join(carried, ["depth", "d1", "d2"]).select("conv_id", "depth", *[f"_{v}" for v in values]))
        paths = checkpointed(
            paths.join(given, ["conv_id", "depth"], "left").fillna(0, [f"_{v}" for v in values]).withColumns(
                {v: F.col(v) + F.col(f"_{v}") for v in values}
            ).drop(*[f"_{v}" for v in values])
        )
    unit = F.greatest(F.ceil(F.col("depth") / band) - 1, F.lit(0)).cast("long")
    dealt = paths.select(
        F.col("conv_id").alias("path"), unit.alias("unit"), "depth", "d1", "d2", *values
    )
    shards = max(1, -(-paths.count() // shard_rows))
    placed = dealt.withColumn("_shard", F.pmod(F.xxhash64("path", "unit"), F.lit(shards)).cast("int"))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["path", "unit", "depth"], ignore_index=True)
        # a band is a path of its own here, and the root of its shard's forest is where it begins
        frame["path"] = np.cumsum(np.r_[True, (np.diff(frame["path"]) != 0) | (np.diff(frame["unit"]) != 0)])
        sums = subtree_sums(frame, values)
        return sums[(sums[values] != 0).any(axis=1)]

    schema = "depth bigint, d1 bigint, d2 bigint, " + ", ".join(f"{v} bigint" for v in values)
    parts = placed.groupBy("_shard").applyInPandas(settle, schema)
    return parts.groupBy("depth", "d1", "d2").agg(*[F.sum(v).alias(v) for v in values])


def _end_hashes(paths: DataFrame, convs: DataFrame, chunk: int) -> DataFrame:
    """(depth, d1, d2, ends_sha256) of nodes where conversations end.

    Ids are sorted by range partitions and joined to pieces of text there, so the task that
    hashes a node reads few rows, one for each ``chunk`` ids.
    """
    ends = paths.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select(
        "depth", "d1", "d2", "conv_id"
    )
    by = ["depth", "d1", "d2", "conv_id"]
    ranged = ends.repartitionByRange(max(2, shuffle_partitions(paths.sparkSession)), *by).sortWithinPartitions(*by)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), chunk):
                part = frame.iloc[at : at + chunk]
                yield part.groupby(["depth", "d1", "d2"], sort=False)["conv_id"].agg(
                    first="min", ids=lambda ids: ",".join(map(str, ids))
                ).reset_index()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for frame in frames:
            done = []
            for *key, ids in zip(*(frame[c] for c in ("depth", "d1", "d2", "ids"))):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["depth", "d1", "d2", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "d1", "d2", "ends_sha256"])

    cut = ranged.mapInPandas(pieces, "depth bigint, d1 bigint, d2 bigint, first bigint, ids string")
    dealt = cut.repartition("depth", "d1", "d2").sortWithinPartitions("depth", "d1", "d2", "first")
    return dealt.mapInPandas(hashed, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK
) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: one row per distinct prefix.

    Columns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. ``turns`` has conv_id, turn, role, text;
    other columns are ignored, also those named like a result. Null roles and texts are
    empty, null turns come first, ties go by hash; equal turn rows are turns of their own.
    Rows without a conv_id take no part. A table without conversations has no node. Texts are
    hashed whole, to 128 bits together with role and place; prefixes that meet in them but
    differ in their parents raise an error.
    """
    ordered = checkpointed(ordered_turns(turns))
    paths, convs = rebuilt(ordered)
    paths = prefix_digests(paths, convs)
    node = ["depth", "d1", "d2"]
    nodes = checkpointed(
        paths.groupBy(*node).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
            F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        )
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = checkpointed(nodes.join(children, node, "left").fillna(0, ["n_children"]))
    own = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    # a node's values stand on the path of its smallest member
    valued = paths.select("conv_id", *node).join(own, ["conv_id", "depth"], "left").fillna(0, ["leaves", "saved"])
    totals = _subtree_totals(checkpointed(valued), ["leaves", "saved"], band, shard_rows)
    ends = _end_hashes(paths, convs, chunk)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    settled = checkpointed(nodes.join(totals, node, "left").join(ends, node, "left"))
    return settled.join(above, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
