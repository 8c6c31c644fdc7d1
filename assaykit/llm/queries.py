"""Driver queries of the text operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import chat, linededup, minmax, mixing, neighbours, packing, pii, quality_trees, rules, secrets, simhash, trie, whitening
from assaykit.llm.common import UPPER

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.pack(packing.pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@_query("op2_simhash_golay")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


@_query("op3_collision_counting")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def _joined_spans(kinds: tuple[str, ...], order) -> Column:
    """Spans of some kinds as text, kind:start:end, comma-joined."""
    wanted = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    ordered = F.array_sort(F.transform(wanted, order))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_columns(base: tuple[str, ...], kinds: tuple[str, ...], by_start: bool) -> list:
    """Counts of the base kinds, the digest of their spans and all spans."""

    def order(s):
        rank = F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
        first, second = (s["start"], rank) if by_start else (rank, s["start"])
        return F.struct(first.cast("long").alias("_1"), second.cast("long").alias("_2"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [
        "doc_id", *map(count, base),
        F.sha2(_joined_spans(base, order).cast("binary"), 256).alias("base_sha256"),
        _joined_spans(kinds, order).alias("spans"),
    ]


@_query("op4_markov_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    return found.select(*_span_columns(secrets.KINDS[:3], secrets.KINDS, by_start=True))


@_query("op5_quality_trees")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    forest = quality_trees.fit(docs, _table(spark, folder, "labels"))
    scored = docs.select("doc_id", quality_trees.score(F.col("text"), forest).alias("score"))
    return scored.select(
        "doc_id",
        quality_trees.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality_trees.THRESHOLD).cast("int").alias("predicted"),
    )


_MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORD})), 0) AS BIGINT) AS size,
         substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 16) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY source),
weighed AS (
  SELECT source, total, total * 3 AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM totals),
summed AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
         CAST(sum(total) OVER () AS BIGINT) AS all_words,
         CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, coalesce('v' || source, 'n') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clamped,
         CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, coalesce('v' || source, 'n') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_w
  FROM weighed),
levels AS (
  SELECT CAST(all_words - clamped AS DOUBLE) / open_w AS level FROM summed
  WHERE CAST(all_words - clamped AS DOUBLE) / open_w <= ratio ORDER BY clamped LIMIT 1),
targets AS (
  SELECT source, total, least((SELECT level FROM levels) * w, CAST(cap AS DOUBLE)) AS target FROM summed),
parts AS (
  SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS whole FROM targets),
ran AS (
  SELECT s.doc_id, s.size, p.total, p.target, p.whole,
         greatest(0, CAST(floor(p.target + 0.5) AS BIGINT) - p.whole * p.total) AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM ran
"""


@_query("op6_source_mix", _MIX_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query("op7_semi_markov_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.scan(docs, pii.fit(docs))
    return found.select(*_span_columns(pii.KINDS, pii.KINDS + pii.ADDED, by_start=False))


_CHAT_SQL = """
WITH convs AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id),
prefixes AS (
  SELECT DISTINCT turns[1:k] AS head FROM convs, unnest(generate_series(1, len(turns) - 1)) AS g(k)),
maximal AS (SELECT * FROM convs WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE head = turns)),
kept AS (SELECT min(conv_id) AS conv_id, turns FROM maximal GROUP BY turns)
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(len(turns) AS BIGINT) AS n_turns,
       array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS text
FROM kept
"""


@_query("op8_chat_snapshots", _CHAT_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(chat.collapse(_table(spark, folder, "conversations")))


@_query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return rules.judge(docs, keep=["doc_id"])


_LINES_SQL = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, {_SPACE}), '{UPPER}', '{UPPER.lower()}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.k = c.k GROUP BY k.doc_id, k.rid
"""


@_query("op10_line_dedup", _LINES_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@_query("op12_min_max_hash")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = minmax.near_duplicates(docs, keep=["doc_id"])
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


_TRIE_SQL = """
WITH told AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (
  SELECT conv_id, pos, length(x) AS chars, md5(length(r) || ':' || r || x) AS turn FROM told),
bytes AS (
  SELECT conv_id, count(*) AS own,
         flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
           lambda i: list_prepend(CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT), list_transform(range(8), lambda j: CAST(-1 AS BIGINT))))) AS feed
  FROM hashed GROUP BY conv_id),
sizes AS (
  SELECT conv_id, own, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), feed),
           lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END)) % 6 AS h
  FROM bytes),
convs AS (
  SELECT s.conv_id, s.h, s.conv_id - s.conv_id % 100 AS host, least(s.h, coalesce(t.own, 0)) AS taken
  FROM sizes s LEFT JOIN sizes t ON t.conv_id = s.conv_id - s.conv_id % 100),
paths AS (
  SELECT c.conv_id, o.pos + 1 AS depth, turn, chars FROM convs c JOIN hashed o ON o.conv_id = c.host AND o.pos < c.taken
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + c.taken + 1, turn, chars FROM convs c JOIN hashed o ON o.conv_id = c.conv_id AND o.pos >= c.h),
lists AS (
  SELECT c.conv_id, list(turn ORDER BY depth) FILTER (turn IS NOT NULL) AS turns, list(chars ORDER BY depth) FILTER (turn IS NOT NULL) AS lens
  FROM convs c LEFT JOIN paths p ON c.conv_id = p.conv_id GROUP BY c.conv_id),
heads AS (
  SELECT conv_id, d AS depth, coalesce(turns, [])[1:d] AS head, coalesce(turns, [])[1:d - 1] AS above, coalesce(lens[d], 0) AS chars,
         d = coalesce(len(turns), 0) AS ended
  FROM lists, unnest(generate_series(0, coalesce(len(turns), 0))) AS g(d)),
nodes AS (
  SELECT depth, head, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM heads GROUP BY depth, head),
kids AS (SELECT depth - 1 AS depth, above AS head, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY depth, above),
counted AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.head = k.head),
sums AS (
  SELECT a AS depth, head[1:a] AS head, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM counted, unnest(generate_series(0, depth)) AS g(a) GROUP BY a, head[1:a])
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON n.depth = s.depth AND n.head = s.head
LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.above = p.head
"""


@_query("op13_prefix_trie", _TRIE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, folder, "conversations"))


@_query("op11_jacobi_davidson_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return white.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )
