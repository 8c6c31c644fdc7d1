"""Replay detection over an inference log.

Each record is compared with *earlier arrivals* only. Every "seen before under another
id" rule needs just two facts per key value: the earliest arrival, and the earliest one
under a different record id. Both come from partial aggregates, so a nonce or payload
repeated by a third of the log is reduced map-side rather than sorted in one task.
Results are long: one row per (arrival, rule).

By default every record stays in the log that later ones are compared with. With
``register_replays=False`` a flagged record does not enter it. Whether a record enters then
depends on which earlier ones did; rounds settle at once all records that nothing earlier
still in doubt can touch. ``submission_reasons`` compares records with a stored log instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.hashing import sha256
from assaykit.functions.times import iso_micros
from assaykit.operators.scan import ordered_scan
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

FUTURE_LIMIT_SECONDS = 300
PAYLOAD_KEY = ["input_sha256", "model_sha256", "output_sha256"]
REUSE_RULES = {
    "NONCE_REUSED": ["nonce"],
    "SEQUENCE_REUSED": ["sequence"],
    "PAYLOAD_REPEATED": PAYLOAD_KEY,
}
SAME_ID = "DUPLICATE_RECORD_ID"
KEYS = {SAME_ID: ["record_id"], **REUSE_RULES}


def _tagged(rows: DataFrame, rule: str, prior) -> DataFrame:
    return rows.select("arrival", F.lit(rule).alias("rule"), prior.alias("prior_record"))


def _known(columns: list[str]) -> Column:
    """Whether none of the columns is null."""
    known = F.lit(True)
    for column in columns:
        known = known & F.col(column).isNotNull()
    return known


def _key(columns: list[str]) -> Column:
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    # a digest keeps long compound keys short in the shuffle
    return text if len(columns) == 1 else sha256(text)


def keyed_rows(log: DataFrame, *extra: str) -> DataFrame:
    """One row per record and rule: rule, key, arrival, record_id, ``extra``. Null keys are left out."""
    cells = [
        F.when(_known(columns), F.struct(F.lit(rule).alias("rule"), _key(columns).alias("key")))
        for rule, columns in KEYS.items()
    ]
    # nulls are filtered after the explode: array_compact is not compiled
    opened = log.select("arrival", "record_id", *extra, F.explode(F.array(*cells)).alias("k")).where("k IS NOT NULL")
    return opened.select("k.rule", "k.key", "arrival", "record_id", *extra)


def repeated_rows(log: DataFrame, *extra: str) -> DataFrame:
    """Those ``keyed_rows`` that may have a reason: keys under two record ids, record ids seen twice.

    The pass over the whole log shuffles and aggregates numbers only: a digest per key, and
    two per record id that tell whether there was more than one. The keys themselves are
    made for the rows found. Keys that share a digest come along, so callers compare keys.
    """
    columns = sorted({"arrival", "record_id", *extra, *[c for key in KEYS.values() for c in key]})
    digests = [F.when(_known(key), F.xxhash64(F.lit(rule), *key)) for rule, key in KEYS.items()]
    rows = log.select(*columns, F.posexplode(F.array(*digests)).alias("_rule", "_digest")).where("_digest IS NOT NULL")
    same_id = F.col("_rule") == list(KEYS).index(SAME_ID)
    spans, mixed = [], F.lit(False)
    for seed in (1, 2):
        digest = F.when(same_id, F.xxhash64("arrival", F.lit(seed))).otherwise(F.xxhash64("record_id", F.lit(seed)))
        spans += [F.min(digest).alias(f"lo{seed}"), F.max(digest).alias(f"hi{seed}")]
        mixed = mixed | (F.col(f"lo{seed}") != F.col(f"hi{seed}"))
    repeated = checkpointed(rows.groupBy("_digest").agg(*spans).where(mixed).select("_digest"))
    rule, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for place, (name, fields) in enumerate(KEYS.items()):
        rule = F.when(F.col("_rule") == place, name).otherwise(rule)
        key = F.when(F.col("_rule") == place, _key(fields)).otherwise(key)
    rows = rows.select("_digest", rule.alias("rule"), key.alias("key"), "arrival", "record_id", *extra)
    return lookup_join(rows, repeated, ["_digest"], "inner").drop("_digest")


def repeats(log: DataFrame, prior: str | None = None) -> DataFrame:
    """Reasons of all rules about a value seen earlier, in one pass over the log.

    A repeated record id counts by itself; a nonce, sequence or payload counts when it was
    used under another record id. Only rows with a true ``prior`` column are compared with.
    """
    on = ["rule", "key"]
    hits = checkpointed(repeated_rows(log, *([prior] if prior else [])))
    first = F.min(F.struct(F.col("arrival").alias("at"), "record_id"))
    leading = hits.where(prior) if prior else hits
    leaders = checkpointed(leading.groupBy(*on).agg(first.alias("lead")))
    led = lookup_join(hits, leaders, on, "inner")
    counting = led.where(prior) if prior else led
    others = checkpointed(
        counting.where(F.col("record_id") != F.col("lead.record_id")).groupBy(*on).agg(first.alias("next"))
    )
    own = (F.col("record_id") == F.col("lead.record_id")) & (F.col("rule") != SAME_ID)
    judged = lookup_join(led, others, on).withColumn(
        "prior", F.when(own, F.col("next")).otherwise(F.col("lead"))
    )
    late = judged.where(F.col("prior.at") < F.col("arrival"))
    return late.select("arrival", "rule", F.col("prior.record_id").alias("prior_record"))


def sequence_regressions(log: DataFrame, stream: list[str] | None = None, prior: str | None = None) -> DataFrame:
    """Rows whose sequence does not exceed the largest earlier one (of ``prior`` rows only)."""
    if prior:
        log = checkpointed(log.withColumn("_counted", F.when(F.col(prior), F.col("sequence"))))
    heads = {"head": "_counted" if prior else "sequence"}
    scanned = ordered_scan(log, stream or [], "arrival", max_before=heads)
    return _tagged(
        scanned.where(F.col("sequence") <= F.col("head")),
        "SEQUENCE_REGRESSION",
        F.col("head").cast("string"),
    )


def timestamp_anomalies(log: DataFrame, now_us: int) -> DataFrame:
    """Rows stamped more than five minutes after ``now_us``, or not an ISO time."""
    at = iso_micros(F.col("timestamp"))
    late = (at - F.lit(now_us)) / 1e6
    future = _tagged(log.where(late > FUTURE_LIMIT_SECONDS), "TIMESTAMP_FUTURE", F.round(late, 1).cast("string"))
    return future.unionAll(_tagged(log.where(at.isNull()), "TIMESTAMP_MALFORMED", F.col("timestamp")))


def settle_reasons(reasons: DataFrame) -> DataFrame:
    """Drop a sequence regression where the record id itself was a repeat."""
    repeats = reasons.where(F.col("rule") == SAME_ID).select(
        "arrival", F.lit("SEQUENCE_REGRESSION").alias("rule")
    )
    return reasons.join(repeats, ["arrival", "rule"], "left_anti")


def replay_reasons(
    log: DataFrame, now_us: int | None = None, stream: list[str] | None = None, register_replays: bool = True
) -> DataFrame:
    """All replay reasons: (arrival, rule, prior_record).

    With ``register_replays=False`` flagged records are not compared with later ones.
    """
    if register_replays:
        return _reasons(log, now_us, stream)
    rows, _ = _in_doubt(checkpointed(log), now_us, stream)
    entered = _settled(rows, now_us, stream).withColumn("_entered", F.lit(True))
    marked = rows.join(entered, "arrival", "left").withColumn("_entered", F.col("_entered").isNotNull())
    return _reasons(checkpointed(marked), now_us, stream, "_entered")


def _reasons(log: DataFrame, now_us: int | None, stream: list[str] | None, prior: str | None = None) -> DataFrame:
    found = repeats(log, prior)
    known = found.where(F.col("rule") == SAME_ID).select("arrival", F.lit(True).alias("_known"))
    # as in settle_reasons, but the other reasons need not go through the join; Spark would
    # push an anti join down to the whole log, before the heads are compared
    behind = sequence_regressions(log, stream, prior).join(known, "arrival", "left").where("_known IS NULL").drop("_known")
    reasons = found.unionByName(behind)
    if now_us is not None:
        reasons = reasons.unionByName(timestamp_anomalies(log, now_us))
    return reasons


def registered_arrivals(log: DataFrame, now_us: int | None = None, stream: list[str] | None = None) -> DataFrame:
    """Arrivals without a reason against the earlier ones that have none themselves."""
    log = checkpointed(log)
    rows, doubtful = _in_doubt(log, now_us, stream)
    out = doubtful.join(_settled(rows, now_us, stream), "arrival", "left_anti")
    return log.select("arrival").join(out, "arrival", "left_anti")


def _in_doubt(log: DataFrame, now_us: int | None, stream: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The rows that decide about those with a reason against some earlier row, and the arrivals of these.

    A row clean against all earlier ones is in, whatever else happens. It is kept only where
    it shares a key with a doubtful row or sets the largest sequence of clean rows before one.
    """
    doubtful = checkpointed(_reasons(log, now_us, stream).select("arrival").distinct())
    marked = lookup_join(log, doubtful.withColumn("_doubt", F.lit(True)), ["arrival"])
    marked = checkpointed(marked.withColumn("_clean", F.when(F.col("_doubt").isNull(), F.col("sequence"))))
    heads = ordered_scan(marked, stream or [], "arrival", max_before={"_head": "_clean"}).where("_doubt AND _head IS NOT NULL")
    at = [*(stream or []), "sequence"]
    heads = checkpointed(heads.select(*(stream or []), F.col("_head").alias("sequence")).distinct())
    keys = checkpointed(keyed_rows(marked.where("_doubt")).select("rule", "key").distinct())
    kept = (
        doubtful.unionByName(lookup_join(keyed_rows(log).select("rule", "key", "arrival"), keys, ["rule", "key"], "inner").select("arrival"))
        .unionByName(lookup_join(log.select("arrival", *at), heads, at, "inner").select("arrival"))
        .distinct()
    )
    return checkpointed(lookup_join(log, checkpointed(kept), ["arrival"], "inner")), doubtful


def _settled(rows: DataFrame, now_us: int | None, stream: list[str] | None) -> DataFrame:
    """Arrivals that are in: clean against the earlier rows that are in.

    A row clean against all earlier rows left is in; a row with a reason against one that is
    in is out. Each round settles the earliest doubtful row at least, and with it all rows
    whose doubts don't hang on one another: as many rounds as replays of replays are deep.
    """
    while True:
        doubtful = checkpointed(_reasons(rows, now_us, stream).select("arrival").distinct())
        if doubtful.isEmpty():
            return rows.select("arrival")
        marks = doubtful.withColumn("_doubt", F.lit(True))
        marked = checkpointed(rows.join(marks, "arrival", "left").withColumn("_sure", F.col("_doubt").isNull()).drop("_doubt"))
        out = checkpointed(_reasons(marked, now_us, stream, "_sure").select("arrival").distinct())
        rows = checkpointed(marked.drop("_sure").join(out, "arrival", "left_anti"))


def submission_reasons(
    submitted: DataFrame, registered: DataFrame, now_us: int | None = None, exclude_self: bool = False
) -> DataFrame:
    """Reasons of submitted records against a stored log: (arrival, rule, prior_record).

    Both tables have arrival, record_id, nonce, sequence and the payload hashes; ``arrival``
    numbers the rows of each apart. Everything registered counts, whenever it arrived. A
    stored record that is submitted again thus finds its own id; with ``exclude_self`` its
    id counts only where it was registered with another nonce, sequence or payload. A known
    id is not held against the sequence head, as in the log. Null keys match nothing.
    """
    on = ["rule", "key"]
    fields = ["nonce", "sequence", *PAYLOAD_KEY]
    content = F.xxhash64(*[f for c in fields for f in (F.col(c).cast("string"), F.col(c).isNull())])
    asked = keyed_rows(submitted.withColumn("_content", content), "_content")
    stored = keyed_rows(registered.withColumn("_content", content), "_content")
    digests = [F.xxhash64("record_id", F.lit(seed)) for seed in (1, 2)]
    # numbers only, so the stored log aggregates by hashing; its ids are read where they are shown
    spans = [f(d).alias(f"{n}{i}") for i, d in enumerate([*digests, F.col("_content")], 1) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    # a number in front of the key lets the join sort by numbers
    asked, numbered = (rows.withColumn("_digest", F.xxhash64(*on)) for rows in (asked, stored))
    facts = numbered.groupBy("_digest", *on).agg(F.min("arrival").alias("at"), *spans)
    mixed = (F.col("lo1") != F.col("hi1")) | (F.col("lo2") != F.col("hi2"))
    own = (digests[0] == F.col("lo1")) & (digests[1] == F.col("lo2"))
    itself = (F.col("lo3") == F.col("_content")) & (F.col("hi3") == F.col("_content"))
    judged = checkpointed(
        # both grow with the log, whatever the estimates say of exploded rows
        asked.join(facts.hint("merge"), ["_digest", *on])
        .select(*on, "arrival", "record_id", "at", mixed.alias("mixed"), own.alias("own"), itself.alias("itself"))
    )
    by_id = F.col("rule") == SAME_ID
    same = judged.where(by_id & ~F.col("itself")) if exclude_self else judged.where(by_id)
    # keys of one other id, then those of several
    plain = judged.where(~by_id & ~F.col("mixed") & ~F.col("own")).select("arrival", "rule", "at")
    ids = registered.select(F.col("arrival").alias("at"), F.col("record_id").alias("prior_record"))
    several = judged.where(~by_id & F.col("mixed"))
    reasons = (
        same.select("arrival", "rule", F.col("record_id").alias("prior_record"))
        .unionByName(plain.join(ids.hint("merge"), "at").select("arrival", "rule", "prior_record"))
        .unionByName(_reuse_of_several(several.select(*on, "arrival", "record_id"), stored))
    )
    known = judged.where(by_id).select("arrival")
    # one row
    head = registered.agg(F.max("sequence").alias("head"))
    behind = submitted.join(known, "arrival", "left_anti").join(F.broadcast(head), how="cross").where("sequence <= head")
    reasons = reasons.unionByName(_tagged(behind, "SEQUENCE_REGRESSION", F.col("head").cast("string")))
    if now_us is not None:
        reasons = reasons.unionByName(timestamp_anomalies(submitted, now_us))
    return reasons


def _reuse_of_several(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Reasons of keys that are stored under more than one record id: the earliest other one counts."""
    on = ["rule", "key"]
    asked = checkpointed(asked)
    hits = checkpointed(lookup_join(stored, checkpointed(asked.select(*on).distinct()), on, "inner"))
    first = F.min(F.struct(F.col("arrival").alias("at"), "record_id"))
    leaders = checkpointed(hits.groupBy(*on).agg(first.alias("lead")))
    others = lookup_join(hits, leaders, on, "inner").where(F.col("record_id") != F.col("lead.record_id"))
    facts = checkpointed(lookup_join(leaders, others.groupBy(*on).agg(first.alias("next")), on))
    prior = F.when(F.col("record_id") == F.col("lead.record_id"), F.col("next")).otherwise(F.col("lead"))
    found = lookup_join(asked, facts, on, "inner").withColumn("prior", prior)
    return found.select("arrival", "rule", F.col("prior.record_id").alias("prior_record"))


def described(log: DataFrame, reasons: DataFrame) -> DataFrame:
    """Flagged arrivals with their sorted rule names and one text: arrival, reasons, detail."""
    prior = F.concat(F.lit("'"), F.coalesce("prior_record", F.lit("")), F.lit("'"))

    def shown(*parts: str) -> Column:
        """Words, and columns where they are in braces; format_string takes many times as long."""
        columns = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("null")) if p[0] == "{" else F.lit(p) for p in parts]
        return F.concat(*columns)

    text = {
        SAME_ID: shown("record id '", "{record_id}", "' is registered already"),
        "NONCE_REUSED": F.concat(shown("nonce '", "{nonce}", "' was used by record "), prior),
        "SEQUENCE_REUSED": F.concat(shown("sequence ", "{sequence}", " was used by record "), prior),
        "PAYLOAD_REPEATED": F.concat(F.lit("input, model and output are those of record "), prior),
        "SEQUENCE_REGRESSION": shown("sequence ", "{sequence}", " is not above the head ", "{prior_record}"),
        "TIMESTAMP_FUTURE": shown("timestamp lies ", "{prior_record}", " seconds ahead"),
        "TIMESTAMP_MALFORMED": F.lit("timestamp is not an ISO time"),
    }
    sentence = F.lit(None).cast("string")
    for rule, words in text.items():
        sentence = F.when(F.col("rule") == rule, words).otherwise(sentence)
    named = reasons.join(log.select("arrival", "record_id", "nonce", "sequence"), "arrival")
    listed = named.groupBy("arrival").agg(F.array_sort(F.collect_list(F.struct("rule", sentence.alias("text")))).alias("_r"))
    return listed.select("arrival", F.col("_r.rule").alias("reasons"), F.array_join("_r.text", "; ").alias("detail"))


def replayed_arrivals(reasons: DataFrame) -> DataFrame:
    """One row per flagged arrival with its sorted rule names (at most one per rule).

    Stored, so that its size is known where it is joined: where few rows are flagged, the log
    is neither shuffled nor sorted for it.
    """
    return checkpointed(reasons.groupBy("arrival").agg(F.array_sort(F.collect_set("rule")).alias("reasons")))


def replay_summary(log: DataFrame, reasons: DataFrame) -> DataFrame:
    """Log rows with is_replay, severity and disposition."""
    joined = log.join(replayed_arrivals(reasons), "arrival", "left")
    hit = F.col("reasons").isNotNull()
    return (
        joined.withColumn("is_replay", hit)
        .withColumn("severity", F.when(hit, "HIGH").otherwise("LOW"))
        .withColumn("disposition", F.when(hit, "QUARANTINE").otherwise("ACCEPT"))
    )
