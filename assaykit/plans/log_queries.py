"""Queries over ledgers, inference records, replay and windowed logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions.hashing import array_digest, canonical_json, canonical_object, sha256
from assaykit.functions.ids import stable_id
from assaykit.functions.times import iso_micros
from assaykit.operators import ledger, provenance, replay, windows
from assaykit.plans import derived as D
from assaykit.plans.registry import Tables, query, rounded

# --- digests ----------------------------------------------------------------------------


@query("text_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(t: Tables):
    return t.documents.select("doc_id", sha256(F.col("text")).alias("digest"))


@query("canonical_objects", """SELECT event_id,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":' || user_id || '}' AS text,
  sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":' || user_id || '}') AS digest
FROM events""")
def canonical_objects(t: Tables):
    text = canonical_object({c: F.col(c) for c in ("user_id", "event_type", "props", "event_id")})
    return t.events.select("event_id", text.alias("text")).withColumn("digest", sha256(F.col("text")))


@query("canonical_json", """SELECT event_id, '{"a":' || json_extract(props, '$.k') || ',"z":"' || event_type || '"}' AS text FROM events""")
def canonical_json_text(t: Tables):
    parsed = F.from_json("props", "k BIGINT")["k"]
    loose = F.concat(F.lit('{ "z" : "'), F.col("event_type"), F.lit('", "a" : '), parsed, F.lit(" }"))
    return t.events.select("event_id", canonical_json(loose).alias("text"))


@query("vector_digests")
def vector_digests(t: Tables):
    return t.embeddings.select("vec_id", array_digest("embedding").alias("digest"))


@query("clock_skew", """SELECT event_id, us // 1000000 - 1704844800 AS skew_seconds,
  us // 1000000 - 1704844800 > 300 AS is_future, event_id % 401 = 0 AS malformed
FROM (SELECT event_id, CASE WHEN event_id % 401 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM events)""")
def clock_skew(t: Tables):
    text = F.when(F.col("event_id") % 401 == 0, "yesterday").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    us = iso_micros(text)
    skew = F.floor(us / 1_000_000).cast("bigint") - 1704844800
    return t.events.select("event_id", skew.alias("skew_seconds"), (skew > 300).alias("is_future"), us.isNull().alias("malformed"))


@query("stable_ids", """SELECT event_id, 'EVT-' || upper(substr(sha256(user_id || '|' || event_id), 1, 12)) AS id FROM events""")
def stable_ids(t: Tables):
    return t.events.select("event_id", stable_id("EVT", F.col("user_id"), F.col("event_id")).alias("id"))


# --- ledger -----------------------------------------------------------------------------


def _entries(t: Tables):
    return t.events.select(
        F.col("user_id").cast("string").alias("chain"),
        F.col("event_id").alias("seq"),
        D.event_micros().cast("string").alias("timestamp"),
        F.col("user_id").cast("string").alias("actor"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("E"), "event_id").alias("asset"),
        D.value_cents().cast("string").alias("metadata_json"),
    )


_PAYLOAD = "us || '|' || user_id || '|' || event_type || '|E' || event_id || '|' || cents"
_CHAIN_SQL = f"""WITH RECURSIVE {D.EVENTS_SQL},
ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev),
chain AS (
  SELECT user_id, n, event_id, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|' || {_PAYLOAD}) AS cur
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.n, o.event_id, c.cur, sha256(c.cur || '|' || o.us || '|' || o.user_id || '|' || o.event_type || '|E' || o.event_id || '|' || o.cents)
  FROM chain c JOIN ordered o ON o.user_id = c.user_id AND o.n = c.n + 1)
"""


@query("ledger_append", _CHAIN_SQL + """SELECT CAST(user_id AS VARCHAR) AS chain, event_id AS seq, prev AS previous_hash, cur AS current_hash FROM chain""")
def ledger_append(t: Tables):
    return ledger.append(_entries(t)).select("chain", "seq", "previous_hash", "current_hash")


def _tampered(t: Tables):
    """The ledger with some values changed and some entries removed after hashing."""
    entries = ledger.append(_entries(t)).where("seq % 1013 <> 500")
    changed = F.when(F.col("seq") % 997 == 0, F.concat("metadata_json", F.lit("9"))).otherwise(F.col("metadata_json"))
    return entries.withColumn("metadata_json", changed)


_VERIFY_SQL = _CHAIN_SQL + f""",
stored AS (SELECT c.*, e.us, e.event_type,
    CASE WHEN e.event_id % 997 = 0 THEN e.cents || '9' ELSE CAST(e.cents AS VARCHAR) END AS meta
  FROM chain c JOIN ev e ON e.event_id = c.event_id WHERE c.event_id % 1013 <> 500),
checked AS (SELECT *, row_number() OVER w - 1 AS idx,
    coalesce(lag(cur) OVER w, repeat('0', 64)) AS expected,
    sha256(prev || '|' || us || '|' || user_id || '|' || event_type || '|E' || event_id || '|' || meta) AS recomputed
  FROM stored WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
graded AS (SELECT *, CASE WHEN prev <> expected THEN 'LINK' WHEN recomputed <> cur THEN 'CONTENT' END AS broken FROM checked)
"""


@query("ledger_check", _VERIFY_SQL + """SELECT CAST(user_id AS VARCHAR) AS chain, event_id AS seq, idx AS index, broken
FROM graded WHERE broken IS NOT NULL""")
def ledger_check(t: Tables):
    return ledger.check_entries(_tampered(t)).where("broken IS NOT NULL").select("chain", "seq", "index", "broken")


@query("ledger_verify", _VERIFY_SQL + """SELECT CAST(user_id AS VARCHAR) AS chain,
  CASE WHEN COUNT(broken) > 0 THEN 'TAMPERED' ELSE 'VALID' END AS status, COUNT(*) AS total_events,
  MIN(idx) FILTER (WHERE broken IS NOT NULL) AS broken_index, MIN(event_id) FILTER (WHERE broken IS NOT NULL) AS broken_seq,
  arg_min(broken, event_id) FILTER (WHERE broken IS NOT NULL) AS broken_kind,
  CASE WHEN COUNT(broken) = 0 THEN arg_max(cur, event_id) END AS head_hash
FROM graded GROUP BY user_id""")
def ledger_verify(t: Tables):
    return ledger.verify(_tampered(t))


# --- provenance -------------------------------------------------------------------------


def _records(t: Tables):
    e = t.events.select(
        F.concat(F.lit("REC-"), "event_id").alias("record_id"),
        D.event_micros().cast("string").alias("timestamp"),
        sha256(F.concat(F.lit("n|"), F.col("event_id").cast("string"))).alias("nonce"),
        F.col("event_id").alias("sequence"),
        F.col("user_id").cast("string").alias("who"), "event_type", D.value_cents().cast("string").alias("cents"), "props",
    )
    return provenance.build_records(e, {
        "input_sha256": F.col("who"), "model_sha256": F.col("event_type"), "output_sha256": F.col("cents"),
        "preprocessing_sha256": F.lit("resize=64"), "config_sha256": F.col("props"),
    })


_RECORD_HASH = """sha256('{"config_sha256":"' || config_sha256 || '","input_sha256":"' || input_sha256
  || '","model_sha256":"' || model_sha256 || '","nonce":"' || nonce || '","output_sha256":"' || output_sha256
  || '","preprocessing_sha256":"' || preprocessing_sha256 || '","record_id":"' || record_id
  || '","sequence":' || sequence || ',"timestamp":"' || stamp || '"}')"""
_RECORDS_SQL = f"""WITH {D.EVENTS_SQL},
hashed AS (SELECT event_id, 'REC-' || event_id AS record_id, CAST(us AS VARCHAR) AS stamp, sha256('n|' || event_id) AS nonce,
    event_id AS sequence, sha256(CAST(user_id AS VARCHAR)) AS input_sha256, sha256(event_type) AS model_sha256,
    sha256(CAST(cents AS VARCHAR)) AS output_sha256, sha256('resize=64') AS preprocessing_sha256, sha256(props) AS config_sha256
  FROM ev),
records AS (SELECT *, {_RECORD_HASH} AS record_hash FROM hashed)
"""


@query("provenance_records", _RECORDS_SQL + "SELECT record_id, output_sha256, nonce, record_hash FROM records")
def provenance_records(t: Tables):
    return _records(t).select("record_id", "output_sha256", "nonce", "record_hash")


@query("tamper_check", _RECORDS_SQL + """, c AS (SELECT record_id, event_id % 101 = 0 AS o, event_id % 103 = 0 AS m, event_id % 107 = 0 AS h FROM records)
SELECT record_id, concat_ws(',', CASE WHEN m THEN 'MODEL_FILE' END, CASE WHEN o THEN 'OUTPUT_PAYLOAD' END,
    CASE WHEN h THEN 'RECORD_METADATA_OR_HASH_MISMATCH' END) AS tampered, NOT h AS hash_match,
  CASE WHEN o OR m OR h THEN 'TAMPERED' ELSE 'VERIFIED' END AS status,
  NOT (o OR m OR h) AS is_valid, CASE WHEN o OR m OR h THEN 'QUARANTINE' ELSE 'ACCEPT' END AS disposition FROM c""")
def tamper_check(t: Tables):
    records = _records(t)
    seq = F.col("sequence")
    current = records.select(
        "record_id", "input_sha256",
        F.when(seq % 103 == 0, sha256(F.lit("other"))).otherwise(F.col("model_sha256")).alias("model_sha256"),
        F.when(seq % 101 == 0, sha256(F.lit("other"))).otherwise(F.col("output_sha256")).alias("output_sha256"),
    )
    edited = records.withColumn("timestamp", F.when(seq % 107 == 0, "0").otherwise(F.col("timestamp")))
    return provenance.check_records(edited, current).select(
        "record_id", F.array_join("tamper_detected_in", ",").alias("tampered"), "hash_match", "status", "is_valid", "disposition")


# --- replay -----------------------------------------------------------------------------

_R = f"WITH {D.REPLAY_SQL}"


def _reuse_sql(key: str, rule: str) -> str:
    same = " AND ".join(f"p.{k} = l.{k}" for k in key.split(","))
    return f"""SELECT l.arrival, '{rule}' AS rule, arg_min(p.record_id, p.arrival) AS prior_record FROM log l JOIN log p
  ON {same} AND p.arrival < l.arrival AND p.record_id <> l.record_id GROUP BY l.arrival"""


_REASONS = f"""
dup AS (SELECT l.arrival FROM log l WHERE EXISTS (SELECT 1 FROM log p WHERE p.record_id = l.record_id AND p.arrival < l.arrival)),
head AS (SELECT arrival, sequence, MAX(sequence) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM log),
reasons AS (
  SELECT arrival, 'DUPLICATE_RECORD_ID' AS rule, (SELECT record_id FROM log WHERE log.arrival = dup.arrival) AS prior_record FROM dup
  UNION ALL {_reuse_sql("nonce", "NONCE_REUSED")}
  UNION ALL {_reuse_sql("sequence", "SEQUENCE_REUSED")}
  UNION ALL {_reuse_sql("input_sha256,model_sha256,output_sha256", "PAYLOAD_REPEATED")}
  UNION ALL SELECT arrival, 'SEQUENCE_REGRESSION', CAST(h AS VARCHAR) FROM head
    WHERE sequence <= h AND arrival NOT IN (SELECT arrival FROM dup))
"""


@query("replay_reasons", f"{_R}, {_REASONS} SELECT arrival, rule, prior_record FROM reasons")
def replay_reasons(t: Tables):
    return replay.replay_reasons(D.replay_log(t))


@query("replay_summary", f"""{_R}, {_REASONS}, per AS (SELECT arrival, string_agg(rule, ',' ORDER BY rule) AS rules FROM reasons GROUP BY arrival)
SELECT arrival, record_id, rules, rules IS NOT NULL AS is_replay, CASE WHEN rules IS NULL THEN 'LOW' ELSE 'HIGH' END AS severity,
  CASE WHEN rules IS NULL THEN 'ACCEPT' ELSE 'QUARANTINE' END AS disposition FROM log LEFT JOIN per USING (arrival)""")
def replay_summary(t: Tables):
    log = D.replay_log(t)
    rows = replay.replay_summary(log, replay.replay_reasons(log))
    return rows.select("arrival", "record_id", F.array_join("reasons", ",").alias("rules"), "is_replay", "severity", "disposition")


@query("sequence_head", f"{_R} SELECT arrival, MAX(sequence) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM log")
def sequence_head(t: Tables):
    from assaykit.operators.scan import ordered_scan

    return ordered_scan(D.replay_log(t), [], "arrival", max_before={"head": "sequence"}).select("arrival", "head")


@query("record_verification", f"""{_R}, {_REASONS}, flags AS (SELECT DISTINCT arrival FROM reasons),
v AS (SELECT l.arrival, l.record_id, CASE WHEN f.arrival IS NOT NULL THEN 'REPLAY_DETECTED' WHEN l.arrival % 101 = 0 THEN 'TAMPERED' ELSE 'VERIFIED' END AS s
  FROM log l LEFT JOIN flags f USING (arrival))
SELECT arrival, record_id, s AS verification_status, s = 'TAMPERED' AS is_tampered, s = 'REPLAY_DETECTED' AS is_replayed FROM v""")
def record_verification(t: Tables):
    return provenance.record_flags(_verified(t))


def _verified(t: Tables):
    log = D.replay_log(t)
    bound = log.select(
        "arrival", "record_id", "nonce", "sequence", "input_sha256", "model_sha256", "output_sha256",
        sha256(F.lit("p")).alias("preprocessing_sha256"), sha256(F.lit("c")).alias("config_sha256"),
        F.col("stamp_us").cast("string").alias("timestamp"))
    signed = bound.withColumn("record_hash", provenance.record_hash())
    edited = signed.withColumn("timestamp", F.when(F.col("arrival") % 101 == 0, "0").otherwise(F.col("timestamp")))
    return provenance.with_replays(
        provenance.check_records(edited), replay.replayed_arrivals(replay.replay_reasons(log)))


# Submissions, by event number modulo 5: the stored record again; its nonce, sequence and payload
# under another id; a fresh record; its id with another nonce and payload; a fresh record of a
# wrong time, ahead of the clock or malformed. The signature of every 109th does not hold, every
# 101st (but for bad signatures) was changed after signing.
_NOW_US = 1_767_225_600_000_000

_SUBMITTED = """sub AS (SELECT arrival, CASE WHEN arrival % 5 IN (0, 3) THEN record_id ELSE 'NEW-' || arrival END AS record_id,
    CASE WHEN arrival % 5 IN (0, 1) THEN nonce ELSE sha256('fresh|' || arrival) END AS nonce,
    CASE WHEN arrival % 5 IN (0, 1, 3) THEN sequence ELSE sequence + 1000000000 END AS sequence,
    CASE WHEN arrival % 5 IN (0, 1) THEN input_sha256 ELSE sha256('fresh|' || arrival) END AS input_sha256, model_sha256, output_sha256,
    CASE WHEN arrival % 10 = 4 THEN '2026-01-01T00:10:00Z' WHEN arrival % 10 = 9 THEN '10 past 8' ELSE '2025-12-31T00:00:00Z' END AS timestamp
  FROM log)"""


def _submitted(t: Tables):
    kind, fresh = F.col("arrival") % 5, sha256(F.concat(F.lit("fresh|"), "arrival"))
    at = F.when(F.col("arrival") % 10 == 4, "2026-01-01T00:10:00Z").when(F.col("arrival") % 10 == 9, "10 past 8")
    return D.replay_log(t).withColumns({
        "record_id": F.when(kind.isin(0, 3), F.col("record_id")).otherwise(F.concat(F.lit("NEW-"), "arrival")),
        "nonce": F.when(kind.isin(0, 1), F.col("nonce")).otherwise(fresh),
        "sequence": F.when(kind.isin(0, 1, 3), F.col("sequence")).otherwise(F.col("sequence") + 1_000_000_000),
        "input_sha256": F.when(kind.isin(0, 1), F.col("input_sha256")).otherwise(fresh),
        "timestamp": at.otherwise("2025-12-31T00:00:00Z"),
    })


def _submission_sql(own: str) -> str:
    """``own``: what a registered row of the same id must fulfil to count."""
    by_key = " UNION ALL ".join(f"""SELECT s.arrival, '{rule}' AS rule, {text} || arg_min(p.record_id, p.arrival) || '''' AS text
      FROM sub s JOIN log p ON {" AND ".join(f"p.{k} = s.{k}" for k in keys)} AND p.record_id <> s.record_id GROUP BY s.arrival, s.nonce, s.sequence""" for rule, keys, text in (
        ("NONCE_REUSED", ["nonce"], "'nonce ''' || s.nonce || ''' was used by record '''"),
        ("SEQUENCE_REUSED", ["sequence"], "'sequence ' || s.sequence || ' was used by record '''"),
        ("PAYLOAD_REPEATED", replay.PAYLOAD_KEY, "'input, model and output are those of record '''")))
    return f"""{_R}, {_SUBMITTED}, reasons AS (
    SELECT DISTINCT s.arrival, 'DUPLICATE_RECORD_ID' AS rule, 'record id ''' || s.record_id || ''' is registered already' AS text
      FROM sub s JOIN log p ON p.record_id = s.record_id AND {own}
    UNION ALL {by_key}
    UNION ALL SELECT arrival, 'SEQUENCE_REGRESSION', 'sequence ' || sequence || ' is not above the head ' || (SELECT MAX(sequence) FROM log)
      FROM sub WHERE sequence <= (SELECT MAX(sequence) FROM log) AND record_id NOT IN (SELECT record_id FROM log)
    UNION ALL SELECT arrival, 'TIMESTAMP_FUTURE', 'timestamp lies 600.0 seconds ahead' FROM sub WHERE timestamp = '2026-01-01T00:10:00Z'
    UNION ALL SELECT arrival, 'TIMESTAMP_MALFORMED', 'timestamp is not an ISO time' FROM sub WHERE timestamp = '10 past 8'),
  per AS (SELECT arrival, string_agg(rule, ',' ORDER BY rule) AS rules, string_agg(text, '; ' ORDER BY rule) AS texts FROM reasons GROUP BY arrival),
  v AS (SELECT s.arrival, s.record_id, rules, texts, CASE WHEN rules IS NOT NULL THEN 'REPLAY_DETECTED' WHEN s.arrival % 109 = 0 THEN 'INVALID_SIGNATURE'
    WHEN s.arrival % 101 = 0 THEN 'TAMPERED' ELSE 'VERIFIED' END AS status FROM sub s LEFT JOIN per USING (arrival))
  SELECT arrival, record_id, rules, status, status = 'VERIFIED' AS is_valid, CASE WHEN status = 'VERIFIED' THEN 'ACCEPT' ELSE 'QUARANTINE' END AS disposition,
    CASE status WHEN 'REPLAY_DETECTED' THEN 'Replay: ' || texts WHEN 'INVALID_SIGNATURE' THEN 'The signature does not belong to the record'
      WHEN 'TAMPERED' THEN 'Changed since signing: RECORD_METADATA_OR_HASH_MISMATCH' ELSE 'All hashes and the signature hold' END AS details FROM v"""


def _verified_submissions(t: Tables, exclude_self: bool):
    rows = _submitted(t)
    signed = rows.withColumns({"preprocessing_sha256": sha256(F.lit("p")), "config_sha256": sha256(F.lit("c"))}).withColumn("record_hash", provenance.record_hash())
    changed = F.when(F.col("arrival") % 101 == 0, sha256(F.lit("x"))).otherwise(F.col("config_sha256"))
    checked = provenance.check_records(signed.withColumn("config_sha256", changed), signature_valid=F.col("arrival") % 109 != 0)
    reasons = replay.submission_reasons(rows, D.replay_log(t), _NOW_US, exclude_self)
    verified = provenance.with_replays(checked, replay.described(rows, reasons))
    return verified.select("arrival", "record_id", F.array_join("reasons", ",").alias("rules"), "status", "is_valid", "disposition",
                           provenance.status_details().alias("details"))


@query("verify_submissions", _submission_sql("true"))
def verify_submissions(t: Tables):
    return _verified_submissions(t, False)


@query("verify_submissions_without_self", _submission_sql(
    "(p.nonce <> s.nonce OR p.sequence <> s.sequence OR p.input_sha256 <> s.input_sha256 OR p.model_sha256 <> s.model_sha256 OR p.output_sha256 <> s.output_sha256)"))
def verify_submissions_without_self(t: Tables):
    return _verified_submissions(t, True)


@query("replay_reasons_unregistered")
def replay_reasons_unregistered(t: Tables):
    """Flagged records don't enter the log; tested against a loop, as SQL has no such order-bound choice."""
    return replay.replay_reasons(D.replay_log(t), register_replays=False)


@query("record_status_counts", f"""{_R}, {_REASONS}, flags AS (SELECT DISTINCT arrival FROM reasons)
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE f.arrival IS NULL AND l.arrival % 101 = 0) AS tampered,
  COUNT(f.arrival) AS replayed, COUNT(*) - COUNT(f.arrival) - COUNT(*) FILTER (WHERE f.arrival IS NULL AND l.arrival % 101 = 0) AS valid
FROM log l LEFT JOIN flags f USING (arrival)""")
def record_status_counts(t: Tables):
    return provenance.status_counts(provenance.record_flags(_verified(t)))


# --- windows ----------------------------------------------------------------------------

_STATUS = """statuses AS (SELECT ts, user_id, value, event_type = 'error' AS is_tampered, event_type = 'click' AS is_replayed FROM events)"""


def _statuses(t: Tables):
    return t.events.select("ts", "user_id", "value", (F.col("event_type") == "error").alias("is_tampered"),
                           (F.col("event_type") == "click").alias("is_replayed"))


@query("daily_status", f"""WITH {_STATUS} SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start_us, COUNT(*) AS total,
  COUNT(*) FILTER (WHERE is_tampered) AS tampered, COUNT(*) FILTER (WHERE is_replayed) AS replayed,
  COUNT(*) FILTER (WHERE NOT is_tampered AND NOT is_replayed) AS valid FROM statuses GROUP BY 1""")
def daily_status(t: Tables):
    return windows.status_per_window(_statuses(t), "1 day")


@query("sliding_status", f"""WITH {_STATUS}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * CAST(unnest(range(0, 4)) AS INTEGER)) AS s FROM statuses)
SELECT epoch_us(s) AS start_us, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_tampered) AS tampered,
  COUNT(*) FILTER (WHERE is_replayed) AS replayed, COUNT(*) FILTER (WHERE NOT is_tampered AND NOT is_replayed) AS valid FROM w GROUP BY 1""")
def sliding_status(t: Tables):
    return windows.status_per_window(_statuses(t), "1 day", "6 hours")


@query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS records FROM s GROUP BY user_id, sid""")
def user_sessions(t: Tables):
    return windows.sessions(t.events, "user_id", "12 hours")


@query("windowed_drift", f"""WITH base AS (SELECT value FROM events WHERE event_id % 2 = 0),
q AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM base),
rb AS (SELECT least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS bin, COUNT(*) AS r FROM base, q GROUP BY 1),
ref AS (SELECT g.bin, coalesce(r, 0) AS r, (SELECT COUNT(*) FROM base) AS n FROM (SELECT unnest(range(1, len(e))) AS bin FROM q) g LEFT JOIN rb USING (bin)),
wb AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS s, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS bin, COUNT(*) AS c
  FROM events, q WHERE value >= e[1] AND value <= e[-1] GROUP BY 1, 2),
wn AS (SELECT s, SUM(c) AS n FROM wb GROUP BY s),
cells AS (SELECT wn.s, (ref.r + 1e-4::DOUBLE) / (ref.n + 10 * 1e-4::DOUBLE) AS pr, (coalesce(wb.c, 0) + 1e-4::DOUBLE) / (wn.n + 10 * 1e-4::DOUBLE) AS pc
  FROM wn CROSS JOIN ref LEFT JOIN wb ON wb.s = wn.s AND wb.bin = ref.bin)
SELECT epoch_us(s) AS start_us, round(least(10.0::DOUBLE, greatest(0.0::DOUBLE, SUM((pc - pr) * ln(pc / pr)))), 6) AS psi FROM cells GROUP BY s""")
def windowed_drift(t: Tables):
    baseline = windows.baseline_bins(t.events.where("event_id % 2 = 0"), "value")
    rows = windows.drift_per_window(t.events, "value", baseline, "1 day")
    return rows.select("start_us", F.round("psi", 6).alias("psi"))


@query("session_drift", f"""WITH base AS (SELECT value FROM events WHERE event_id % 2 = 0),
q AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM base),
rb AS (SELECT least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS bin, COUNT(*) AS r FROM base, q GROUP BY 1),
ref AS (SELECT g.bin, (coalesce(r, 0) + 1e-4::DOUBLE) / ((SELECT COUNT(*) FROM base) + 10 * 1e-4::DOUBLE) AS pr
  FROM (SELECT unnest(range(1, len(e))) AS bin FROM q) g LEFT JOIN rb USING (bin)),
g AS (SELECT user_id, ts, value, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
heads AS (SELECT user_id, sid, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS records, COUNT(*) FILTER (WHERE value >= e[1] AND value <= e[-1]) AS n FROM s, q GROUP BY 1, 2),
sb AS (SELECT user_id, sid, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS bin, COUNT(*) AS c
  FROM s, q WHERE value >= e[1] AND value <= e[-1] GROUP BY ALL),
cells AS (SELECT h.*, ref.pr, (coalesce(sb.c, 0) + 1e-4::DOUBLE) / (h.n + 10 * 1e-4::DOUBLE) AS pc
  FROM heads h CROSS JOIN ref LEFT JOIN sb ON sb.user_id = h.user_id AND sb.sid = h.sid AND sb.bin = ref.bin)
SELECT user_id, start_us, records, n, CASE WHEN n > 0 THEN round(least(10.0::DOUBLE, greatest(0.0::DOUBLE, SUM((pc - pr) * ln(pc / pr)))), 6) END AS psi
FROM cells GROUP BY user_id, start_us, records, n""")
def session_drift(t: Tables):
    baseline = windows.baseline_bins(t.events.where("event_id % 2 = 0"), "value")
    rows = windows.drift_per_session(t.events, "user_id", "value", baseline, "6 hours")
    return rows.withColumn("psi", F.round("psi", 6))


@query("nonce_dedup", f"{_R} SELECT nonce, MIN(arrival) AS arrival FROM log GROUP BY nonce")
def nonce_dedup(t: Tables):
    return D.replay_log(t).groupBy("nonce").agg(F.min("arrival").alias("arrival"))
