"""Hashes, signatures, provenance, ledger and replay."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from assaykit.functions import ed25519
from assaykit.functions.hashing import canonical_json, canonical_object
from assaykit.functions.paths import escapes_root, extension, safe_name, stem
from assaykit.functions.times import iso_micros
from assaykit.operators import ledger, provenance, replay, signatures

# RFC 8032, section 7.1: seed, public key, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60",
     "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
     "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb",
     "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
     "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize("seed,public,message,signature", VECTORS)
def test_ed25519_vectors(seed, public, message, signature):
    seed, public, message, signature = (bytes.fromhex(x) for x in (seed, public, message, signature))
    assert ed25519.public_key(seed) == public
    assert ed25519.sign(seed, message) == signature
    assert ed25519.verify(public, message, signature)
    assert not ed25519.verify(public, message + b"x", signature)
    assert not ed25519.verify(public, message, b"\x00" * 64)


def test_canonical_text(spark):
    row = {"b": 'q"\\', "a": 5, "ok": True}
    df = spark.createDataFrame([(row["b"], row["a"], row["ok"])], "b STRING, a BIGINT, ok BOOLEAN")
    text = df.select(canonical_object({c: F.col(c) for c in df.columns}).alias("t")).first()["t"]
    assert text == json.dumps(row, sort_keys=True, separators=(",", ":"))
    loose = '{"z": [1.0, 1e-05], "é": "ü", "a": {"y": 1, "x": null}}'
    got = spark.createDataFrame([(loose,), ("{broken",)], "t STRING").select(canonical_json("t").alias("t")).collect()
    assert got[0]["t"] == json.dumps(json.loads(loose), sort_keys=True, separators=(",", ":")) and got[1]["t"] is None


def test_paths(spark):
    rows = [("a/b.tar.gz", "b.tar", ".gz", "b.tar.gz", False), ("../x y.png", "x y", ".png", "x_y.png", True),
            ("a/../b", "b", "", "b", False), ("a/../../b/.hid", ".hid", "", ".hid", True), ("/abs/", "", "", "unnamed_asset", True)]
    df = spark.createDataFrame(rows, "p STRING, s STRING, e STRING, n STRING, u BOOLEAN")
    p = F.col("p")
    for r in df.select("*", stem(p).alias("s2"), extension(p).alias("e2"), safe_name(p).alias("n2"), escapes_root(p).alias("u2")).collect():
        assert (r["s"], r["e"], r["n"], r["u"]) == (r["s2"], r["e2"], r["n2"], r["u2"]), r["p"]


def test_iso_times(spark):
    cases = {"2024-01-01T00:00:00Z": 1704067200000000, "2024-01-01T02:00:00.5+02:00": 1704067200500000,
             "2024-01-01T00:00:00": 1704067200000000, "2024-01-01": 1704067200000000, "junk": None, "2024-13-01T00:00:00Z": None}
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    assert {r["t"]: r["u"] for r in df.select("t", iso_micros(F.col("t")).alias("u")).collect()} == cases


def _records(spark, n=4):
    rows = spark.range(n).select(
        F.concat(F.lit("R"), "id").alias("record_id"), F.lit("2024-01-01T00:00:00+00:00").alias("timestamp"),
        F.concat(F.lit("n"), "id").alias("nonce"), F.col("id").alias("sequence"), F.col("id").alias("arrival"))
    components = {c: F.concat(F.lit(c), "sequence") for c in provenance.COMPONENTS}
    built = provenance.build_records(rows, components).withColumn("arrival", F.col("sequence"))
    return signatures.sign_records(built, bytes(range(32)))


def test_record_hash_is_canonical_json(spark):
    row = _records(spark, 1).first()
    body = {c: row[c] for c in provenance.BOUND_FIELDS}
    assert row["record_hash"] == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_verification_statuses(spark):
    records = _records(spark)
    edited = records.withColumn("signature", F.when(F.col("sequence") == 2, "0" * 128).otherwise(F.col("signature")))
    current = records.select("record_id", F.when(F.col("sequence") == 1, "other").otherwise(F.col("output_sha256")).alias("output_sha256"))
    checked = provenance.check_records(signatures.verify_signatures(edited), current, F.col("signature_ok"))
    rows = {r["sequence"]: r for r in checked.collect()}
    assert [rows[i]["status"] for i in range(4)] == ["VERIFIED", "TAMPERED", "INVALID_SIGNATURE", "VERIFIED"]
    assert rows[1]["tamper_detected_in"] == ["OUTPUT_PAYLOAD"] and rows[2]["tamper_detected_in"] == ["ED25519_DIGITAL_SIGNATURE"]
    replayed = spark.createDataFrame([(3, ["NONCE_REUSED"])], "arrival BIGINT, reasons ARRAY<STRING>")
    final = {r["record_id"]: r for r in provenance.record_flags(provenance.with_replays(checked, replayed)).collect()}
    assert final["R3"]["is_replayed"] and final["R2"]["is_tampered"] and not final["R0"]["is_tampered"]
    counts = provenance.status_counts(provenance.record_flags(provenance.with_replays(checked, replayed))).first()
    assert (counts["total"], counts["tampered"], counts["replayed"], counts["valid"]) == (4, 2, 1, 1)


def test_malformed_signatures_are_invalid(spark):
    rows = [("h", None, "00"), ("h", "zz", "00" * 32), ("h", "00" * 64, "11")]
    df = spark.createDataFrame(rows, "record_hash STRING, signature STRING, public_key_hex STRING")
    assert [r["signature_ok"] for r in signatures.verify_signatures(df).collect()] == [False] * 3


def _ledger(spark, n=30, chains=2):
    return ledger.append(spark.range(n).select(
        F.concat(F.lit("c"), F.col("id") % chains).alias("chain"), F.col("id").alias("seq"), F.lit("t").alias("timestamp"),
        F.lit("me").alias("actor"), F.lit("do").alias("action"), F.col("id").cast("string").alias("asset"), F.lit("{}").alias("metadata_json")))


def test_ledger_hashes_and_tampering(spark):
    rows = _ledger(spark).where("chain = 'c0'").orderBy("seq").collect()
    head = ledger.GENESIS
    for r in rows:
        assert r["previous_hash"] == head
        head = hashlib.sha256(f"{head}|t|me|do|{r['asset']}|{{}}".encode()).hexdigest()
        assert r["current_hash"] == head
    broken = _ledger(spark).withColumn("current_hash", F.when(F.col("seq") == 4, "deadbeef" * 8).otherwise(F.col("current_hash")))
    got = {r["chain"]: r for r in ledger.verify(broken).collect()}
    assert (got["c0"]["status"], got["c0"]["broken_index"], got["c0"]["broken_kind"]) == ("TAMPERED", 2, "CONTENT")
    assert got["c1"]["status"] == "VALID" and got["c1"]["head_hash"]
    cut = {r["chain"]: r for r in ledger.verify(_ledger(spark).where("seq <> 4")).collect()}
    assert (cut["c0"]["broken_index"], cut["c0"]["broken_kind"]) == (2, "LINK")
    assert ledger.verify(_ledger(spark).where("false")).count() == 0


def test_ledger_continues_from_heads(spark):
    whole = _ledger(spark, 20)
    first = whole.where("seq < 11")
    rest = whole.where("seq >= 11").drop("previous_hash", "current_hash")
    again = ledger.append(rest, ledger.heads(first))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in whole.where("seq >= 11").collect()}


def test_replay_rules(spark):
    rows = [(0, "A", "n0", 10, "2024-01-01T00:00:00Z"), (1, "B", "n1", 11, "2024-01-01T00:00:00Z"),
            (2, "B", "n2", 12, "bad"), (3, "C", "n0", 9, "2030-01-01T00:00:00Z"), (4, "D", "n4", 11, "2024-01-01T00:00:00Z")]
    log = spark.createDataFrame(rows, "arrival BIGINT, record_id STRING, nonce STRING, sequence BIGINT, timestamp STRING")
    log = log.withColumns({c: F.col("nonce") for c in replay.PAYLOAD_KEY})
    got = {(r["arrival"], r["rule"], r["prior_record"]) for r in replay.replay_reasons(log, now_us=1704067200000000).collect()}
    assert {g[:2] for g in got} == {
        (2, "DUPLICATE_RECORD_ID"), (2, "TIMESTAMP_MALFORMED"), (3, "NONCE_REUSED"), (3, "SEQUENCE_REGRESSION"),
        (3, "TIMESTAMP_FUTURE"), (3, "PAYLOAD_REPEATED"), (4, "SEQUENCE_REUSED"), (4, "SEQUENCE_REGRESSION")}
    assert (3, "NONCE_REUSED", "A") in got and (4, "SEQUENCE_REUSED", "B") in got


def test_hot_nonce(spark):
    log = spark.range(3000).select(
        F.col("id").alias("arrival"), F.concat(F.lit("R"), "id").alias("record_id"), F.col("id").alias("sequence"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("nonce"))
    log = log.withColumns({c: F.col("record_id") for c in replay.PAYLOAD_KEY})
    rows = replay.replay_reasons(log).collect()
    assert len(rows) == 999 and {r["prior_record"] for r in rows} == {"R0"}


def _random_log(seed, n=70):
    rnd = random.Random(seed)
    pick = lambda i, share: i if rnd.random() > share else rnd.randrange(n)
    rows = []
    for i in range(n):
        payload = str(pick(i, 0.2))
        stamp = "2024-01-01T00:00:00Z" if rnd.random() > 0.1 else rnd.choice(["2030-01-01T00:00:00Z", "bad"])
        rows.append((i, f"R{pick(i, 0.15)}", f"n{pick(i, 0.2)}", i + rnd.choice([0, 0, 0, 0, 6, -3]), payload, payload, payload, stamp))
    return rows


_LOG = "arrival BIGINT, record_id STRING, nonce STRING, sequence BIGINT, input_sha256 STRING, model_sha256 STRING, output_sha256 STRING, timestamp STRING"


def _rules(row, seen):
    """Rules that a record breaks against the rows ``seen``, with the earliest other user of a value."""
    _, record, nonce, sequence, *payload, stamp = row
    found = {("DUPLICATE_RECORD_ID", record) for r in seen if r[1] == record}
    keys = {"NONCE_REUSED": lambda r: r[2] == nonce, "SEQUENCE_REUSED": lambda r: r[3] == sequence, "PAYLOAD_REPEATED": lambda r: list(r[4:7]) == payload}
    for rule, same in keys.items():
        others = [r[1] for r in seen if same(r) and r[1] != record]
        found |= {(rule, others[0])} if others else set()
    head = max((r[3] for r in seen), default=None)
    if head is not None and sequence <= head and not any(r[1] == record for r in seen):
        found.add(("SEQUENCE_REGRESSION", str(head)))
    if stamp == "bad":
        found.add(("TIMESTAMP_MALFORMED", "bad"))
    elif stamp.startswith("2030"):
        found.add(("TIMESTAMP_FUTURE", None))
    return found


def _found(reasons):
    got = {}
    for r in reasons.collect():
        got.setdefault(r["arrival"], set()).add((r["rule"], None if r["rule"] == "TIMESTAMP_FUTURE" else r["prior_record"]))
    return got


def test_flagged_records_stay_out_of_the_log(spark):
    rows, entered, want = _random_log(5), [], {}
    for row in rows:
        broken = _rules(row, entered)
        if broken:
            want[row[0]] = broken
        else:
            entered.append(row)
    log = spark.createDataFrame(rows, _LOG)
    assert _found(replay.replay_reasons(log, 1704067200000000, register_replays=False)) == want
    assert 0 < len(entered) < 70 and len({r for v in want.values() for r, _ in v}) == 7


def test_submissions_against_a_stored_log(spark):
    stored, rows = _random_log(6), _random_log(7)[:30]
    # the first ten stored records again, some with another nonce
    rows = [(100 + i, *r[1:]) for i, r in enumerate(rows)] + [(i, r[1], r[2] if i % 2 else "other", *r[3:]) for i, r in enumerate(stored[:10])]
    log, submitted = spark.createDataFrame(stored, _LOG), spark.createDataFrame(rows, _LOG)
    want = {r[0]: _rules(r, stored) for r in rows}
    assert _found(replay.submission_reasons(submitted, log, 1704067200000000)) == {a: v for a, v in want.items() if v}
    for r in rows:
        if all(s[2:7] == r[2:7] for s in stored if s[1] == r[1]):
            want[r[0]] = {v for v in want[r[0]] if v[0] != "DUPLICATE_RECORD_ID"}
    reasons = replay.submission_reasons(submitted, log, 1704067200000000, exclude_self=True)
    assert _found(reasons) == {a: v for a, v in want.items() if v}
    texts = {r["arrival"]: r for r in replay.described(submitted, reasons).collect()}
    assert all(len(texts[a]["detail"].split("; ")) == len(v) == len(texts[a]["reasons"]) for a, v in want.items() if v)
    empty = submitted.where("false")
    assert replay.submission_reasons(empty, log).count() == 0
    assert replay.submission_reasons(submitted, log.where("false")).count() == 0


def test_rounds_keep_only_rows_that_decide(spark):
    """Of a long log with few replays, the rows that go through the rounds are few."""
    rows = [(i, f"r{i}", f"n{i}", i, f"i{i}", "m", "o") for i in range(2_000)]
    rows += [(2_000, "r9", "n2000", 2_000, "i2000", "m", "o"), (2_001, "r2001", "n2001", 40, "i2001", "m", "o"), (2_002, "r2002", "n2001", 2_002, "i2002", "m", "o")]
    log = spark.createDataFrame(rows, "arrival BIGINT, record_id STRING, nonce STRING, sequence BIGINT, input_sha256 STRING, model_sha256 STRING, output_sha256 STRING")
    kept, doubtful = replay._in_doubt(log, None, None)
    assert {r["arrival"] for r in doubtful.collect()} == {2_000, 2_001, 2_002}
    assert {r["arrival"] for r in kept.collect()} == {9, 40, 1_999, 2_000, 2_001, 2_002}
    found = {(r["arrival"], r["rule"]) for r in replay.replay_reasons(log, register_replays=False).collect()}
    assert found == {(2_000, "DUPLICATE_RECORD_ID"), (2_001, "SEQUENCE_REUSED"), (2_001, "SEQUENCE_REGRESSION")}


def test_submissions_shuffle_keys_once(spark, monkeypatch):
    """Only keys stored under several record ids go through the log a second time."""
    stored = []
    kept = replay.checkpointed
    monkeypatch.setattr(replay, "checkpointed", lambda df: stored.append(kept(df)) or stored[-1])
    columns = "arrival BIGINT, record_id STRING, nonce STRING, sequence BIGINT, input_sha256 STRING, model_sha256 STRING, output_sha256 STRING"
    log = [(i, f"r{i}", f"n{i}", i, f"i{i}", "m", "o") for i in range(400)] + [(400, "late", "n7", 400, "x", "m", "o")]
    asked = [(i, f"new{i}", f"n{i}", i + 1_000, f"i{i}", "m", "o") for i in range(400)] + [(400, "r7", "n7", 2_000, "y", "m", "o")]
    found = replay.submission_reasons(spark.createDataFrame(asked, columns), spark.createDataFrame(log, columns))
    want = {(i, rule, f"r{i}") for i in range(400) for rule in ("NONCE_REUSED", "PAYLOAD_REPEATED")}
    want |= {(400, "DUPLICATE_RECORD_ID", "r7"), (400, "NONCE_REUSED", "late")}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    # of 1604 keyed rows: those that meet a key, and the few of the key with two ids
    assert sum(df.count() for df in stored) <= 802 + 10


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [8, 9])
def test_replay_reasons_match_loop(spark, seed):
    rows = _random_log(seed)
    # whole records again, and one that brings its own nonce and payload after another's use of them
    rows += [(70, *rows[3][1:]), (71, *rows[3][1:]), (72, "X", *rows[5][2:]), (73, *rows[5][1:])]
    want = {row[0]: _rules(row, rows[:i]) for i, row in enumerate(rows)}
    log = spark.createDataFrame(rows, _LOG).repartition(5)
    assert _found(replay.replay_reasons(log, 1704067200000000)) == {a: v for a, v in want.items() if v}


def test_null_keys_have_no_reason(spark):
    rows = [(i, f"r{i}", None, None, "i", None if i < 2 else "m", "o") for i in range(4)]
    log = spark.createDataFrame(rows, _LOG.removesuffix(", timestamp STRING"))
    assert [tuple(r) for r in replay.replay_reasons(log).collect()] == [(3, "PAYLOAD_REPEATED", "r2")]


def test_verification_moves_the_log_as_numbers(spark, monkeypatch):
    """The pass over all keys shuffles digests, the hash check is compiled, and few flags don't shuffle the log."""
    plans = []
    kept = replay.checkpointed
    monkeypatch.setattr(replay, "checkpointed", lambda df: plans.append(_plan(df)) or kept(df))
    log = spark.createDataFrame(_random_log(10), _LOG).withColumns({"preprocessing_sha256": F.lit("p"), "config_sha256": F.lit("c")})
    signed = log.withColumn("record_hash", provenance.record_hash())
    flagged = replay.replayed_arrivals(replay.replay_reasons(log))
    final = provenance.record_flags(provenance.with_replays(provenance.check_records(signed), flagged))
    assert "Exchange hashpartitioning(_digest" in plans[0] and "Exchange hashpartitioning(rule" not in plans[0]
    # an anti join would go down to the whole log
    assert not any("LeftAnti" in plan for plan in plans)
    assert "lambdafunction" not in _plan(final) and "Exchange hashpartitioning" not in _plan(final)
    assert final.count() == 70 and final.where("is_replayed").count() == flagged.count() > 0
