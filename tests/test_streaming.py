"""Streams give what the batch operators give."""

import random

import pandas as pd
from pyspark.sql import functions as F

from assaykit.functions.hashing import sha256
from assaykit.operators import ledger, provenance, replay, windows
from assaykit.streaming import ledger as ledger_stream
from assaykit.streaming import replay as replay_stream
from assaykit.streaming import windows as window_stream
from assaykit.streaming.sources import read_log, write_files


def _finish(query):
    query.awaitTermination(120)
    assert query.exception() is None
    assert not query.isActive


def _log(spark, n=120, seed=3):
    rnd = random.Random(seed)
    rows = [
        (i, f"R{rnd.randrange(n)}", f"n{rnd.randrange(n)}", rnd.randrange(n * 2), f"i{rnd.randrange(6)}", "m", f"o{rnd.randrange(6)}")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "arrival BIGINT, record_id STRING, nonce STRING, sequence BIGINT, input_sha256 STRING, model_sha256 STRING, output_sha256 STRING"
    )


def _files_in_order(df, path, order, parts=3):
    """One file per slice of the order column, written oldest first."""
    total = df.count()
    for i in range(parts):
        low, high = total * i // parts, total * (i + 1) // parts
        df.where((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.mode("append").parquet(path)


def test_replay_stream_equals_batch(spark, folder):
    log = _log(spark)
    _files_in_order(log, f"{folder}/in", "arrival")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    stream = read_log(spark, f"{folder}/in", schema, files_per_trigger=1)
    _finish(replay_stream.write_reasons(stream, f"{folder}/out", f"{folder}/cp"))
    got = {tuple(r) for r in replay_stream.read_reasons(spark, f"{folder}/out").collect()}
    want = {tuple(r) for r in replay.replay_reasons(log).select("arrival", "rule", "prior_record").collect()}
    assert got == want and want


def test_hot_keys_and_missing_values_on_a_stream(spark, folder):
    # one nonce on two thirds of all rows, several streams, null keys, ids that repeat
    log = _log(spark, 150, seed=9).withColumn("site", F.when(F.col("arrival") % 5 > 0, F.col("arrival") % 3))
    log = log.withColumn("nonce", F.when(F.col("arrival") % 3 > 0, "hot").when(F.col("arrival") % 2 == 0, F.col("nonce")))
    log = log.withColumn("sequence", F.when(F.col("arrival") % 11 > 0, F.col("sequence")))
    _files_in_order(log.repartition(7), f"{folder}/in", "arrival", 4)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    stream = read_log(spark, f"{folder}/in", schema, files_per_trigger=1)
    _finish(replay_stream.write_reasons(stream, f"{folder}/out", f"{folder}/cp", stream="site"))
    got = {tuple(r) for r in replay_stream.read_reasons(spark, f"{folder}/out").collect()}
    filled = log.withColumn("site", F.coalesce(F.col("site").cast("string"), F.lit("")))
    want = {tuple(r) for r in replay.replay_reasons(filled, stream=["site"]).collect()}
    assert got == want
    assert {rule for _, rule, _ in want} == {"DUPLICATE_RECORD_ID", "NONCE_REUSED", "SEQUENCE_REUSED", "PAYLOAD_REPEATED", "SEQUENCE_REGRESSION"}


def test_facts_reduced_before_the_shuffle():
    rows = pd.DataFrame({"rule": ["r"] * 6, "key": ["k"] * 5 + ["l"], "arrival": [5, 3, 9, 4, 7, 1], "record_id": ["a", "b", "c", "b", "a", "z"]})
    reduced = pd.concat(replay_stream._sightings(iter([rows])))
    assert sorted(zip(reduced["key"], reduced["arrival"], reduced["record_id"], reduced["n"])) == [
        ("k", 3, "b", 5), ("k", 5, "a", 0), ("l", 1, "z", 1)]


def test_ledger_stream_equals_batch(spark, folder):
    entries = spark.range(60).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("chain"), F.col("id").alias("seq"), F.lit("t").alias("timestamp"),
        F.lit("me").alias("actor"), F.lit("do").alias("action"), F.col("id").cast("string").alias("asset"), F.lit("{}").alias("metadata_json"))
    _files_in_order(entries, f"{folder}/in", "seq")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    stream = read_log(spark, f"{folder}/in", schema, files_per_trigger=1)
    _finish(write_files(ledger_stream.append(stream), f"{folder}/out", f"{folder}/cp"))
    written = spark.read.parquet(f"{folder}/out")
    assert {tuple(r) for r in written.collect()} == {tuple(r) for r in ledger.append(entries).collect()}
    assert {r["status"] for r in ledger.verify(written).collect()} == {"VALID"}


def test_windows_and_nonces_on_streams(spark, folder):
    rows = spark.range(400).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800).alias("ts"), (F.col("id") % 7).alias("user_id"),
        (F.col("id") % 50).cast("double").alias("value"), (F.col("id") % 5 == 0).alias("is_tampered"), (F.col("id") % 5 == 1).alias("is_replayed"),
        F.concat(F.lit("n"), F.floor(F.col("id") / 2)).alias("nonce"))
    rows.coalesce(1).write.parquet(f"{folder}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(stream, name, mode="append"):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        _finish(query)
        return {tuple(r) for r in spark.table(name).collect()}

    source = lambda: read_log(spark, f"{folder}/in", schema)
    got = run(window_stream.status_per_window(source(), "1 hour", "1 day"), "status", "complete")
    assert got == {tuple(r) for r in windows.status_per_window(rows, "1 day").collect()}
    baseline = windows.baseline_bins(rows, "value")
    got = run(window_stream.drift_per_window(source(), "value", baseline, "1 hour", "1 day"), "drift", "complete")
    assert got == {tuple(r) for r in windows.drift_per_window(rows, "value", baseline, "1 day").collect()}
    got = run(window_stream.sessions(source(), "user_id", "4 hours", "1 hour"), "sessions", "complete")
    assert got == {tuple(r) for r in windows.sessions(rows, "user_id", "4 hours").collect()}
    got = run(window_stream.first_uses(source(), "10 days").select("nonce"), "nonces")
    assert len(got) == 200


def test_session_drift_stream_equals_batch(spark, folder):
    rnd = random.Random(4)
    start, hour = 1704067200, 3600
    rows, at = [], {}
    for i in range(500):
        user = "busy" if i % 3 == 0 else rnd.choice("abc")
        # gaps of exactly four hours part sessions
        at[user] = at.get(user, 0) + rnd.choice([60, 1800, hour, 4 * hour - 1, 4 * hour, 9 * hour])
        rows.append((at[user], user, None if i % 17 == 0 else float(rnd.randrange(60))))
    rows.append((10_000 * hour, "end", 1.0))
    rows.sort(key=lambda r: r[0])
    order = list(range(len(rows)))
    # neighbours swap places and so arrive late, within the watermark
    for i in range(0, len(order) - 2, 7):
        order[i], order[i + 1] = order[i + 1], order[i]
    made = [(i, *rows[j]) for i, j in enumerate(order)]
    frame = spark.createDataFrame(made, "n BIGINT, at BIGINT, user_id STRING, value DOUBLE")
    frame = frame.select("n", F.timestamp_seconds(F.col("at") + start).alias("ts"), "user_id", "value")
    _files_in_order(frame, f"{folder}/in", "n", 4)
    baseline = windows.baseline_bins(spark.range(40).select(F.col("id").cast("double").alias("value")), "value")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    stream = read_log(spark, f"{folder}/in", schema, files_per_trigger=1)
    out = window_stream.drift_per_session(stream, "user_id", "value", baseline, "4 hours", "60 hours")
    _finish(write_files(out, f"{folder}/out", f"{folder}/cp"))
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())
    batch = windows.drift_per_session(frame, "user_id", "value", baseline, "4 hours")
    assert got == sorted(tuple(r) for r in batch.where("user_id <> 'end'").collect())
    runs, previous = {}, {}
    for moment, user, _ in rows:
        if user not in previous or moment - previous[user] >= 4 * hour:
            opened = runs.setdefault(user, [])
            opened.append([moment, 0])
        runs[user][-1][1] += 1
        previous[user] = moment
    want = sorted((u, (m + start) * 1_000_000, c) for u, r in runs.items() for m, c in r)
    assert sorted(tuple(r) for r in batch.select("user_id", "start_us", "records").collect()) == want
    assert batch.where("n = 0 AND psi IS NULL").count() + batch.where("n > 0 AND psi > 0").count() == len(want)


def test_verification_stream(spark, folder):
    log = _log(spark, 60).select(
        "*", F.lit("p").alias("preprocessing_sha256"), F.lit("c").alias("config_sha256"), F.col("arrival").cast("string").alias("timestamp"))
    log = log.withColumn("record_hash", F.when(F.col("arrival") % 7 == 0, sha256(F.lit("x"))).otherwise(provenance.record_hash()))
    _files_in_order(log, f"{folder}/in", "arrival")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    _finish(replay_stream.check_batches(read_log(spark, f"{folder}/in", schema, 1), f"{folder}/checked", f"{folder}/cp1"))
    _finish(replay_stream.write_reasons(read_log(spark, f"{folder}/in", schema, 1), f"{folder}/reasons", f"{folder}/cp2"))
    flags = replay_stream.verified_flags(spark.read.parquet(f"{folder}/checked"), replay_stream.read_reasons(spark, f"{folder}/reasons"))
    want = provenance.record_flags(
        provenance.with_replays(provenance.check_records(log), replay.replayed_arrivals(replay.replay_reasons(log))))
    assert {tuple(r) for r in flags.collect()} == {tuple(r) for r in want.collect()}
