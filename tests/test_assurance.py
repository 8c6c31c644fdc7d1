"""Whole analyses on a generated attack table: clean images, copies, flips, outliers, patches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import drift, generators, models
from assaykit.plans import assure
from assaykit.sources import files, images, tables

CLASSES = {"vehicle": (200, 60, 60), "person": (60, 200, 60), "drone": (60, 60, 200)}


def _scene(rng, label, index):
    image = np.full((128, 128, 3), 30, dtype=np.float64) + rng.normal(0, 3, (128, 128, 3))
    # the class colour fills the middle; a bar whose place is the sample's own sets the hashes apart
    image[32:96, 32:96] = np.array(CLASSES[label]) + rng.normal(0, 4, (64, 64, 3))
    # each sample has its own texture there, so centre patches do not repeat
    image[32:96, 32:96] += np.kron(rng.normal(0, 50, (16, 16)), np.ones((4, 4)))[:, :, None]
    x, y = rng.integers(4, 100, size=2)
    image[y : y + 24, x : x + 12] += 60
    wave = np.sin(np.arange(128)[:, None] * rng.uniform(0.05, 0.5) + np.arange(128)[None, :] * rng.uniform(0.05, 0.5))
    return image + 18 * wave[:, :, None]


@pytest.fixture(scope="module")
def attack(tmp_path_factory, png):
    rng = np.random.default_rng(11)
    folder, names = str(tmp_path_factory.mktemp("attack")), list(CLASSES)
    rows, truth = [], []

    def add(kind, label, image, source, contributor):
        i = len(rows)
        name = f"sample_{i:04d}"
        png(f"{folder}/{name}.png", np.clip(image, 0, 255).astype(np.uint8))
        rows.append((i, name, f"file:{folder}/{name}.png", source, "batch_1", contributor, [label]))
        truth.append((kind, name))

    for i in range(30):
        label = names[i % 3]
        add("clean_samples", label, _scene(rng, label, i), "feed_clean", "alice")
    for i in range(5):
        shown = names[i % 3]
        add("label_flip_samples", names[(i + 1) % 3], _scene(rng, shown, i), "feed_rogue", "mallory")
    copied = _scene(rng, "vehicle", 0)
    for _ in range(5):
        add("duplicate_flooding_samples", "vehicle", copied + rng.normal(0, 0.5, copied.shape), "feed_flood", "bob")
    for _ in range(4):
        add("ood_samples", "person", rng.uniform(0, 255, (128, 128, 3)), "feed_rogue", "mallory")
    for _ in range(5):
        image = _scene(rng, "drone", 0)
        image[112:128, 112:128] = np.where((np.indices((16, 16)).sum(0) // 2 % 2)[:, :, None] > 0, 255, 0)
        add("trigger_samples", "drone", image, "feed_rogue", "mallory")
    return folder, rows, truth


def test_attack_table(spark, attack):
    folder, rows, truth = attack
    samples = spark.createDataFrame(
        rows, "ordinal BIGINT, sample_id STRING, image_path STRING, source_id STRING, batch_id STRING, contributor STRING, labels ARRAY<STRING>")
    features = images.image_features(images.read_images(spark, folder)).cache()
    analysis = assure.analyse_dataset("DS", samples, features, similarity=0.95, min_cluster=3, ood_share=0.92)
    metrics, macro = assure.benchmark(
        spark.createDataFrame(truth, "scenario STRING, sample_id STRING"), analysis,
        {"label_flip_samples": "label", "duplicate_flooding_samples": "duplicate", "ood_samples": "ood", "trigger_samples": "trigger"})
    by = {r["scenario"]: r for r in metrics.collect()}
    assert by["duplicate_flooding_samples"]["recall"] == 1.0 and by["duplicate_flooding_samples"]["fp"] == 0
    assert by["trigger_samples"]["recall"] == 1.0 and by["trigger_samples"]["fp"] == 0
    assert by["label_flip_samples"]["recall"] == 1.0
    assert by["ood_samples"]["recall"] >= 0.5
    assert macro.first()["total_scenarios"] == 4
    risk = {r["source_id"]: r for r in analysis.source_risk.collect()}
    assert risk["feed_rogue"]["risk_level"] == "CRITICAL" and risk["feed_flood"]["risk_level"] in ("HIGH", "CRITICAL")
    found = {r["category"]: r for r in analysis.findings.collect()}
    assert {"NEAR_DUPLICATE", "LABEL_FLIP", "OOD", "TRIGGER", "SOURCE_POISONING"} == set(found)
    assert found["NEAR_DUPLICATE"]["finding_id"] == "F-DS-001" and found["TRIGGER"]["recommendation"] == "QUARANTINE"
    overall = analysis.asset_risk.first()
    assert overall["disposition"] in ("QUARANTINE", "REVIEW") and overall["asset_id"] == "DS"
    marked = {r["sample_id"]: r["anomaly_reasons"] for r in analysis.samples.where("is_suspicious").collect()}
    copies = [s for k, s in truth if k == "duplicate_flooding_samples"]
    assert all("Near duplicate cluster" in marked[s] for s in copies)
    listed = analysis.finding_samples.where("finding_id = 'F-DS-001'").collect()
    assert sorted(r["sample_id"] for r in listed) == sorted(copies) and len(listed) == found["NEAR_DUPLICATE"]["affected"]


def test_dark_shift(spark, folder, png):
    for name, value in (("ref", 150), ("cand", 40)):
        for i in range(10):
            png(f"{folder}/{name}/{i}.png", np.full((64, 64, 3), value, dtype=np.uint8))
    frames = [images.image_features(images.read_images(spark, f"{folder}/{s}")) for s in ("ref", "cand")]
    from assaykit.functions.pixels import METRICS

    metrics, shift = drift.drift_report(*frames, list(METRICS))
    rows = {r["feature"]: r for r in metrics.collect()}
    assert rows["brightness"]["psi"] == 0.0 and rows["brightness"]["ks_statistic"] == 1.0
    verdict = shift.first()
    assert verdict["overall_shift_detected"] and verdict["classification"] != "NORMAL"
    finding = generators.shift_findings(shift.withColumn("asset_id", F.lit("DS")), len(METRICS)).first()
    assert finding["category"] == "DISTRIBUTION_SHIFT"


def test_report_sinks(spark, folder, attack):
    summary = spark.createDataFrame(
        [("m1", "SUBSTITUTION_DETECTED", "CRITICAL", 0.95, "QUARANTINE", 0.5, 12, 24, True), ("m2", "MATCH", "LOW", 1.0, "ACCEPT", 1.0, 0, 24, False)],
        "model_id STRING, status STRING, severity STRING, confidence DOUBLE, recommendation STRING, behavioural_agreement_rate DOUBLE, "
        "anomalous_inputs_count BIGINT, total_battery_tests BIGINT, high_vulnerability_detected BOOLEAN")
    found = generators.model_findings(summary)
    assert [(r["finding_id"], r["category"]) for r in found.orderBy("finding_id").collect()] == [
        ("F-m1-001", "MODEL_SUBSTITUTION"), ("F-m1-002", "BACKDOOR_BEHAVIOUR"), ("F-m1-003", "TRIGGER")]
    from assaykit.operators import findings as fnd
    from assaykit.operators import report

    counts = spark.createDataFrame([(5, 1, 1, 3)], "total BIGINT, tampered BIGINT, replayed BIGINT, valid BIGINT")
    bare = report.report_header(found, fnd.asset_risk(found), counts).first()
    assert (bare["dataset_status"], bare["model_status"]) == ("NO_DATASET_SELECTED", "NO_MODEL_SELECTED")
    assert tuple(bare["distribution"]) == (0, "NORMAL") and bare["assessment_verdict"] == bare["overall"]["disposition"]
    header = report.report_header(found, fnd.asset_risk(found), counts, model=spark.createDataFrame([("m1", 7)], "model_id STRING, parameter_count BIGINT"))
    assert tuple(header.first()["model"]) == ("m1", 7) and header.first()["model_status"] == "SELECTED"
    tables.write_report(header, found, f"{folder}/r")
    read = spark.read.json(f"{folder}/r/report").first()
    assert read["executive_summary"]["model_integrity"] == "SUBSTITUTION_DETECTED" and read["inference_assurance"]["total"] == 5
    assert spark.read.json(f"{folder}/r/findings").count() == 3
    tables.write_findings_csv(found, f"{folder}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    assert back.count() == 3 and len(back.columns) == 14


def test_perturbed_images(spark):
    flat = [0.5] * (32 * 32 * 3)
    df = spark.createDataFrame([(1, flat)], "id BIGINT, px ARRAY<DOUBLE>")
    rows = {r["perturbation"]: np.array(r["px"]).reshape(32, 32, 3) for r in models.perturbed_images(df, "px", (32, 32, 3)).collect()}
    assert np.allclose(rows["BLUR"], 0.5)
    assert rows["PATCH_TL"][1, 0, 0] == 1.0 and rows["PATCH_TL"][0, 0, 0] == 0.0 and rows["PATCH_TL"][20, 20, 0] == 0.5
    assert rows["PATCH_BR"][31, 31, 0] == 1.0 and rows["PATCH_BR"][0, 0, 0] == 0.5
    noisy = models.perturbed(spark.createDataFrame([(1, [0.5] * 2000)], "id BIGINT, px ARRAY<DOUBLE>"), "id", "px").where("perturbation = 'NOISE_GAUSSIAN'")
    values = np.array(noisy.first()["px"])
    assert abs(values.mean() - 0.5) < 0.01 and abs(values.std() - 0.1) < 0.01


def test_predictions_without_logits(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0]), (2, []), (3, None)], "item_id BIGINT, logits ARRAY<DOUBLE>")
    rows = {r["item_id"]: (r["predicted"], round(r["confidence"], 4)) for r in models.predicted(df).collect()}
    assert rows == {1: (1, 0.8808), 2: (0, 0.5), 3: (-1, 0.0)}
    same = models.agreement(models.prediction_pairs(df, df)).first()
    assert same["behavioural_agreement_rate"] == 1.0
