"""Readers on files written by the tests."""

import io
import json
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import pixels
from assaykit.operators import validation
from assaykit.sources import coco, files, images, tables, yolo


def _flat(value, size=64):
    return np.full((size, size, 3), value, dtype=np.uint8)


@pytest.fixture
def coco_folder(folder, png):
    root = f"{folder}/ds"
    entries = []
    for i in range(10):
        name = f"img_{i}.png"
        png(f"{root}/images/{name}" if i % 2 else f"{root}/{name}", _flat(20 + 20 * i))
        entries.append({"id": i, "file_name": name, "width": 64, "height": 64, "source": "src_a" if i < 5 else "src_b"})
    entries.append({"id": 99, "file_name": "gone.png", "width": 1, "height": 1})
    boxes = [{"id": i, "image_id": i, "category_id": i % 2, "bbox": [5.0, 5.0, 20.0, 20.0], "area": 400.0} for i in range(10)]
    boxes.append({"id": 50, "image_id": 0, "category_id": 7, "bbox": [0.0, 0.0, 0.0, 4.0], "area": 0.0})
    document = {"images": entries, "annotations": boxes, "categories": [{"id": 0, "name": "cat"}, {"id": 1, "name": "dog"}]}
    with open(f"{root}/annotations.json", "w") as f:
        json.dump(document, f)
    with open(f"{root}/other.json", "w") as f:
        json.dump({"unrelated": 1}, f)
    return root


def test_coco_read_and_validate(spark, coco_folder):
    samples, boxes = coco.read(spark, coco_folder)
    listed = yolo.in_root(files.listing(spark, coco_folder, "*.png").select("path"), samples.select("dataset_id"))
    resolved = coco.resolve_paths(samples, listed)
    rows = {r["sample_id"]: r for r in resolved.collect()}
    assert len(rows) == 10 and "gone" not in rows
    assert rows["img_0"]["labels"] == ["cat", "unknown"] and rows["img_1"]["labels"] == ["dog"]
    assert rows["img_1"]["image_path"].endswith("/images/img_1.png") and rows["img_7"]["source_id"] == "src_b"
    sized = boxes.join(samples.select("image_id", "sample_id", "width", "height"), "image_id")
    issues = validation.box_issues(sized).collect()
    assert [(r["sample_id"], r["issue_type"], r["severity"]) for r in issues] == [("img_0", "INVALID_BBOX_SIZE", "MEDIUM")]
    assert issues[0]["details"].startswith("Non-positive bbox dimensions: [0.0, 0.0, 0.0, 4.0")


def test_coco_files_of_one_folder_keep_their_own_ids(spark, folder):
    for part, name in (("train", "cat"), ("val", "dog")):
        document = {
            "images": [{"id": 1, "file_name": f"{part}.png", "width": 4, "height": 4}],
            "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [0.0, 0.0, 1.0, 1.0], "area": 1.0}],
            "categories": [{"id": 3, "name": name}],
        }
        with open(f"{folder}/instances_{part}.json", "w") as f:
            json.dump(document, f)
    samples, boxes = coco.read(spark, folder)
    assert {(r["sample_id"], tuple(r["labels"]), r["annotation_count"]) for r in samples.collect()} == {("train", ("cat",), 1), ("val", ("dog",), 1)}
    assert boxes.count() == 2


def test_file_checks(spark, folder, png):
    png(f"{folder}/ok.png", _flat(9, 32))
    with open(f"{folder}/bad.png", "wb") as f:
        f.write(b"not an image")
    decoded = images.image_sizes(images.read_images(spark, folder))
    path = {os.path.basename(r["image_path"]): r["image_path"] for r in decoded.collect()}
    samples = spark.createDataFrame(
        [("ok", path["ok.png"], 1, 1), ("bad", path["bad.png"], 1, 1), ("lost", "file:///nowhere.png", 1, 1)],
        "sample_id STRING, image_path STRING, width INT, height INT")
    checked = validation.check_files(samples, decoded)
    assert {r["sample_id"]: r["issue_type"] for r in validation.file_issues(checked).collect()} == {
        "bad": "CORRUPTED_IMAGE", "lost": "MISSING_IMAGE_FILE"}
    valid = validation.valid_samples(checked).collect()
    assert [(r["sample_id"], r["width"], r["height"]) for r in valid] == [("ok", 32, 32)]


def test_yolo_read(spark, folder, png):
    root = f"{folder}/y"
    png(f"{root}/source_cam1/Batch_7/images/a.png", _flat(50, 100))
    png(f"{root}/b.png", _flat(60, 100))
    png(f"{root}/c.png", _flat(70, 100))
    os.makedirs(f"{root}/source_cam1/Batch_7/labels")
    with open(f"{root}/source_cam1/Batch_7/labels/a.txt", "w") as f:
        f.write("1 0.5 0.5 0.7 0.7\n\n0 0.5 0.5\n9 0.1 0.1 0.2 0.2\n-1 0.1 0.1 0.2 0.2\n")
    with open(f"{root}/b.txt", "w") as f:
        f.write("0 0.5 0.5 1 1\n")
    with open(f"{root}/data.yaml", "w") as f:
        f.write("train: x\nnames:\n  0: 'car'\n  1: person\nnc: 2\n")
    roots = spark.createDataFrame([(f"file:{root}",)], "dataset_id STRING")
    index = images.image_index(spark, root, roots).cache()
    dataset = index.first()["dataset_id"]
    samples, boxes = yolo.read(spark, root, index)
    rows = {r["sample_id"]: r for r in samples.collect()}
    assert rows["a"]["labels"] == ["class_-1", "class_9", "person"], rows
    assert rows["b"]["labels"] == ["car"] and rows["c"]["labels"] == []
    assert rows["a"]["source_id"] == "source_cam1" and rows["a"]["batch_id"] == "Batch_7"
    assert rows["b"]["source_id"] == "default_source" and rows["b"]["batch_id"] == "batch_0"
    box = boxes.where("class_name = 'person'").first()
    assert box["bbox"] == [15.0, 15.0, 70.0, 70.0] and box["dataset_id"] == dataset


@pytest.mark.parametrize("text,want", [
    ("names: [a, 'b', \"c\"]\n", ["a", "b", "c"]),
    ("nc: 2\nnames:\n- x\n- 'y'\n", ["x", "y"]),
    ("names:\n  0: p\n  1: q\n", ["p", "q"]),
])
def test_yaml_names(spark, text, want):
    rows = yolo.names_from_yaml(spark.createDataFrame([("p", text)], "path STRING, text STRING"))
    assert [r["class_name"] for r in rows.orderBy("class_id").collect()] == want


def test_detect_formats(spark, folder):
    def put(path, text=""):
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "w") as f:
            f.write(text)

    put("one/a.json", '{"images": [], "annotations": []}')
    put("two/data.yaml", "names: [a]")
    put("three/images/a.png", "x")
    put("three/labels/a.txt", "x")
    put("four/a.png", "x")
    put("five/a.json", "x" * 600 + '{"images": [], "annotations": []}')
    got = {r["dataset"]: r["format"] for r in files.detect_formats(spark, folder).collect()}
    assert got == {"one": "COCO", "two": "YOLO", "three": "YOLO", "four": "GENERIC_IMAGES", "five": "GENERIC_IMAGES"}


def test_archives(spark, folder):
    with zipfile.ZipFile(f"{folder}/good.zip", "w") as z:
        z.writestr("a/b.txt", "hello")
    with zipfile.ZipFile(f"{folder}/evil.zip", "w") as z:
        z.writestr("a/../../b.txt", "x")
        z.writestr("fine.txt", "y")
    with tarfile.open(f"{folder}/t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in/c.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    with open(f"{folder}/good.zip", "rb") as f:
        whole = f.read()
    with open(f"{folder}/cut.zip", "wb") as f:
        f.write(whole[: len(whole) // 2])
    with open(f"{folder}/cut.tar.gz", "wb") as f:
        f.write(b"\x1f\x8b" + whole)
    members = files.archive_members(spark, folder)
    broken = {os.path.basename(r["archive"]) for r in members.where("error IS NOT NULL").collect()}
    assert broken == {"cut.zip", "cut.tar.gz"}
    members = members.where("error IS NULL").unionByName(members.where("error IS NOT NULL").withColumn("content", F.lit(b"")))
    rows = {(os.path.basename(r["archive"]), r["member"]): (bytes(r["content"]), r["is_unsafe"]) for r in members.collect()}
    assert rows[("good.zip", "a/b.txt")] == (b"hello", False) and rows[("t.tar.gz", "in/c.txt")] == (b"tar", False)
    assert rows[("evil.zip", "a/../../b.txt")][1] is True
    assert {os.path.basename(r["archive"]) for r in files.safe_archives(members).collect()} == {"good.zip", "t.tar.gz"}


def test_file_digests_and_truth(spark, folder):
    import hashlib

    with open(f"{folder}/t.json", "w") as f:
        json.dump({"total_samples": 3, "clean_samples": ["a"], "flips": ["b", "c"]}, f)
    want = hashlib.sha256(open(f"{folder}/t.json", "rb").read()).hexdigest()
    assert files.file_digests(spark, folder).first()["sha256"] == want
    assert {tuple(r) for r in files.ground_truth(spark, f"{folder}/t.json").collect()} == {
        ("clean_samples", "a"), ("flips", "b"), ("flips", "c")}


def test_image_features(spark, folder, png):
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, size=(80, 60, 3), dtype=np.uint8)
    png(f"{folder}/noise.png", noise)
    png(f"{folder}/flat.png", _flat(150))
    with open(f"{folder}/broken.png", "wb") as f:
        f.write(b"nothing")
    rows = {os.path.basename(r["image_path"]): r for r in images.image_features(images.read_images(spark, folder)).collect()}
    flat = rows["flat.png"]
    assert flat["brightness"] == pytest.approx(150 / 255 * 0.9999, abs=1e-4) and flat["contrast"] == 0.0 and flat["saturation"] == 0.0
    assert flat["sharpness"] == 0.0 and flat["patches"] == [] and len(flat["vector"]) == 15
    broken = rows["broken.png"]
    assert not broken["readable"] and broken["vector"] == [0.0] * 15 and broken["phash"] is None and broken["sharpness"] == 100.0
    busy = rows["noise.png"]
    assert busy["phash"] == pixels.frequency_hash(noise) and busy["dhash"] == pixels.gradient_hash(noise)
    assert {p["region"] for p in busy["patches"]} == set(pixels.REGIONS)
    assert all(np.linalg.norm(p["vec"]) == pytest.approx(1, abs=1e-5) for p in busy["patches"])
    assert busy["r_mean"] == pytest.approx(noise[:, :, 0].mean() / 255, abs=0.02)


def test_resize_identity_and_constant():
    ramp = np.arange(64, dtype=np.uint8).reshape(8, 8, 1).repeat(3, axis=2)
    assert (pixels.resize(ramp, 8, 8) == ramp).all()
    for kernel in pixels.KERNELS:
        assert (pixels.resize(_flat(77, 50), 32, 9, kernel) == 77).all()
        assert np.allclose(pixels.resampling(50, 32, kernel).sum(axis=1), 1)


def test_replace_and_versions(spark, folder):
    path = f"{folder}/t"
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "dataset_id STRING, v INT")
    tables.replace_partitions(first, path, "dataset_id")
    tables.replace_partitions(spark.createDataFrame([("a", 9)], "dataset_id STRING, v INT"), path, "dataset_id")
    assert {(r["dataset_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 3)}
    log = f"{folder}/log"
    tables.append_rows(spark.createDataFrame([(1, "NEW", 1), (2, "NEW", 1)], "id INT, status STRING, version INT"), log)
    tables.append_rows(spark.createDataFrame([(1, "DONE", 2)], "id INT, status STRING, version INT"), log)
    assert {(r["id"], r["status"]) for r in tables.current_rows(spark, log, ["id"], "version").collect()} == {(1, "DONE"), (2, "NEW")}
