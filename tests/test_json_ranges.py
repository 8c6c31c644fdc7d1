"""Large JSON documents read by byte ranges give what the JSON reader gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assaykit.sources import coco
from assaykit.sources.json_ranges import _pieces, array_objects

AWKWARD = ['a } b', '{ [ "x" ] }', 'end \\\\', '\\" }', ', {', '": [ {', 'é }} ü', '', '\n}\n', '"images": [{"id": 9}]']


@pytest.fixture
def small_ranges(spark):
    """Ranges of 4 kB, so that small files are cut too."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "4096")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _document(seed, images, boxes):
    rnd = random.Random(seed)
    nested = lambda d: {"k": rnd.choice(AWKWARD), "in": [nested(d - 1)] if d else []}
    return {
        "note": '"annotations": [ { } ] {', "info": {"a": {"b": {"c": 1}, "list": [{"x": [1, 2]}, {"y": "}"}]}, "v": "1"},
        "images": [{"id": i, "file_name": rnd.choice(AWKWARD) + str(i), "extra": nested(i % 4), "width": 5, "source": None} for i in range(images)],
        "empty": [], "numbers": [1, [2, {"z": 1}], 3],
        "extra": {"p": {"q": {"r": [{"id": 1}, {"id": 2}]}}, "s": [{"id": 3}]},
        "annotations": [{"id": i, "image_id": rnd.randrange(images), "category_id": i % 3, "bbox": [1, 2.5, 3, 4], "segmentation": [[1, 2], [3]]} for i in range(boxes)],
        "categories": [{"id": i, "name": n} for i, n in enumerate(("cat", "d}g"))],
    }


def test_objects_of_awkward_documents(spark, folder, small_ranges):
    want = set()
    for n, (indent, tail) in enumerate([(None, ""), (None, "\n"), (2, " \n\n"), (0, "")]):
        made = _document(n, 60, 400)
        with open(f"{folder}/f{n}.json", "w") as f:
            f.write(json.dumps(made, indent=indent, ensure_ascii=n % 2 == 0) + tail)
        for name in ("images", "annotations", "categories"):
            want |= {(f"f{n}.json", name, i, json.dumps(o, sort_keys=True)) for i, o in enumerate(made[name])}
    with open(f"{folder}/cut.json", "w") as f:
        f.write(json.dumps(_document(7, 60, 400))[:-1])
    for name, text in (("none.json", ""), ("list.json", '[{"a": [{"b": 1}]}]'), ("bare.json", '{"images": []}')):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    pieces = _pieces(spark, folder, "f0.json")
    assert pieces.rdd.getNumPartitions() > 4
    rows = array_objects(spark, folder).collect()
    got = [(r["json_path"].rsplit("/", 1)[1], r["array_name"], r["ordinal"], json.dumps(json.loads(r["object"]), sort_keys=True)) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want


def test_coco_by_ranges_equals_the_json_reader(spark, folder, small_ranges):
    for n in range(2):
        with open(f"{folder}/c{n}.json", "w") as f:
            json.dump(_document(n + 20, 50, 300), f)
    samples, named = coco.read(spark, folder, ranges=True)
    plain_samples, plain_named = coco.read(spark, folder)

    def rows(df):
        return sorted(df.select(F.to_json(F.struct(*sorted(df.columns)))).collect())

    assert rows(samples) == rows(plain_samples) and len(rows(samples)) == 100
    assert rows(named) == rows(plain_named) and len(rows(named)) == 600


def test_no_documents(spark, folder, small_ranges):
    with open(f"{folder}/x.json", "w") as f:
        f.write("{}")
    assert array_objects(spark, folder).count() == 0
