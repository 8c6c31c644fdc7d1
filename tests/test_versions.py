"""Replacements are whole or absent, whatever step a writer dies at."""

import pytest
from pyspark.sql import functions as F

from assaykit.sources import versions
from assaykit.streaming.sources import read_log


def _rows(spark, cells):
    return spark.createDataFrame(cells, "asset STRING, n BIGINT")


def _read(spark, path):
    return sorted((tuple(r) for r in versions.current(spark, path, "asset").collect()), key=str)


def test_keys_are_replaced_deleted_and_compacted(spark, folder):
    path = f"{folder}/t"
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path, "asset")
    versions.replace(_rows(spark, [("a", 1), ("a", 1), ("b", 2), (None, 3)]), path, "asset")
    assert _read(spark, path) == sorted([("a", 1), ("a", 1), ("b", 2), (None, 3)], key=str)
    versions.replace(_rows(spark, [("a", 5), (None, 6)]), path, "asset")
    assert _read(spark, path) == sorted([("a", 5), ("b", 2), (None, 6)], key=str)
    versions.replace(_rows(spark, []), path, "asset", keys=_rows(spark, [("b", 0)]).select("asset"))
    assert _read(spark, path) == sorted([("a", 5), (None, 6)], key=str)
    before = _read(spark, path)
    assert versions.compact(spark, path, "asset") == 3 and versions.versions(spark, path) == [3]
    assert _read(spark, path) == before
    wider = _rows(spark, [("c", 7)]).withColumn("note", F.lit("new"))
    versions.replace(wider, path, "asset")
    assert _read(spark, path) == sorted([("a", 5, None), (None, 6, None), ("c", 7, "new")], key=str)


@pytest.mark.parametrize("step", ["start", "rows", "mark"])
@pytest.mark.parametrize("compacting", [False, True])
def test_a_writer_that_dies_changes_nothing(spark, folder, monkeypatch, step, compacting):
    path = f"{folder}/t"
    versions.replace(_rows(spark, [("a", 1), ("b", 2)]), path, "asset")
    versions.replace(_rows(spark, [("a", 3)]), path, "asset")
    before = _read(spark, path)

    def dying(*_):
        raise RuntimeError("lost")

    def without_keys(rows, key, path, kind, version, keys=None):
        rows.write.mode("overwrite").parquet(f"{path}/rows/_version={version}")
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        if step == "mark":
            patch.setattr(versions, "_mark", dying)
        else:
            patch.setattr(versions, "_write", dying if step == "start" else without_keys)
        with pytest.raises(RuntimeError):
            if compacting:
                versions.compact(spark, path, "asset")
            else:
                versions.replace(_rows(spark, [("a", 9), ("b", 9)]), path, "asset")
    assert _read(spark, path) == before
    versions.replace(_rows(spark, [("b", 4)]), path, "asset")
    assert _read(spark, path) == [("a", 3), ("b", 4)]


def test_a_repeated_batch_changes_nothing(spark, folder):
    path, source = f"{folder}/t", f"{folder}/in"
    for cells in ([("a", 1), ("b", 1)], [("b", 2)], [("c", 3)]):
        _rows(spark, cells).coalesce(1).write.mode("append").parquet(source)
    for checkpoint in ("cp", "lost"):
        # the second run has lost its checkpoint and gives the same batches again
        query = versions.replace_from(read_log(spark, source, "asset STRING, n BIGINT", 1), path, "asset", f"{folder}/{checkpoint}")
        query.awaitTermination(120)
        assert query.exception() is None
        assert _read(spark, path) == [("a", 1), ("b", 2), ("c", 3)]
        assert versions.versions(spark, path) == [0, 1, 2]
