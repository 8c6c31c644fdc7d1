"""The stages one after another, each against what it has to leave."""

import pytest

import corpus_pipeline
from assaykit.llm import simhash
from assaykit.session import checkpointed


@pytest.fixture(scope="module")
def tables(spark, edge_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    edge_docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(n, int(n not in (5, 9)), 0) for n in (4, 5, 6, 7, 8, 9, 10, *range(20, 32), *range(50, 60))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_keep_columns_and_do_their_work(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = checkpointed(stage(spark, docs, tables))
        assert docs.columns == columns, name
        if name == "line_dedup":
            assert docs.count() == before.count()
            assert not any("stands in many" in (r["text"] or "").lower() for r in docs.collect())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
        if name == "near_duplicates":
            prints = [simhash.fingerprint(r["text"]) for r in docs.collect()]
            assert all((a ^ b).bit_count() > 4 for k, a in enumerate(prints) for b in prints[:k])
            assert docs.count() < before.count()
        if name == "source_mix":
            ids = {r["doc_id"] for r in before.collect()}
            assert {r["doc_id"] for r in docs.collect()} <= ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()


def test_run_and_empty_tables(spark, tables, no_docs, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
