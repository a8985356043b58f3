"""The pipeline's stages, and the package's registration."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logtide.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def test_registered():
    assert "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_follow_their_input(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        kept[name] = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    gone = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} - set(kept["toxicity"])
    assert gone and all(labels.get(i, 1) == 1 for i in gone)  # no document labelled clean goes; many have no label
    assert max(kept["near_dedup"].values()) == 1 and max(kept["mixing"].values()) <= 2
    assert kept["sentencepiece"] == kept["mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.round_trip and r.decoded == texts[r.doc_id] for r in docs.collect())


def test_stages_take_odd_rows_and_none(spark, odd, folder):
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for i, docs in enumerate((spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/documents.parquet").filter("false"))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, folder).write.parquet(f"{folder}/{i}/{name}")
            docs = spark.read.parquet(f"{folder}/{i}/{name}")
        assert (docs.count() == 0) == (i == 1)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_hard_negatives"}))
def test_query_returns_a_row_for_each_document(spark, name):
    rows = entry.queries()[name](spark, SF)
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_dedup_is_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    classes = simhash.near_duplicates(docs, corpus_pipeline.SHINGLE, corpus_pipeline.DISTANCE).collect()
    assert kept == {r.component_id for r in classes}
