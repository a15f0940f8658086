"""Registered queries at the smallest scale beside their SQL, and the pipeline's stages."""

import re

import pytest
from oracle import compare, connect

import corpus_pipeline
from pageloom.llm import packing, secrets
from pageloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], SQL[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


def test_registration_beside_the_others():
    from __spark_entry__ import oracle_sql, queries

    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())


def test_held_out_language_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id AS d", "lang")
    found = QUERIES["op3_language"](spark, folder)
    rows = found.where("held_out").join(truth, found.doc_id == truth.d).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_held_out_quality_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id AS d", "quality")
    found = QUERIES["op10_quality"](spark, folder)
    rows = found.where("held_out").join(labels, found.doc_id == labels.d).collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.97 * len(rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, given, kept = docs.columns, docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).persist()
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == kept[-1]
        if name == "secrets":
            assert kept[-1] == kept[-2]
            assert secrets.scan(docs).where("exists(spans, s -> s.kind < 3)").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert docs.groupBy("doc_id").count().where("count > 3").count() == 0
            words = docs.collect()
    assert given > kept[0] > kept[1]
    encode = packing.encoder(packing.default_tokenizer())
    assert docs.agg({"length": "sum"}).head()[0] == sum(len(encode(r.text)) // 4 + 1 for r in words)
    sizes = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(s[1] <= packing.CAPACITY for s in sizes)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.exceptAll(docs).count() == docs.exceptAll(whole).count() == 0
