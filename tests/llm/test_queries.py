"""Registered queries on the small tables: DuckDB twins, shapes, plans, and the pipeline's stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate
from quire.llm.catalog import QUERIES
from quire.llm.oracle import ORACLE
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_check import compare, duck

ROWS = {"op3_ngram_trie": "documents", "op5_toxicity": "documents", "op7_simhash": "documents", "op9_quality": "documents", "op1_sharding": "documents"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins(spark, name):
    assert compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), ORACLE[name])["ok"]


@pytest.mark.parametrize("name", sorted(ROWS))
def test_one_row_per_document(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/{ROWS[name]}.parquet")
    assert df.groupBy("doc_id").count().where("count <> 1").count() == 0 and df.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    assert df.count() == docs.count()


@pytest.mark.parametrize("name", ["op1_sharding", "op8_line_dedup"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_leaks_are_the_verbatim_ones(spark):
    """At sf0.01 the planted passages are verbatim: nothing else is found, none is missed."""
    docs, bench = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, q in items if q in norm(r.text)}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, SF_CHECK).collect()} == want


def test_toxic_documents_of_known_words_are_rejected(spark):
    got = {r.doc_id: r.toxic for r in QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert sum(got[r.doc_id] == bool(r.toxic) for r in labels) / len(labels) > 0.98


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    cols, have = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SF_SMALL), "t")
        if name in ("toxicity", "simhash_near_dedup", "benchmark_decontamination"):
            assert out.columns == cols and out.count() <= have and out.exceptAll(docs).count() == 0
        elif name == "mixing":
            assert out.columns == cols and out.distinct().exceptAll(docs.distinct()).count() == 0
        else:
            assert out.count() == have and out.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
        docs, have = out, out.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
