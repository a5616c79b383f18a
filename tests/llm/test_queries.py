"""The registered queries: the pipeline, and queries with SQL are covered by the test of all oracles."""

import corpus_pipeline
from cohortry.llm.catalog import CATALOG
from cohortry.llm.tables import fresh, stage
from tests.conftest import SMALL
from tests.llm.test_texts import check_packing

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, before, SMALL), name)
        assert set(now.columns) == COLUMNS
        assert {r.doc_id for r in now.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = now
    assert 0 < before.count() < n
    out = stage(corpus_pipeline.STAGES[-1][1](spark, before, SMALL), "packed").collect()
    check_packing(out, 4096)
    assert {r.doc_id for r in out} == {r.doc_id for r in before.collect()}


def test_stages_without_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, SMALL), name)
        assert out.count() == 0
        docs = docs if name == "packing" else out


def test_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in CATALOG if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in CATALOG


def test_fresh_names(spark):
    table = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert fresh(table, "a") == "a__" and fresh(table, "b") == "b"
