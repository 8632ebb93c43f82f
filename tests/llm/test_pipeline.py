"""The pipeline against the stages' own results, put together in plain Python, and registered queries against SQL."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from screenwright.llm import decontamination, mixing, pii, quality, simhash
from screenwright.llm.common import tables
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = tables(spark, SF, "documents")
    bench = tables(spark, SF, "benchmark")
    kept = {r["doc_id"] for r in quality.digest(docs).where("kept").collect()}
    docs = docs.where(F.col("doc_id").isin(*kept))
    leads = {r["component_id"] for r in simhash.digest(docs).collect()}
    docs = docs.where(F.col("doc_id").isin(*leads))
    clean = {r["doc_id"] for r in decontamination.digest(docs, bench).where("NOT contaminated").collect()}
    assert clean < leads < kept
    docs = pii.redact(docs.where(F.col("doc_id").isin(*clean)))
    taken = {r["doc_id"]: r["taken"] for r in mixing.digest(docs).collect()}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"]
    words = Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.collect():
        assert r["text"] == texts[r["doc_id"]]
        words[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in taken.items() if v} == dict(words)


@pytest.mark.parametrize("name", ["op1_decontamination", "op5_repeated_passages", "op9_mixing"])
def test_sql(spark, name):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert compare(spark, connect(SF), SF, name, queries[name], sql[name]).startswith("ok 200")
