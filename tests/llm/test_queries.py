"""Registered queries and the pipeline on the smallest given tables."""

import os

import pytest

import corpus_pipeline
from netweir.llm import queries
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) and compare(got, duck(SF).execute(queries.ORACLES[name]).df()) == ""


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, rows = docs.schema, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        assert out.schema.names == schema.names and 0 < out.count() <= rows, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs, rows = out, out.count()
    name, stage = corpus_pipeline.STAGES[-1]
    last = stage(spark, docs, SF)
    assert last.count() == rows
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted(map(tuple, last.select("doc_id", "copies").collect()))


def test_pipeline_of_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words without an id that stand here", "en", "s", 5), (3, "a b c d e f g", "en", None, 1), (3, "a b c d e f g", "en", None, 1)],
        spark.read.parquet(f"{SF}/documents.parquet").schema,
    )
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), f"odd-{name}")
        # line dedup takes the second copy of id 3, which is left without a word
        assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == ([(False, 1), (False, 2), (False, 3), (True, None)] if rows is odd else [])
