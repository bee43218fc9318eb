"""Pipeline stages over rows that repeat an id or have none."""

import os
import random

import pytest

import corpus_pipeline

from .helpers import prose

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


def documents(spark, rows):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    return spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], schema)


def texts(df):
    assert corpus_pipeline.ROW not in df.columns
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_near_dedup_keeps_one_row_of_a_group(spark):
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = a.replace(a.split()[30], "zz", 1)
    out = corpus_pipeline.dedup_near(spark, documents(spark, [(None, a), (7, a), (7, a), (3, b), (3, near), (3, b), (None, c), (None, c), (5, d)]), SF)
    # a's group is led by id 3 (near); b with the same id is no copy of it
    assert texts(out) == sorted([(3, b), (3, near), (5, d)]) + [(None, c)]


def test_decontamination_judges_rows(spark):
    rng = random.Random(22)
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text), key=len)
    clean = [prose(rng, 60) for _ in range(3)]
    out = corpus_pipeline.decontaminate_benchmark(spark, documents(spark, [(1, clean[0]), (1, item), (None, item), (None, clean[1]), (2, clean[2])]), SF)
    assert texts(out) == [(1, clean[0]), (2, clean[2]), (None, clean[1])]


def test_line_dedup_judges_rows(spark):
    rng = random.Random(23)
    a, b, c, d = (prose(rng, 8) for _ in range(4))
    out = corpus_pipeline.dedup_lines(spark, documents(spark, [(4, f"{a}\n{b}"), (4, f"{c}\n{a}"), (None, f"{d}\n{b}"), (None, d)]), SF)
    kept = [x for _, text in texts(out) for x in text.split("\n")]
    assert sorted(kept) == sorted([a, b, c, d])
    assert sorted(r.doc_id or -1 for r in out.collect())[0] == -1


def test_table_loaded_twice_leaves_each_document_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs)
    once = corpus_pipeline.dedup_near(spark, docs, SF)
    assert texts(corpus_pipeline.dedup_near(spark, twice, SF)) == texts(once)
