"""Exact copies of lines of any number of words."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from netweir.llm import linedup

from .helpers import frame
from .test_lines_near import line_rows, within_one, words

SF = "/root/testdata/sf0.001"


def test_lines_of_any_length_equal_brute_force(spark):
    rng = random.Random(41)
    rows = [(i, x + "\n" + "\n".join(rng.choice(("read more", "Read  More", "menu", "a b c d", "a b c e", "", " \t")) for _ in range(3)), *r) if x else (i, x, *r) for i, x, *r in line_rows()]
    docs = {i: x for i, x, *_ in rows if i is not None and x is not None and Counter(r[0] for r in rows)[i] == 1}
    rows = [r for r in rows if r[0] in docs]
    full = [((i, j), words(x)) for i in sorted(docs) for j, x in enumerate(docs[i].split("\n"))]
    full = [(p, w) for p, w in full if w]
    gone, seen, long = set(), set(), []
    for p, w in full:
        if tuple(w) in seen or len(w) >= 5 and any(within_one(w, v) for v in long):
            gone.add(p)
        seen.add(tuple(w))
        if len(w) >= 5:
            long.append(w)
    assert sum(len(w) < 5 for p, w in full if p in gone) > 100
    got = {r.doc_id: r.text for r in linedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: "\n".join(x for j, x in enumerate(docs[i].split("\n")) if (i, j) not in gone) for i in docs}


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
def test_pipeline_drops_short_copies(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(1, "Read more\nfirst text", "en", "s", 20), (2, "second text\nread  more", "en", "s", 22), (3, "Read more", "en", "s", 9)], schema)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()) == [(1, "Read more\nfirst text", 20), (2, "second text", 11)]


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    rows = [(1, "one two three four five six\nunique line of the first row", "s", 1), (1, "x", "s", 1), (2, "unique line that stands alone\none two three four five six", "s", 1), (2, "another line altogether\nx", "s", 1), (None, "x", None, None)]
    got = linedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id) == [(1, "one two three four five six\nunique line of the first row"), (1, "x"), (2, "another line altogether"), (2, "unique line that stands alone")]
    assert [(r.text, r.n_removed) for r in got if r.doc_id is None] == [("x", 0)]


def test_regular_lines_that_differ_both_stay(spark):
    """512 words in Thue-Morse order and its complement."""
    turn = [bin(i).count("1") % 2 for i in range(512)]
    a, b = (" ".join(("foo", "bar")[x ^ flip] for x in turn) for flip in (0, 1))
    got = linedup.dedup_lines(frame(spark, [(1, a, "s", 1), (2, b, "s", 1), (3, a, "s", 1)])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 1}
