import random
import re

import pytest

from netweir.llm import linedup, nearest
from netweir.llm.components import components

from .helpers import SCHEMA, corpus, frame, prose


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def within_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def line_rows():
    rng = random.Random(5)
    base = [prose(rng, n).split() for n in (5, 6, 9, 14)]
    rows = corpus(11, 30)
    for i in range(40):
        lines = []
        for w in base:
            w = list(w)
            for _ in range(rng.choice((0, 1, 1, 2))):
                kind, p = rng.randrange(3), rng.randrange(len(w))
                w[p : p + (kind > 0)] = [] if kind == 2 else [rng.choice("xyz")]
            lines.append(" ".join(w))
        rows.append((5000 - i, "\n".join(lines) + "\n", "s", 1))
    return rows


def test_lines_equal_brute_force(spark):
    rows = [r for r in line_rows() if r[0] not in (3, 2000)]
    docs = {i: x for i, x, *_ in rows if i is not None and x is not None}
    places = sorted((i, j) for i, x in docs.items() for j, _ in enumerate(x.split("\n")))
    full = [(p, words(docs[p[0]].split("\n")[p[1]])) for p in places]
    full = [(p, w) for p, w in full if len(w) >= 5]
    gone = {p for k, (p, w) in enumerate(full) if any(within_one(w, v) for _, v in full[:k])}
    out = linedup.dedup_lines(frame(spark, rows), exact_words=5).collect()
    assert len(out) == len(rows) and len(gone) > 60
    for r in out:
        text = docs.get(r.doc_id)
        if text is None:
            continue
        parts = text.split("\n")
        assert r.text == "\n".join(x for j, x in enumerate(parts) if (r.doc_id, j) not in gone)
        assert (r.n_lines, r.n_removed) == (len(parts), sum(p[0] == r.doc_id for p in gone))


def test_drop_lines_keeps_columns_and_drops_emptied(spark):
    docs = frame(spark, [(1, "a b c d e f", "s", 1), (2, "a b c d e f", "t", 2), (3, "a b c d e x\nshort", "u", 3), (4, None, "v", 4), (5, "", "w", 5)])
    out = linedup.drop_lines(docs)
    assert out.schema.names == docs.schema.names
    assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == [(1, "a b c d e f", "s"), (3, "short", "u"), (4, None, "v"), (5, "", "w")]


def brute_near(rows, k, percent):
    sets = []
    for _, x, *_ in rows:
        w = words(x)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least[root(i)] if r[0] is not None else None) for i, r in enumerate(rows)]


@pytest.mark.parametrize("k,percent,block", [(3, 85, 256), (5, 80, 4)])
def test_near_equal_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rows = corpus(4, 150)
    got = nearest.near_duplicates(frame(spark, rows), shingle=k, percent=percent).collect()
    none = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(none((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(none, brute_near(rows, k, percent)))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert len({r.component_id for r in got}) < len(rows) - 40


def test_sketches_merge_and_estimate():
    import numpy as np

    from netweir.llm import textnp as t

    key = t.mix(np.arange(1, 3001, dtype=t.U64))
    one = nearest.registers(key, np.array([0, 3000]), 600)[0]
    parts = nearest.registers(key, np.array([0, 1700, 3000]), 600)
    assert (np.maximum(parts[0], parts[1]) == one).all()
    a, b = key[:2000], key[500:2500]
    sketch = nearest.registers(np.concatenate((a, b)), np.array([0, 2000, 4000]), 600)
    guess = nearest.likely(sketch[:1], sketch[1:], np.array([2000.0]), np.array([2000.0]))[0, 0]
    assert abs(guess - 1500 / 2500) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 3), (500, 501)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [], SCHEMA)
    assert linedup.dedup_lines(none).count() == 0 and linedup.drop_lines(none).count() == 0
    assert nearest.near_duplicates(none).count() == 0
