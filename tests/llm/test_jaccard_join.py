"""The n-gram join against plain sets, on odd texts, in one block and in many."""

import random

import numpy as np
import pytest

from netweir.llm import product

from .helpers import SCHEMA, corpus, frame, prose


def shingle_set(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain(rows, k, percent):
    sets = [shingle_set(r[1], k) for r in rows]
    use = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    near = {i: [] for i in use}
    for x, i in enumerate(use):
        for j in use[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((-1 if r[0] is None else r[0], len(sets[i]), -1 if r[0] is None else min(rows[j][0] for j in seen), len(near.get(i, ()))))
    return sorted(out)


def joined(spark, rows, **args):
    got = product.jaccard_join(frame(spark, rows, SCHEMA), **args)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def near_copies(n, edits, seed=5, words=150):
    rng = random.Random(seed)
    hub = prose(rng, words).split()
    rows = []
    for i in range(n):
        text = list(hub)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text), "s", 1))
    return rows


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80), (1, 70)])
def test_join_equals_plain(spark, shingle, percent):
    rows = corpus(seed=4, n=60) + [(5000 + r[0], *r[1:]) for r in near_copies(50, 6)]
    assert joined(spark, rows, shingle=shingle, percent=percent) == plain(rows, shingle, percent)


def test_join_over_many_blocks(spark, monkeypatch):
    """Blocks of four sets: every pair of blocks is multiplied once, and counts add up."""
    monkeypatch.setattr(product, "BLOCK", 4)
    monkeypatch.setattr(product, "GROUP", 8)
    rows = near_copies(70, 7)
    rows += [(100 + i, rows[i][1], "s", 1) for i in range(0, 30, 3)]
    assert joined(spark, rows, shingle=3, percent=85) == plain(rows, 3, 85)


@pytest.mark.parametrize("percent", [70, 85, 95])
def test_join_of_short_near_copies(spark, percent):
    """Small sets at low thresholds: all links are found over equal column blocks, empty ones included."""
    rows = near_copies(60, 9) + [(1000 + r[0], *r[1:]) for r in near_copies(40, 3, seed=8, words=14)] + corpus(seed=6, n=30)[:30]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert joined(spark, rows, shingle=2, percent=percent) == plain(rows, 2, percent)


def test_sets_that_link_are_equal_in_a_column_block():
    rng = np.random.default_rng(3)
    for percent in (70, 90, 97):
        for _ in range(150):
            n = int(rng.integers(1, 120))
            a = rng.integers(0, 1 << 60, n).astype(np.uint64)
            b = np.concatenate((a[: n - int(rng.integers(0, n // 8 + 1))], rng.integers(0, 1 << 60, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            row, size = np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)])
            keys, owner = product.column_blocks(np.concatenate((a, b)), row, size, percent)
            assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_join_of_repeated_ids_and_nothing(spark):
    rows = [(1, "a b c d e f g h i j k l", None, None), (1, "other words stand here now", None, None), (1, "a b c d e f g h i j k l", None, None), (2, None, None, None), (3, "", "", 0), (None, "a b c d e f g h i j k l", None, None), (4, "A B", None, None), (5, "a\tb", None, None)]
    assert joined(spark, rows, shingle=3, percent=90) == plain(rows, 3, 90)
    assert joined(spark, []) == []


def test_product_counts_overlaps():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(30)] + [np.arange(200, dtype=np.uint64)] * 3
    want = np.array([[len(np.intersect1d(a, b)) for b in rows] for a in rows])
    got = product.multiplied(rows, 0)
    assert (got - np.diag(np.diag(got)) == want - np.diag(np.diag(want))).all()  # a set's own columns are not all shared
    assert (product.multiplied(rows, 12) == want[:12, 12:]).all()


def test_histograms_bound_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.choice(1 << 40, int(rng.integers(1, 80)), replace=False)
        b = np.concatenate((a[: len(a) // 2], rng.choice(1 << 40, 9, replace=False)))
        ha, hb = (np.bincount(s % product.BINS, minlength=product.BINS) for s in (a, b))
        assert np.minimum(ha, hb).sum() >= len(np.intersect1d(a, b))


def test_pairs_and_tables():
    i, j = product.pairs_of(np.array([0, 3, 4]), np.array([3, 4, 6]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert product.leaders(5, np.array([3, 4]), np.array([4, 1])).tolist() == [0, 1, 2, 1, 1]
