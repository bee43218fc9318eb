"""Whitening and centroid clustering against plain numpy, and on odd vectors."""

import hashlib

import numpy as np
import pytest

from netweir.llm import simplex, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, x string, cluster string, n string"
ODD = [(900, None), (901, [None] + [0.5] * 63), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63), (904, []), (905, [0.25] * 3), (906, [-1.5] * 65)]


def table(spark, vectors, odd=ODD):
    rows = [(i, [float(x) for x in v]) for i, v in vectors]
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d", "e") for i, v in rows + odd], SCHEMA)


def clustered(n, seed=0, width=64):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((7, width)) / 4
    x = centre[rng.integers(0, 7, n)] + rng.standard_normal((n, width)) / 12
    x[n // 3 : n // 2] = x[0]  # a very common vector
    return x.astype(np.float32)


def plain_whitening(x):
    x = np.floor(1024 * x.astype(float)).astype(np.int64) + 100_000
    n, c = len(x), x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return ((n * x - x.sum(axis=0)) ** 2).sum(axis=1), c @ vectors / np.sqrt(values), values / (c * c).sum() * n


def test_whitening_equals_eigenvectors(spark):
    x = clustered(300)
    got = whitening.whiten(table(spark, enumerate(x)).repartition(5)).toPandas().sort_values(["vec_id", "component"])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.vec_id.tolist() == np.repeat(np.arange(300), 8).tolist() and got.component.tolist() == list(range(1, 9)) * 300
    deviation, white, explained = plain_whitening(x)
    assert got.deviation.tolist() == np.repeat(deviation, 8).tolist() and set(got.n) == {300}
    w = got.whitened.to_numpy().reshape(-1, 8)
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-9
    assert np.abs(got.explained.to_numpy()[:8] / explained - 1).max() < 1e-10
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_of_repeated_eigenvalues(spark):
    """Plus and minus the axes: every eigenvalue of a group of three is the same, which one Krylov space alone cannot tell."""
    rows = [(i, s * np.eye(64)[i] * (8, 4, 2)[i // 3]) for i in range(9) for s in (1, -1)]
    got = whitening.whiten(table(spark, rows)).toPandas()
    assert got.component.max() == 8 and got.identity_error.max() < 1e-9
    first = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(first - np.array([64] * 3 + [16] * 3 + [4] * 2) / 252).max() < 1e-9


@pytest.mark.parametrize("rows,components", [([], 0), ([(1, [0.5] * 64)], 0), ([(1, [0.5] * 64)] * 4, 0), ([(None, [0.5] * 64), (1, [0.25] * 64), (1, [0.125] * 64)], 1)])
def test_whitening_of_few_rows(spark, rows, components):
    got = whitening.whiten(table(spark, rows)).toPandas()
    assert len(got) == components * len(rows) and (not components or got.identity_error.max() < 1e-9)


def test_whitening_of_huge_entries(spark):
    got = whitening.whiten(table(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])).toPandas()
    assert len(got) == 3 and got.deviation.isna().sum() == 2  # beyond a long


def plain_clusters(rows, k=16, rounds=3):
    x = np.array([np.floor(64 * np.asarray(v, float)).astype(np.int64) for _, v in rows])
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), list(map(float, v)), j) for j, (i, v) in enumerate(rows) if i is not None)
    c = np.array([x[j] for _, _, j in order[:k]])
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if r < rounds:
            for i in range(len(c)):
                if (a == i).any():
                    c[i] = [int(s) // int((a == i).sum()) for s in x[a == i].sum(axis=0)]
    digest = [hashlib.sha256(",".join(map(str, q)).encode()).hexdigest() for q in c.tolist()]
    d = d[np.arange(len(x)), a]
    return sorted((i if i is not None else -1, int(b), int(e), int(d[a == b].sum()), int(d.sum()), digest[b]) for (i, _), b, e in zip(rows, a, d))


@pytest.mark.parametrize("n,k,pivots", [(400, 16, 12), (400, 16, 1), (400, 5, 3), (9, 16, 12)])
def test_clusters_equal_plain(spark, n, k, pivots):
    rows = [(int(i), v.tolist()) for i, v in enumerate(clustered(n, seed=n))]
    rows += [(None, rows[3][1]), (3, rows[4][1]), (3, [0.0] * 64), (700, [-0.01] * 64)]
    got = simplex.cluster_vectors(table(spark, rows).repartition(3), k=k, pivots=pivots).toPandas()
    got = sorted((int(r.vec_id) if r.vec_id == r.vec_id else -1, *map(int, r[["cluster", "distance", "cluster_inertia", "inertia"]]), r.centroid_sha256) for _, r in got.iterrows())
    assert got == plain_clusters(rows, k)


def test_clusters_of_nothing(spark):
    assert simplex.cluster_vectors(table(spark, [])).count() == 0
    only = simplex.cluster_vectors(table(spark, [(None, [0.5] * 64)])).collect()
    assert len(only) == 1 and only[0]["cluster"] is None and only[0]["inertia"] is None


def test_clusters_of_equal_and_huge_vectors(spark):
    same = simplex.cluster_vectors(table(spark, [(i, [0.5] * 64) for i in range(40)])).toPandas()
    assert set(same.cluster) == {0} and set(same.inertia) == {0}
    huge = simplex.cluster_vectors(table(spark, [(i, [3e38 * (-1) ** i] * 64) for i in range(40)])).toPandas()
    assert huge.cluster.nunique() == 2 and set(huge.distance) == {0}


def test_bounds_hold():
    x = np.floor(64 * clustered(200).astype(float)).astype(np.int64)
    base = simplex.pivots_of(x[:20], 12)
    a = simplex.apexes(x, base)
    d = np.stack([simplex.squares(x, y) for y in x], axis=1)
    flat = ((a[:, None, :-1] - a[None, :, :-1]) ** 2).sum(axis=2)
    low, high = flat + (a[:, None, -1] - a[None, :, -1]) ** 2, flat + (a[:, None, -1] + a[None, :, -1]) ** 2
    slack = simplex.SLACK * ((a * a).sum(axis=1)[:, None] + (a * a).sum(axis=1)[None, :])
    assert (low - slack <= d).all() and (d <= high + slack).all() and len(base) > 5
    rule_out = low - slack > np.partition(d + np.diag([10**9] * len(x)), 0, axis=1)[:, :1]
    assert rule_out.mean() > 0.2  # the bounds leave pairs out
