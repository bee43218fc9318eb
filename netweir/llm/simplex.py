"""Centroid clustering with n-simplex projection.

Each vector keeps its distances to a few pivots as the apex of a simplex over them: m pivots give m - 1 coordinates and an altitude. Between two apexes, the
distance with the altitudes on the same side is never above the true one, and with the altitudes on opposite sides never below it. A centroid whose lower
bound is above what another is known to reach is left out; the rest are compared exactly, on integers.

Vectors of another length than ``dims``, null ones and those with null or non-finite entries are left out. A row with a null id is assigned, but starts no
centroid. Rows that repeat an id are vectors of their own; equal hashes of starting vectors are ordered by their components. Fewer vectors than ``k`` give
as many centroids; without any vector that has an id, cluster, distance and what follows are null. Entries beyond +-2**27 (after scaling) count as that, so that
squared distances fit in a long; sums of them that do not are null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .vectors import finite, floored, listed, matrices
from .work import stored

BITS = 27
SLACK = 1e-6  # share of the squares by which bounds are widened against rounding
PAIRS = 1 << 14  # vector and centroid pairs compared at a time
LONG = 2**63


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to one integer vector."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def pivots_of(points: np.ndarray, m: int) -> np.ndarray:
    """Of the points in order, up to ``m`` of which each stands off the others' flat by a tenth of its distance at least."""
    chosen: list[int] = []
    for i, p in enumerate(points):
        if chosen:
            base = (points[chosen[1:]] - points[chosen[0]]).astype(float).T
            d = (p - points[chosen[0]]).astype(float)
            off = d - base @ np.linalg.lstsq(base, d, rcond=None)[0] if base.shape[1] else d
            if off @ off <= 0.01 * (d @ d):
                continue
        chosen.append(i)
        if len(chosen) == m:
            break
    return points[chosen]


def apexes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Coordinates over the pivots' simplex, the altitude last, from the distances to the pivots alone."""
    square = np.stack([squares(x, p) for p in pivots], axis=1).astype(float)
    between = np.stack([squares(pivots, p) for p in pivots], axis=1).astype(float)
    if len(pivots) == 1:
        return np.sqrt(square)
    gram = (between[1:, :1] + between[:1, 1:] - between[1:, 1:]) / 2
    inner = (square[:, :1] + between[:1, 1:] - square[:, 1:]) / 2
    flat = np.linalg.solve(np.linalg.cholesky(gram), inner.T).T
    return np.column_stack((flat, np.sqrt(np.maximum(square[:, 0] - (flat * flat).sum(axis=1), 0))))


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equally near ones) and the squared distance.

    The centroid of the smallest upper bound is measured first; the others only where their lower bound does not exceed that distance.
    """
    rows = np.arange(len(x))
    flat = (apex[:, None, :-1] - tops[None, :, :-1]) ** 2
    flat, a, b = flat.sum(axis=2), apex[:, -1:], tops[None, :, -1]
    widened = SLACK * ((apex * apex).sum(axis=1)[:, None] + (tops * tops).sum(axis=1)[None, :])
    first = (flat + (a + b) ** 2).argmin(axis=1)
    exact = np.full(flat.shape, LONG - 1, np.int64)
    open_ = np.zeros(flat.shape, bool)
    open_[rows, first] = True
    for only_first in (True, False):
        if not only_first:
            open_ = (flat + (a - b) ** 2 - widened <= exact[rows, first][:, None]) & ~open_
        at, c = np.nonzero(open_)
        for i in range(0, len(at), PAIRS):
            d = x[at[i : i + PAIRS]] - centroids[c[i : i + PAIRS]]
            exact[at[i : i + PAIRS], c[i : i + PAIRS]] = np.einsum("ij,ij->i", d, d)
    best = exact.argmin(axis=1)
    return best, exact[rows, best]


def _projected(pivots: np.ndarray, dims: int, scale: int):
    def run(batches):
        for batch, values in matrices(batches, "v", dims):
            x = floored(values, scale, BITS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed(x.astype(np.int32)), listed(apexes(x, pivots))], names=["id", "x", "apex"])

    return run


def _assigned(centroids: np.ndarray, tops: np.ndarray):
    def run(batches):
        for batch, x in matrices(batches, "x", centroids.shape[1]):
            apex = batch.column("apex").flatten().to_numpy().reshape(len(x), -1)
            best, d = nearest(x.astype(np.int64), apex, centroids, tops)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    return run


def _moved(centroids: np.ndarray, tops: np.ndarray):
    """One row a cluster and task: vectors and componentwise sums."""
    k, dims = centroids.shape

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch, x in matrices(batches, "x", dims):
            x = x.astype(np.int64)
            apex = batch.column("apex").flatten().to_numpy().reshape(len(x), -1)
            best = nearest(x, apex, centroids, tops)[0]
            order = np.argsort(best, kind="stable")
            have, begin = np.unique(best[order], return_index=True)
            count += np.bincount(best, minlength=k)
            sums[have] += np.add.reduceat(x[order], begin, axis=0)
        use = np.flatnonzero(count)
        if len(use):
            yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), pa.array(count[use]), listed(sums[use])], names=["cluster", "n", "sums"])

    return run


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, pivots: int = 12
) -> DataFrame:
    """One row per usable vector: id, cluster, exact squared distance, the cluster's and all clusters' summed distances, and the digest of the final centroid.

    Components are floor(``scale`` * x). The centroids start as the ``k`` vectors of smallest sha256 of ``<seed>:<id>``; each round assigns every vector to its nearest
    centroid and moves each non-empty one to the floor of its vectors' mean; then vectors are assigned once more.

    Pivots (up to ``pivots`` of the starting centroids) do not move, so the apex of a vector is computed once and stored beside it. A round is one pass: a task
    sends one row of sums a cluster, Spark adds them by cluster and component, and the driver sees ``k`` * ``dims`` numbers.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    usable = vectors.filter(finite(vec) & (F.size(vec_col) == dims)).select(F.col(id_col).cast("long").alias("id"), vec.alias("v"))
    hashed = usable.filter("id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    start = np.array([r["v"] for r in hashed.orderBy("hash", "v").limit(k).collect()], float)
    kinds = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(start):
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in kinds.split(", "))]
        return usable.select(F.col("id").alias(id_col), *nothing)
    centroids = floored(start, scale, BITS)
    base = pivots_of(centroids, pivots)
    rows = stored(usable.mapInArrow(_projected(base, dims, scale), "id long, x array<int>, apex array<double>"), "simplex-apexes")
    for _ in range(rounds):
        parts = rows.mapInArrow(_moved(centroids, apexes(centroids, base)), "cluster int, n long, sums array<long>")
        sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        centroids = centroids.copy()
        for c, at, n, total in sums.collect():
            centroids[c, at] = total // n
    last = stored(rows.mapInArrow(_assigned(centroids, apexes(centroids, base)), "id long, cluster int, distance long"), "simplex-clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    ends = [(c, d if d < LONG else None, total if total < LONG else None, digests[c]) for c, d in sorted(inertia.items())]
    clusters = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = last.join(F.broadcast(clusters), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
