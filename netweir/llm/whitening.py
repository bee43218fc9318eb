"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay where they are. Each step multiplies a vector by X and the result by its transpose in one distributed pass, orthogonalises the left vector
against all earlier ones, then the right one, and adds a column to a small projected matrix whose singular value decomposition gives components and deviations.
A left vector is never stored: it is X times a coefficient vector of as many entries as X has columns, so a lost executor costs nothing but its tasks.

Rows whose vector is null or holds null or non-finite entries are left out. The vectors judged are those of the most frequent length (the longer of equally
frequent ones); others, empty ones included, are left out. Rows that repeat an id, and rows with a null id, are rows of their own. Entries
beyond +-2**40 (after scaling) count as that. A deviation that does not fit in a long is null. Only components of a positive eigenvalue are returned, so
equal rows alone give none. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .vectors import finite, floored, listed, matrices, summed
from .work import stored

BITS = 40
CONVERGED = 1e-14  # residual of a component as a share of the largest singular value
NOTHING = 1e-13  # a product of this share of the largest singular value is rounding
LONG = 2**63


class _Centre:
    """Whole and fractional part of the means, so that centring loses no digit."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Per row the exact sum of (n * x - S)**2; null if it does not fit in a long."""
        d = x - self.whole
        most = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if x.shape[1] * most**2 < LONG:
            d = d * self.n - self.rest
            return pa.array(np.einsum("ij,ij->i", d, d))
        d = d.astype(object) * self.n - self.rest.astype(object)
        return pa.array([v if v < LONG else None for v in (d * d).sum(axis=1)], pa.int64())


def _unit(rng: np.random.Generator, right: np.ndarray) -> np.ndarray:
    """A random direction off the given orthonormal columns."""
    v = rng.standard_normal(len(right))
    for _ in range(3):
        v -= right @ (right.T @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(product, width: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values of X, and as columns their right singular vectors.

    ``product(z, A)`` returns, for w = Xz and U = XA, the square of w's norm, U'w and X'w. Steps end when ``want`` vectors have converged, and did so again,
    without a new value, after the Krylov space was left once for a random direction (one space holds only one vector of a repeated value); or when the
    space is exhausted.
    """
    rng = np.random.default_rng(0)
    right, coeff, back = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))  # V; A with U = XA; X'U
    columns: list[np.ndarray] = []  # U'X V by column
    v, restarted, confirmed, scale = _unit(rng, right), True, None, 0.0
    while True:
        column = back.T @ v  # U'Xv: what earlier left vectors hold of Xv
        z = v - coeff @ column
        for _ in range(3):
            square, held, xw = product(z, coeff)
            if held @ held <= 1e-24 * square:
                break
            z, column = z - coeff @ held, column + held  # again: rounding left a part of the earlier ones
        alpha = np.sqrt(max(square, 0.0))
        scale = max(scale, alpha, float(np.linalg.norm(column)))
        right = np.column_stack((right, v))
        if grown := alpha > NOTHING * scale:
            coeff, back = np.column_stack((coeff, z / alpha)), np.column_stack((back, xw / alpha))
            columns.append(np.append(column, alpha))
        else:
            columns.append(column)
            if restarted:  # a random direction off the space that X sends to nothing: there is no more
                break
        if right.shape[1] == width:
            break
        after = back[:, -1] - right @ (right.T @ back[:, -1]) if grown else np.zeros(width)
        after -= right @ (right.T @ after)
        size = float(np.linalg.norm(after))
        restarted = size <= NOTHING * scale
        if not restarted and coeff.shape[1] >= want:
            values, vectors, left = _small(columns, right, coeff.shape[1])
            residual = np.linalg.norm(back @ left[:, :want] - vectors[:, :want] * values[:want], axis=0)
            if residual.max() <= CONVERGED * values[0] * np.sqrt(width):
                if confirmed is not None and np.allclose(confirmed, values[:want], rtol=1e-12, atol=0):
                    break
                confirmed, restarted = values[:want], True
        v = _unit(rng, right) if restarted else after / size
    if not coeff.shape[1]:
        return np.zeros(0), np.zeros((width, 0))
    values, vectors, _ = _small(columns, right, coeff.shape[1])
    use = values > np.sqrt(NOTHING) * values[0]
    return values[use][:want], vectors[:, use][:, :want]


def _small(columns: list[np.ndarray], right: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular values, right vectors in X's columns, and left vectors in U's, of the projected matrix."""
    b = np.zeros((rank, len(columns)))
    for j, column in enumerate(columns):
        b[: len(column), j] = column
    p, values, q = np.linalg.svd(b, full_matrices=False)
    return values, right @ q.T, p


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling deviation.

    An entry c becomes x = floor(``scale`` * c) + ``shift``. Columns: id, component, n (rows), deviation (exact sum over dimensions of (n * x - S)**2), whitened
    (centred x on the unit component, over its deviation), explained (share of the total variance) and identity_error (largest absolute entry of
    the whitened rows' covariance minus the identity).

    A step is one pass; a task sends one vector of sums and Spark adds them by entry, so the driver sees vectors as long as a row is wide. Steps are at most as many
    as a row has entries, however many rows there are.
    """
    vec = F.col(vec_col).cast("array<double>")
    usable = vectors.filter(finite(vec)).select(F.col(id_col).cast("long").alias("id"), vec.alias("v"))
    lengths = usable.filter("size(v) > 0").groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    kind = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = vectors.sparkSession.createDataFrame([], kind).withColumnRenamed("id", id_col)
    if first is None:
        return empty
    width, n = first["width"], first["n"]

    def integers(batches):
        for batch, values in matrices(batches, "v", width):
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed(floored(values, scale, BITS) + shift)], names=["id", "x"])

    rows = stored(usable.filter(F.size("v") == width).mapInArrow(integers, "id long, x array<long>"), "whitening-rows")
    centre = _Centre(n, [int(s) for s in summed(rows, "x", width, lambda x: x.sum(axis=0), "long")])

    def product(z: np.ndarray, coeff: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            x = centre(x)
            w = x @ z
            return np.concatenate(([w @ w], (x @ coeff).T @ w, x.T @ w))

        total = np.array(summed(rows, "x", width, of, "double"))
        return total[0], total[1 : 1 + coeff.shape[1]], total[1 + coeff.shape[1] :]

    values, found = bidiagonalise(product, width, components)
    k = len(values)
    if not k:
        return empty
    basis = found / (values / np.sqrt(n))

    def judged(x: np.ndarray) -> np.ndarray:
        x = centre(x)
        w = x @ basis
        return np.append((w.T @ w).ravel(), np.einsum("ij,ij->", x, x))

    *square, variation = summed(rows, "x", width, judged, "double")
    identity_error = float(np.abs(np.array(square).reshape(k, k) / n - np.eye(k)).max())
    explained = values**2 / variation

    def whitened(batches):
        for batch, x in matrices(batches, "x", width):
            w, deviation = centre(x) @ basis, centre.deviations(x)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            each = np.tile(np.arange(k), len(x))
            columns = [batch.column("id").take(row), pa.array((each + 1).astype(np.int32)), pa.array(np.full(len(each), n)), deviation.take(row)]
            columns += [pa.array(w.ravel()), pa.array(explained[each]), pa.array(np.full(len(each), identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in kind.split(", ")])

    return rows.mapInArrow(whitened, kind).withColumnRenamed("id", id_col)
