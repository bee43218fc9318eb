"""Embedding columns as matrices: usable rows, integer entries, sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Entries of a block of rows that a task holds as one matrix.
ENTRIES = 1 << 20


def finite(vec: Column) -> Column:
    """Whether the array is there and holds neither null nor infinity nor NaN."""
    return F.coalesce(F.forall(vec, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def listed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    off = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(values).ravel()))


def floored(values: np.ndarray, scale: int, bits: int) -> np.ndarray:
    """floor(scale * value) as integers; those beyond +-2**bits count as that."""
    return np.floor(np.clip(values * scale, -(2.0**bits), 2.0**bits)).astype(np.int64)


def matrices(batches, column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches of about ``ENTRIES`` entries, with their matrix."""
    step = max(1, ENTRIES // max(1, width))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, matrix(part.column(column), width)


def summed(rows: DataFrame, column: str, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Entry by entry the sum of the vectors ``of(matrix)`` over all blocks; ``kind`` (long or double) is their type.

    A task sends one vector. Spark adds them by entry, so the driver gets one vector however many tasks there are. Longs are added as decimals, exactly.
    """

    def run(batches):
        total = None
        for _, x in matrices(batches, column, width):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([listed(total[None, :])], names=["v"])

    parts = rows.select(column).mapInArrow(run, f"v array<{kind}>").select(F.posexplode("v").alias("i", "v"))
    value = F.sum(F.col("v").cast("decimal(38,0)")) if kind == "long" else F.sum("v")
    return [v for _, v in sorted(tuple(r) for r in parts.groupBy("i").agg(value.alias("v")).collect())]
