"""Exact quantiles per group: ranks over range-partitioned counts, so no task holds a whole group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.sizing import materialize


def group_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``keys`` and, by output name, the interpolated quantile of ``value``, as ``percentile`` gives it (null for a group without values).

    Values are counted, and the counts are dealt by (keys, value) into ranges. Ranks start at the sums of the ranges before; only the ranges that hold a
    wanted rank are numbered row by row.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    counts = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    ranged = materialize(counts.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()), "quantiles")

    w = Window.partitionBy(*names)
    parts = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_c"))
    before = F.sum("_c").over(w.orderBy("_part")) - F.col("_c")
    parts = parts.withColumns({"_before": before, "_total": F.sum("_c").over(w)})
    last = F.col("_total") - 1

    def rank(q: float, whole) -> Column:
        return whole(last * F.lit(float(q))).cast("long")

    wanted = F.array(*[rank(q, f) for q in quantiles.values() for f in (F.floor, F.ceil)])
    held = F.exists(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    some = parts.filter(held | (F.col("_total") == 0)).select(*[F.col(n).alias(f"{n}p") for n in names], F.col("_part").alias("_p"), "_before", "_total")
    on = [F.col(n).eqNullSafe(F.col(f"{n}p")) for n in names] + [F.col("_part") == F.col("_p")]
    end = F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy("_v")) + F.col("_before")
    ranks = ranged.join(some, reduce(and_, on)).withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_start") <= r) & (r < F.col("_end")), F.col("_v"))).cast("double")

    found = {}
    for i, q in enumerate(quantiles.values()):
        found |= {f"_lo{i}": at(rank(q, F.floor)), f"_hi{i}": at(rank(q, F.ceil))}
    ends = ranks.groupBy(*names).agg(F.max("_total").alias("_total"), *[c.alias(n) for n, c in found.items()])

    def between(i: int, q: float) -> Column:
        low, high, position = F.col(f"_lo{i}"), F.col(f"_hi{i}"), last * F.lit(float(q))
        return F.when(low == high, low).otherwise((F.ceil(position) - position) * low + (position - F.floor(position)) * high)

    return ends.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[between(i, q).alias(name) for i, (name, q) in enumerate(quantiles.items())])
