"""Connected components by alternating star contraction, and forests inside one block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .work import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), both long; the component is its smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones, onto the smallest neighbour, until only stars remain. Minima combine before the
    shuffle, and hubs join back as skewed joins. A round ends in a stored table and one row of totals.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """Neighbours n of each node k hang onto the smallest of n and k."""
        least = pairs.groupBy("k").agg(F.min("n").alias("m"))
        return pairs.join(least, "k").select("k", "n", F.least("k", "m").alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("k"), F.col("b").alias("n")).unionByName(e.select(F.col("b").alias("k"), F.col("a").alias("n")))

    def totals(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    seen = totals(now)
    while True:
        large = star(both(now)).filter("n > k").select(F.col("n").alias("a"), F.col("m").alias("b"))
        large = large.distinct()  # a > b throughout
        hung = star(large.select(F.col("a").alias("k"), F.col("b").alias("n")))
        small = hung.select(F.explode(F.array(F.struct(F.col("n").alias("a"), F.col("m").alias("b")), F.struct(F.col("k").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stored(small.filter("a <> b").distinct(), "stars")
        if (new := totals(now)) == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").toDF("node", "component").distinct())


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each index of a symmetric boolean matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
