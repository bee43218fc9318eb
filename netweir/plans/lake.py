"""Named tables behind the read operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from .. import schema
from .rollup import ROLLUPS, Rollup, build, coarsen, partials, write_partials
from .sizing import materialize


class Lake:
    """Raw flows and their rollups by name; anything not given is a view over the flows.

    A rollup *view* is the role projection of the flows: its rows are valid partial rows,
    so a read over it still costs one aggregate.  Stored rollups (:meth:`open`) hold far
    fewer rows of the same shape; the operators cannot tell the difference.
    """

    def __init__(self, flows: DataFrame | None, stored: dict[str, Callable[[], DataFrame]] | None = None):
        self._tables = {} if flows is None else {"flows": flows}
        self._stored = stored or {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._stored[name]() if name in self._stored else partials(self["flows"], ROLLUPS[name])
        return self._tables[name]

    @classmethod
    def open(cls, spark: SparkSession, root: str, rollups=tuple(ROLLUPS)) -> "Lake":
        """Stored layout: ``root/flows`` and ``root/<rollup>``, day partitioned. A table's days are listed when it is first read."""
        stored = T.StructType([*schema.FLOW.fields, T.StructField("dt", T.DateType())])
        tables = {name: lambda name=name: spark.read.parquet(f"{root}/{name}") for name in rollups}
        return cls(None, {"flows": lambda: spark.read.schema(stored).parquet(f"{root}/flows"), **tables})


def store_rollups(flows: DataFrame, root: str, rollups: list[Rollup] | None = None) -> None:
    """Batch job: append every rollup of one load of flows.

    Hourly and daily tables are coarsened from the load's finer rows, so the flows are scanned once per family.
    """
    specs = {spec.name: spec for spec in rollups or ROLLUPS.values()}
    coarser = {n: [f"{n}_{c}" for c in ("hourly", "daily") if f"{n}_{c}" in specs] for n in specs}
    derived = {n for names in coarser.values() for n in names}
    for name in specs:
        if name in derived:
            continue
        rows = build(flows, specs[name])
        rows = materialize(rows, name) if coarser[name] else rows  # written once for the coarser tables
        for n in (name, *coarser[name]):
            write_partials(rows if n == name else coarsen(rows, specs[n]), specs[n], f"{root}/{n}")
