"""Per-session access to the derived tables (plans only; nothing is cached in memory)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import dims, enrich
from ..plans.lake import Lake
from ..plans.sizing import pin_if_small
from . import fixtures as fx


class Context:
    exact = True  # distinct counts: counted on raw rows

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, *tables: str, **frames: DataFrame) -> DataFrame:
        """Run portable SQL whose table names are the given tables or data frames."""
        for t in tables:
            frames[t] = self.table(t)
        out = text
        for name in frames:
            for word in (f"FROM {name}", f"JOIN {name}"):
                out = out.replace(word, word.replace(name, "{" + name + "}"))
        return self.spark.sql(out, **frames)

    def raw_flows(self, kind: str, source: DataFrame | None = None) -> DataFrame:
        """Decoded flows before enrichment, derived from ``events`` or ``lineitem``."""
        base = fx.FLOW_TABLE[kind]
        frames = {base: source if source is not None else self.table(base)}
        return self.sql(f"WITH {fx.FLOW_CTES[kind]} SELECT * FROM flows", **frames)

    def enriched(self, kind: str, source: DataFrame | None = None) -> DataFrame:
        rows = enrich.normalize_addresses(self.raw_flows(kind, source))
        rows = enrich.attribute_links(rows, self.interfaces)
        return enrich.override_local_as(rows, fx.LOCAL_AS, fx.LOCAL_PREFIXES)

    @cached_property
    def link_versions(self) -> DataFrame:
        return self.spark.sql(fx.LINKS)

    @cached_property
    def links(self) -> DataFrame:
        return dims.link_dim(self.link_versions)

    @cached_property
    def interfaces(self) -> DataFrame:
        return pin_if_small(enrich.interface_map(dims.current_links(self.link_versions)))

    @cached_property
    def as_versions(self) -> DataFrame:
        return self.sql(fx.AS_NAMES, "supplier", "nation")

    @cached_property
    def as_dim(self) -> DataFrame:
        return dims.as_dim(self.as_versions)

    @cached_property
    def ev(self) -> Lake:
        return Lake(self.enriched("ev"))

    @cached_property
    def li(self) -> Lake:
        return Lake(self.enriched("li"))

    @cached_property
    def hostgroups(self) -> DataFrame:
        return self.sql(fx.HOSTGROUPS, "orders")

    @cached_property
    def alerts(self) -> DataFrame:
        return self.sql(fx.ALERTS, "events")

    @cached_property
    def audit(self) -> DataFrame:
        return self.sql(fx.AUDIT, "orders")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.sql(fx.BLOCKS, "events")


_CONTEXTS: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]
