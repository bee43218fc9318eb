"""Change detection between a window and the equal window before it (one scan covers both)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.asn import grouped_as, grouped_as_name
from ..functions.timeb import instant
from ..params import QueryParams, prior_window, route_source
from ..plans.filters import in_range
from .dims import with_as_info
from .top import country_or_unknown, when_sum


def _both_windows(tables: Mapping[str, DataFrame], entity: str, p: QueryParams) -> DataFrame:
    start, _ = prior_window(p.start, p.end)
    name = route_source(entity, start, p.end)
    name = f"traffic_by_{entity}" if name == "flows" else name
    return in_range(tables[name], start, p.end)


def _cur_prev(p: QueryParams) -> list[Column]:
    now = F.col("ts") >= instant(p.start)
    return [when_sum(now, "bytes").alias("current"), when_sum(~now, "bytes").alias("previous")]


def _resum() -> list[Column]:
    return [F.sum("current").alias("current"), F.sum("previous").alias("previous")]


def _compared(tables, as_dim: DataFrame, dimension: str, p: QueryParams) -> DataFrame:
    """(key, current, previous) per entity before labelling."""
    if dimension == "as":
        rows = _both_windows(tables, "as", p)
        return rows.groupBy(grouped_as("as_number").alias("entity")).agg(*_cur_prev(p))
    if dimension == "country":
        per_as = _both_windows(tables, "as", p).groupBy("as_number").agg(*_cur_prev(p))
        return with_as_info(per_as, as_dim).groupBy(country_or_unknown().alias("entity")).agg(*_resum())
    if dimension == "prefix":
        rows = _both_windows(tables, "prefix", p)
        # The label is the name of one AS behind the prefix (the smallest number, for determinism).
        return rows.groupBy(F.col("prefix").alias("entity")).agg(*_cur_prev(p), F.min("as_number").alias("label_as"))
    if dimension == "port":
        rows = _both_windows(tables, "port", p).filter(F.col("port") > 0)
        key = F.concat(F.col("protocol").cast("string"), F.lit("/"), F.col("port").cast("string"))
        return rows.groupBy("protocol", "port").agg(*_cur_prev(p)).withColumn("entity", key)
    if dimension == "ip":
        return _both_windows(tables, "ip", p).groupBy(F.col("ip").alias("entity")).agg(*_cur_prev(p))
    raise ValueError(f"unsupported dimension: {dimension!r}")


def _labelled(page: DataFrame, as_dim: DataFrame, dimension: str) -> DataFrame:
    if dimension == "as":
        named = with_as_info(page, as_dim, "entity")
        return named.withColumn("label", grouped_as_name("entity", "as_name"))
    if dimension == "prefix":
        return with_as_info(page, as_dim, "label_as").withColumn("label", F.col("as_name"))
    return page.withColumn("label", F.lit(""))


def movers(tables, as_dim: DataFrame, dimension: str, p: QueryParams, limit: int = 50) -> DataFrame:
    """Largest absolute changes, gainers and losers mixed."""
    if dimension not in ("as", "country", "prefix", "port"):
        raise ValueError(f"unsupported movers dimension: {dimension!r}")
    both = _compared(tables, as_dim, dimension, p).filter((F.col("current") > 0) | (F.col("previous") > 0))
    delta = F.col("current") - F.col("previous")
    page = both.withColumn("delta", delta).orderBy(F.desc(F.abs("delta")), "entity").limit(limit)
    pct = F.when(F.col("previous") > 0, F.col("delta") / F.col("previous") * 100).otherwise(F.lit(0.0))
    return _labelled(page, as_dim, dimension).select(
        F.lit(dimension).alias("dimension"), F.col("entity").cast("string").alias("key"), "label",
        "current", "previous", "delta", pct.alias("pct"),
    ).orderBy(F.desc(F.abs("delta")), "key")


def split_movers(page: DataFrame) -> dict[str, DataFrame]:
    """Gainers and losers of a limited page; unchanged entities are in neither."""
    return {"gainers": page.filter(F.col("delta") > 0), "losers": page.filter(F.col("delta") < 0)}


def talkers(tables, as_dim: DataFrame, dimension: str, p: QueryParams, limit: int = 50) -> DataFrame:
    """Entities seen in exactly one of the two windows: 'new' or 'gone'."""
    if dimension not in ("as", "ip", "prefix"):
        raise ValueError(f"unsupported talkers dimension: {dimension!r}")
    both = _compared(tables, as_dim, dimension, p)
    cur, prev = F.col("current"), F.col("previous")
    one_sided = both.filter(((cur == 0) & (prev > 0)) | ((prev == 0) & (cur > 0)))
    sized = one_sided.withColumn("bytes", F.greatest(cur, prev))
    page = sized.orderBy(F.desc("bytes"), "entity").limit(limit)
    return _labelled(page, as_dim, dimension).select(
        F.lit(dimension).alias("dimension"), F.col("entity").cast("string").alias("key"), "label",
        F.when(cur > 0, "new").otherwise("gone").alias("status"), "bytes",
    ).orderBy(F.desc("bytes"), "key")


def merged_movers(parts: dict[str, DataFrame]) -> DataFrame:
    return parts["gainers"].unionByName(parts["losers"]).orderBy(F.desc(F.abs("delta")), "dimension", "key")


def merged_talkers(*pages: DataFrame) -> DataFrame:
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.orderBy(F.desc("bytes"), "dimension", "key")
