"""Row filters shared by the read operators (each is a plain predicate Catalyst can push down)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.addr import in_cidrs, parse_networks, same_address
from ..functions.timeb import between, instant
from ..params import FlowFilters, QueryParams


def in_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Half-open time range; a ``dt`` partition column, when present, is pruned with it."""
    if "dt" in df.columns:
        df = df.filter(F.col("dt").between(F.lit(start.date()), F.lit(end.date())))
    return df.filter(between(ts, start, end))


def since(df: DataFrame, start, ts: str = "ts") -> DataFrame:
    """From ``start`` on; a ``dt`` partition column, when present, is pruned with it."""
    if "dt" in df.columns:
        df = df.filter(F.col("dt") >= F.lit(start.date()))
    return df.filter(F.col(ts) >= instant(start))


def by_direction(df: DataFrame, direction: str) -> DataFrame:
    return df.filter(F.col("direction") == direction) if direction in ("in", "out") else df


def by_links(df: DataFrame, tags) -> DataFrame:
    tags = list(tags)
    if not tags:
        return df
    return df.filter(F.col("link_tag") == tags[0] if len(tags) == 1 else F.col("link_tag").isin(tags))


def by_ip_version(df: DataFrame, version: int) -> DataFrame:
    return df.filter(F.col("ip_version") == version) if version in (4, 6) else df


def without_as(df: DataFrame, asn: int, column: str = "as_number") -> DataFrame:
    return df.filter(F.col(column) != asn) if asn > 0 else df


def scoped(df: DataFrame, p: QueryParams, ts: str = "ts") -> DataFrame:
    """Time, direction and link filters: the common prefix of every top-N read."""
    return by_links(by_direction(in_range(df, p.start, p.end, ts), p.direction), p.link_tags)


def syn_only(flags="tcp_flags") -> Column:
    c = F.col(flags) if isinstance(flags, str) else flags
    return (c.bitwiseAND(F.lit(2)) != 0) & (c.bitwiseAND(F.lit(16)) == 0)


def _address(ip16: str, text: str) -> Column:
    if not parse_networks([text]):
        raise ValueError(f"invalid address or prefix: {text!r}")
    return in_cidrs(ip16, [text]) if "/" in text else same_address(ip16, text)


def forensic(df: DataFrame, f: FlowFilters) -> DataFrame:
    """Conjunction of the filled-in search fields (``min_bytes`` is applied after aggregation)."""
    df = in_range(df, f.start, f.end)
    for column, text in (("src_ip16", f.src_ip), ("dst_ip16", f.dst_ip)):
        if text:
            df = df.filter(_address(column, text))
    for column in ("src_as", "dst_as", "protocol", "src_port", "dst_port", "ip_version"):
        if getattr(f, column) > 0:
            df = df.filter(F.col(column) == getattr(f, column))
    return df.filter(F.col("link_tag") == f.link_tag) if f.link_tag else df


def top_k(df: DataFrame, metric: str, ties: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Largest first with explicit tie-break keys, so the cut is deterministic."""
    ordered = df.orderBy(F.desc(metric), *ties)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
