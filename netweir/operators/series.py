"""Time series over routed sources: raw flows for short ranges, rollups beyond."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.addr import same_address
from ..functions.asn import asymmetry_class, asymmetry_ratio, grouped_as, grouped_as_name
from ..functions.timeb import bucket, instant
from ..params import FlowFilters, QueryParams, route_source
from ..plans.filters import by_ip_version, by_links, in_range, top_k, without_as
from ..plans.rollup import ROLLUPS, partials
from ..plans.sizing import pin_if_small
from .dims import with_as_info, with_link_info
from .top import when_sum

Tables = Mapping[str, DataFrame]
POINT = ("bytes_in", "bytes_out", "packets_in", "packets_out")


def source(tables: Tables, entity: str, p: QueryParams, allow_raw: bool = True) -> DataFrame:
    """Rows of the table that serves the range, already restricted to it.

    The raw route is the same role projection as the rollup, only at the chart's own
    step, so the operators below read one shape whichever table was picked.
    """
    name = route_source(entity, p.start, p.end)
    if name == "flows" and allow_raw:
        flows = in_range(tables["flows"], p.start, p.end, "timestamp")
        return partials(flows, replace(ROLLUPS[f"traffic_by_{entity}"], seconds=p.step))
    name = f"traffic_by_{entity}" if name == "flows" else name
    return in_range(tables[name], p.start, p.end)


def _by_role(first: str, second: str) -> list[Column]:
    d = F.col("direction")
    return [
        when_sum(d == first, "bytes").alias("bytes_in"),
        when_sum(d == second, "bytes").alias("bytes_out"),
        when_sum(d == first, "packets").alias("packets_in"),
        when_sum(d == second, "packets").alias("packets_out"),
    ]


# A per-AS series reads "in" as download *from* the AS, i.e. rows keyed by the source role.
AS_POINT = ("out", "in")


def _points(rows: DataFrame, step: int, keys: list[str], measures: list[Column]) -> DataFrame:
    stepped = rows.withColumn("period", bucket("ts", step))
    return stepped.groupBy("period", *keys).agg(*measures)


def as_series(tables: Tables, asn: int, p: QueryParams) -> DataFrame:
    rows = by_links(source(tables, "as", p), p.link_tags).filter(F.col("as_number") == asn)
    return _points(rows, p.step, [], _by_role(*AS_POINT))


def as_link_series(tables: Tables, asn: int, p: QueryParams) -> DataFrame:
    rows = by_ip_version(source(tables, "as", p), p.ip_version)
    rows = rows.filter((F.col("as_number") == asn) & (F.col("link_tag") != ""))
    return _points(rows, p.step, ["link_tag"], _by_role(*AS_POINT))


def as_totals(tables: Tables, asn: int, p: QueryParams) -> DataFrame:
    rows = source(tables, "as", p, allow_raw=False).filter(F.col("as_number") == asn)
    d, v = F.col("direction"), F.col("ip_version")
    return rows.agg(
        *[
            F.coalesce(when_sum((d == role) & (v == version), "bytes"), F.lit(0)).alias(f"v{version}_{end}")
            for version in (4, 6)
            for role, end in zip(AS_POINT, ("in", "out"))
        ]
    )


def as_asymmetry(tables: Tables, asn: int, p: QueryParams) -> DataFrame:
    """In/out totals by role (not swapped), ratio and traffic class."""
    rows = by_links(source(tables, "as", p, allow_raw=False), p.link_tags).filter(F.col("as_number") == asn)
    d = F.col("direction")
    sums = rows.agg(
        F.coalesce(when_sum(d == "in", "bytes"), F.lit(0)).alias("bytes_in"),
        F.coalesce(when_sum(d == "out", "bytes"), F.lit(0)).alias("bytes_out"),
    )
    return sums.select(
        "*",
        asymmetry_ratio("bytes_in", "bytes_out").alias("ratio"),
        asymmetry_class("bytes_in", "bytes_out").alias("class"),
    )


def ip_series(tables: Tables, ip: str, p: QueryParams) -> DataFrame:
    rows = by_links(source(tables, "ip", p), p.link_tags).filter(same_address("ip16", ip))
    return _points(rows, p.step, [], _by_role("in", "out"))


def _link_points(rows: DataFrame, step: int, keys: list[str]) -> DataFrame:
    return _points(rows, step, keys, [F.sum(c).alias(c) for c in POINT])


def link_series(tables: Tables, tag: str, p: QueryParams) -> DataFrame:
    return _link_points(source(tables, "link", p).filter(F.col("link_tag") == tag), p.step, [])


def links_series(tables: Tables, links: DataFrame, p: QueryParams) -> DataFrame:
    rows = by_ip_version(source(tables, "link", p), p.ip_version)
    points = _link_points(rows.filter(F.col("link_tag") != ""), p.step, ["link_tag"])
    return with_link_info(points, links).select("period", "link_tag", "description", *POINT)


def link_as_series(tables: Tables, as_dim: DataFrame, tag: str, p: QueryParams, n: int = 10) -> DataFrame:
    """Top-N AS of one link, then their series (semi-join on the N folded keys)."""
    rows = source(tables, "as", p, allow_raw=False).filter(F.col("link_tag") == tag)
    rows = rows.withColumn("as_num", grouped_as("as_number"))
    top = _pinned(top_k(rows.groupBy("as_num").agg(F.sum("bytes").alias("total_bytes")), "total_bytes", ["as_num"], n))
    named = with_as_info(top, as_dim, "as_num").withColumn("as_name", grouped_as_name("as_num", "as_name"))
    points = _points(
        rows.join(top.select("as_num"), "as_num", "left_semi"),
        p.step, ["as_num"], _by_role(*AS_POINT)[:2],
    )
    return points.join(F.broadcast(named.select("as_num", "as_name", "total_bytes")), "as_num").select(
        "as_num", "as_name", "total_bytes", "period", "bytes_in", "bytes_out"
    )


def nearest_rank(column: str, q: float = 0.95) -> Column:
    """Aggregate: element floor((n-1)*q) of the sorted values (one value per time bucket)."""
    position = F.floor((F.count(column) - 1) * F.lit(q)) + 1
    return F.element_at(F.array_sort(F.collect_list(column)), position.cast("int"))


def _pinned(top: DataFrame) -> DataFrame:
    """A top list (as many rows as its limit), computed once; small enough ones are then broadcast to every use."""
    return pin_if_small(top)


def _top_as_raw(flows: DataFrame, p: QueryParams) -> tuple[DataFrame, DataFrame]:
    rows = by_ip_version(in_range(flows, p.start, p.end, "timestamp"), p.ip_version).select(
        F.col("timestamp").alias("ts"), "link_tag", "src_as", "dst_as",
        (F.col("bytes") * F.col("sampling_rate")).alias("bytes"), (F.col("packets") * F.col("sampling_rate")).alias("packets"),
    )

    def listed(column: str) -> Column:
        kept = (F.col(column) > 0) & (F.col(column) != p.exclude_as)
        return F.when(kept, grouped_as(column))

    both = rows.select(F.explode(F.array(listed("src_as"), listed("dst_as"))).alias("as_num"), "bytes").filter("as_num IS NOT NULL")
    top = _pinned(top_k(both.groupBy("as_num").agg(F.sum("bytes").alias("total_bytes")), "total_bytes", ["as_num"], p.limit))
    shaped = rows.filter(F.col("link_tag") != "").withColumns({"s": grouped_as("src_as"), "d": grouped_as("dst_as")})
    marked = shaped.join(top.select(F.col("as_num").alias("ks")), F.col("s") == F.col("ks"), "left").join(
        top.select(F.col("as_num").alias("kd")), F.col("d") == F.col("kd"), "left"
    )
    is_s, is_d = F.col("ks").isNotNull(), F.col("kd").isNotNull()
    # A flow between two listed ASes counts in both sums of its source AS.
    hits = marked.filter(is_s | is_d).withColumn("as_num", F.coalesce("ks", "kd"))
    measures = [
        when_sum(is_s, "bytes").alias("bytes_in"), when_sum(is_d, "bytes").alias("bytes_out"),
        when_sum(is_s, "packets").alias("packets_in"), when_sum(is_d, "packets").alias("packets_out"),
    ]
    return top, _points(hits, p.step, ["as_num", "link_tag"], measures)


def _top_as_rollup(rows: DataFrame, p: QueryParams) -> tuple[DataFrame, DataFrame]:
    rows = by_ip_version(rows, p.ip_version)
    ranked = without_as(rows, p.exclude_as).groupBy(grouped_as("as_number").alias("as_num"))
    top = _pinned(top_k(ranked.agg(F.sum("bytes").alias("total_bytes")), "total_bytes", ["as_num"], p.limit))
    listed = rows.withColumn("as_num", grouped_as("as_number")).join(top.select("as_num"), "as_num", "left_semi")
    return top, _points(listed, p.step, ["as_num", "link_tag"], _by_role(*AS_POINT))


def top_as_series(tables: Tables, as_dim: DataFrame, p: QueryParams) -> DataFrame:
    """Top-N AS with per-link series and the nearest-rank p95 of their per-period totals."""
    if route_source("as", p.start, p.end) == "flows":
        top, points = _top_as_raw(tables["flows"], p)
    else:
        top, points = _top_as_rollup(source(tables, "as", p), p)
    periods = points.groupBy("as_num", "period").agg(F.sum("bytes_in").alias("i"), F.sum("bytes_out").alias("o"))
    p95 = periods.groupBy("as_num").agg(nearest_rank("i").alias("p95_in"), nearest_rank("o").alias("p95_out"))
    named = with_as_info(top, as_dim, "as_num").withColumn("as_name", grouped_as_name("as_num", "as_name"))
    head = named.select("as_num", "as_name", "total_bytes").join(p95, "as_num", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("p95_in", "p95_out")}
    return head.withColumns(zero).join(points, "as_num", "left").select(
        "as_num", "as_name", "total_bytes", "p95_in", "p95_out", "period", "link_tag", *POINT
    )


def flow_series(log: DataFrame, f: FlowFilters) -> DataFrame:
    """Minute points of one flow tuple (exact addresses, protocol, destination port)."""
    rows = in_range(log, f.start, f.end)
    for column, text in (("src_ip16", f.src_ip), ("dst_ip16", f.dst_ip)):
        rows = rows.filter(same_address(column, text)) if text else rows
    for column in ("protocol", "dst_port"):
        rows = rows.filter(F.col(column) == getattr(f, column)) if getattr(f, column) > 0 else rows
    return rows.groupBy("ts").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


# ---- shaping of finished series -------------------------------------------------


def sum_link_series(series: DataFrame) -> DataFrame:
    return series.groupBy("period").agg(*[F.sum(c).alias(c) for c in POINT])


def shift_series(series: DataFrame, seconds: int) -> DataFrame:
    return series.withColumn("period", F.col("period") + F.make_dt_interval(secs=F.lit(seconds)))


def compare_previous(current: DataFrame, previous: DataFrame, p: QueryParams) -> DataFrame:
    """Overlay the prior equal window: shifted forward, snapped to the step, joined by bucket."""
    moved = shift_series(previous, int(p.seconds))
    # Rounding to the nearest step = the bucket of (t + step/2).
    half = moved.withColumn("period", F.col("period") + F.make_dt_interval(secs=F.lit(p.step / 2)))
    snapped = half.select(
        bucket("period", p.step).alias("period"),
        *[F.col(c).alias(f"prev_{c}") for c in POINT],
    )
    return current.join(snapped, "period", "left")


def densify(series: DataFrame, key: str = "link_tag", measures=POINT) -> DataFrame:
    """A row for every (period, key) present in the chart; absent ones are zero.

    The key list is a scalar subquery (links of one chart), exploded per period: no join.
    """
    keys = series.agg(F.array_sort(F.collect_set(key)).alias("k")).scalar()
    values = F.struct(*[F.col(c) for c in measures])
    per_period = series.groupBy("period").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(key), values))).alias("m")
    )
    rows = per_period.select("period", "m", F.explode(keys).alias(key))
    return rows.select(
        "period", key, *[F.coalesce(F.col("m")[F.col(key)][c], F.lit(0).cast("long")).alias(c) for c in measures]
    )


def gap_fill(series: DataFrame, step: int, p: QueryParams | None = None, key: str = "link_tag", measures=POINT,
             threshold: int = 4) -> DataFrame:
    """Zero points around every gap wider than ``threshold`` steps, and at the padded edges of the range."""
    w = Window.partitionBy(key).orderBy("period")
    jump = F.make_dt_interval(secs=F.lit(step * threshold))
    one = F.make_dt_interval(secs=F.lit(step))
    t, before, after = F.col("period"), F.col("_prev"), F.col("_next")
    late = before.isNull() & (t > instant(p.start) + jump) if p else F.lit(False)
    early = after.isNull() & (t < instant(p.end) - jump) if p else F.lit(False)
    zeros = F.array(
        F.when((before.isNotNull() & (t - before > jump)) | late, t - one),
        F.when((after.isNotNull() & (after - t > jump)) | early, t + one),
    )
    marked = series.withColumns({"_prev": F.lag("period").over(w), "_next": F.lead("period").over(w)})
    points = F.concat(
        F.array(F.struct(t.alias("period"), *[F.col(c) for c in measures], F.lit(False).alias("inserted"))),
        F.transform(
            F.filter(zeros, lambda z: z.isNotNull()),
            lambda z: F.struct(
                z.alias("period"), *[F.lit(0).cast("long").alias(c) for c in measures], F.lit(True).alias("inserted")
            ),
        ),
    )
    return marked.select(key, F.explode(points).alias("pt")).select(
        "pt.period", key, *[f"pt.{c}" for c in measures], "pt.inserted"
    )


def infer_interval(series: DataFrame, key: str = "link_tag", default: int = 300) -> DataFrame:
    """Smallest positive distance between neighbouring points, in seconds."""
    w = Window.partitionBy(key).orderBy("period")
    gap = F.unix_timestamp("period") - F.unix_timestamp(F.lag("period").over(w))
    return series.select(gap.alias("gap")).agg(
        F.coalesce(F.min(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(default)).cast("long").alias("interval_seconds")
    )


def nested(series: DataFrame, keys: list[str]) -> DataFrame:
    """Edge form: one row per entity with its ordered points (a chart's bounded bucket count)."""
    measures = [c for c in POINT if c in series.columns]
    return series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period", *measures))).alias("points"))
