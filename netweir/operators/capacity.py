"""Percentiles, link capacity and forecasts, load curves, heatmap."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeb import iso_weekday
from ..params import QueryParams
from ..plans.filters import by_ip_version, by_links, in_range
from .series import AS_POINT, Tables, _points, source
from .top import when_sum

FORECAST_DAYS = 90
CURVE_POINTS = 500
HISTOGRAM_BINS = 20
LEVELS = (80, 95, 100)


def _quantile(column: str, q: float) -> Column:
    """Interpolated percentile, truncated to a whole number and never negative; no buckets give 0."""
    return F.coalesce(F.floor(F.greatest(F.percentile(column, F.lit(q)), F.lit(0.0))), F.lit(0)).cast("long")


def _link_buckets(tables: Tables, p: QueryParams, keys: list[str]) -> DataFrame:
    sums = [F.sum("bytes_in").alias("bi"), F.sum("bytes_out").alias("bo")]
    return _points(source(tables, "link", p), p.step, keys, sums)


def links_p95(tables: Tables, p: QueryParams) -> DataFrame:
    return _link_buckets(tables, p, []).agg(_quantile("bi", 0.95).alias("p95_in"), _quantile("bo", 0.95).alias("p95_out"))


def _one_link(tables: Tables, tag: str, p: QueryParams) -> DataFrame:
    return _link_buckets(tables, p, ["link_tag"]).filter(F.col("link_tag") == tag)


def link_p95(tables: Tables, tag: str, p: QueryParams) -> DataFrame:
    return _one_link(tables, tag, p).agg(_quantile("bi", 0.95).alias("p95_in"), _quantile("bo", 0.95).alias("p95_out"))


def as_p95(tables: Tables, asn: int, p: QueryParams) -> DataFrame:
    rows = source(tables, "as", p).filter(F.col("as_number") == asn)
    d, v = F.col("direction"), F.col("ip_version")
    cells = {
        f"v{version}_{end}": (d == role) & (v == version)
        for version in (4, 6)
        for role, end in zip(AS_POINT, ("in", "out"))
    }
    buckets = _points(rows, p.step, [], [when_sum(cond, "bytes").alias(n) for n, cond in cells.items()])
    return buckets.agg(*[_quantile(n, 0.95).alias(f"p95_{n}") for n in cells])


def link_percentiles(tables: Tables, tag: str, p: QueryParams) -> DataFrame:
    return _one_link(tables, tag, p).agg(
        *[_quantile(c, q / 100).alias(f"p{q}_{end}") for c, end in (("bi", "in"), ("bo", "out")) for q in (50, 95, 99)]
    )


def _bps(seconds: int) -> Column:
    return (F.col("bi") + F.col("bo")) * 8 / F.lit(seconds)


def link_p95_total(tables: Tables, tag: str, p: QueryParams) -> DataFrame:
    return _one_link(tables, tag, p).select(_bps(p.step).alias("bps")).agg(_quantile("bps", 0.95).alias("p95_bps"))


def bucket_p95_by_link(tables: Tables, p: QueryParams) -> DataFrame:
    rows = source(tables, "link", p, allow_raw=False)
    sums = [F.sum("bytes_in").alias("bi"), F.sum("bytes_out").alias("bo")]
    buckets = _points(rows, p.step, ["link_tag"], sums).select("link_tag", _bps(p.step).alias("bps"))
    return buckets.groupBy("link_tag").agg(_quantile("bps", 0.95).alias("p95_bps"))


def current_by_link(tables: Tables, p: QueryParams) -> DataFrame:
    tail = p.with_(start=max(p.start, p.end - timedelta(seconds=p.step)))
    rows = in_range(source(tables, "link", p, allow_raw=False), tail.start, tail.end)
    sums = rows.groupBy("link_tag").agg(F.sum("bytes_in").alias("bi"), F.sum("bytes_out").alias("bo"))
    return sums.select("link_tag", F.floor(_bps(p.step)).cast("long").alias("current_bps"))


def daily_by_link(daily: DataFrame, p: QueryParams) -> DataFrame:
    """Average bps per link and day over the forecast look-back."""
    rows = in_range(daily, p.end - timedelta(days=FORECAST_DAYS), p.end)
    sums = rows.groupBy("link_tag", F.to_date("ts").alias("day")).agg(
        F.sum("bytes_in").alias("bi"), F.sum("bytes_out").alias("bo")
    )
    return sums.select("link_tag", "day", _bps(86400).alias("bps"))


def trend(days: DataFrame, key: str = "link_tag") -> DataFrame:
    """Least squares over the day *index* 0..n-1 (missing days are not spaced); needs two days."""
    w = Window.partitionBy(key).orderBy("day")
    indexed = days.withColumn("x", F.row_number().over(w) - 1)
    fit = indexed.groupBy(key).agg(
        F.count("*").alias("n"),
        F.regr_slope("bps", "x").alias("slope"),
        F.regr_intercept("bps", "x").alias("intercept"),
    )
    return fit.filter(F.col("n") >= 2)


def days_to_level(slope, intercept, last_x, level) -> Column:
    """Days until the fitted line reaches a level: NULL when not rising, 0 when already there."""
    s, b, x = (F.col(c) if isinstance(c, str) else c for c in (slope, intercept, last_x))
    return F.when(s > 0, F.when(b + s * x >= level, F.lit(0.0)).otherwise(F.greatest((level - b) / s - x, F.lit(0.0))))


def utilization(p95_bps, capacity_mbps) -> Column:
    p95, cap = (F.col(c) if isinstance(c, str) else c for c in (p95_bps, capacity_mbps))
    return F.when(cap > 0, p95 / (cap * F.lit(1e6)) * 100)


def links_capacity(tables: Tables, links: DataFrame, p: QueryParams) -> DataFrame:
    """Every configured link (idle ones too) with current rate, p95, utilisation and saturation forecasts."""
    base = links.select(F.col("tag").alias("link_tag"), "description", F.col("capacity_mbps").cast("long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = (
        base.join(bucket_p95_by_link(tables, p), "link_tag", "left")
        .join(current_by_link(tables, p), "link_tag", "left")
        .join(trend(daily_by_link(tables["traffic_by_link_daily"], p)), "link_tag", "left")
    )
    cap_bps = F.col("capacity_mbps") * F.lit(1e6)
    fitted = F.when(F.col("capacity_mbps") > 0, F.col("slope"))
    forecasts = [
        days_to_level(fitted, "intercept", F.col("n") - 1, cap_bps * F.lit(level / 100)).alias(f"forecast_days_{level}")
        for level in LEVELS
    ]
    rows = joined.withColumns({"p95_bps": F.coalesce("p95_bps", F.lit(0)).cast("long")})
    out = rows.select(
        "link_tag", "description", "capacity_mbps", zero("current_bps"), "p95_bps",
        utilization("p95_bps", "capacity_mbps").alias("utilization_pct"),
        F.coalesce(fitted, F.lit(0.0)).alias("trend_bps_per_day"),
        *forecasts,
    )
    return out.orderBy(F.desc("p95_bps"), "link_tag")


def soonest_saturation(capacity: DataFrame) -> DataFrame:
    return capacity.withColumn("soonest_days", F.least(*[F.col(f"forecast_days_{level}") for level in LEVELS]))


def link_utilization(tables: Tables, links: DataFrame, tag: str, p: QueryParams) -> DataFrame:
    p95 = link_p95_total(tables, tag, p)
    # Global aggregate (one row) next to the one current row of the link.
    capacity = links.filter(F.col("tag") == tag).agg(F.coalesce(F.max("capacity_mbps"), F.lit(0)).alias("c")).scalar()
    return p95.select(F.lit(tag).alias("link_tag"), "p95_bps", utilization("p95_bps", capacity).alias("utilization_pct"))


# ---- load-duration curve ------------------------------------------------------


def _samples(tables: Tables, tag: str, p: QueryParams) -> DataFrame:
    return _one_link(tables, tag, p).select("link_tag", _bps(p.step).alias("bps"))


def load_quantiles(samples: DataFrame) -> DataFrame:
    return samples.groupBy("link_tag").agg(
        F.count("*").alias("sample_count"),
        *[F.percentile("bps", F.lit(q / 100)).alias(f"p{q}") for q in (50, 90, 95, 99, 100)],
    )


def downsample_desc(samples: DataFrame, most: int = CURVE_POINTS, key: str = "link_tag", value: str = "bps") -> DataFrame:
    """Sorted descending, thinned to at most ``most`` evenly strided points; both ends are kept.

    A row at index r survives when r = floor(i*(n-1)/(most-1)) for some i; that i can only be
    ceil(r*(most-1)/(n-1)), so the test is an expression, not a join.
    """
    w = Window.partitionBy(key).orderBy(F.desc(value))
    ranked = samples.withColumns(
        {"r": (F.row_number().over(w) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy(key))}
    )
    last = F.lit(most - 1).cast("long")
    i = F.floor((F.col("r") * last + F.col("n") - 2) / F.greatest(F.col("n") - 1, F.lit(1)))
    kept = (F.col("n") <= most) | ((i <= last) & (F.floor(i * (F.col("n") - 1) / last) == F.col("r")))
    thin = ranked.filter(kept)
    position = F.row_number().over(w) - 1
    return thin.select(key, position.cast("long").alias("i"), value)


def duration_axis(curve: DataFrame, key: str = "link_tag") -> DataFrame:
    n = F.count("*").over(Window.partitionBy(key))
    return curve.withColumn("pct", F.when(n > 1, F.col("i") / (n - 1) * 100).otherwise(F.lit(0.0)))


def histogram(samples: DataFrame, bins: int = HISTOGRAM_BINS, key: str = "link_tag", value: str = "bps") -> DataFrame:
    """Equal-width bins from min to max, the last one closed; identical values all land in the first bin."""
    ends = samples.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    slot = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = samples.join(ends, key).groupBy(key, slot.cast("int").alias("bin")).agg(F.count("*").alias("samples"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    flat = width <= 0
    lower = F.when(flat, F.when(F.col("bin") == 0, F.col("lo")).otherwise(F.col("hi"))).otherwise(
        F.col("lo") + F.col("bin") * width
    )
    upper = F.when(flat, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
    return grid.join(counts, [key, "bin"], "left").select(
        key, "bin", lower.alias("lower_bps"), upper.alias("upper_bps"),
        F.coalesce("samples", F.lit(0)).cast("long").alias("samples"),
    )


def load_curve(tables: Tables, tag: str, p: QueryParams) -> dict[str, DataFrame]:
    samples = _samples(tables, tag, p)
    return {
        "quantiles": load_quantiles(samples),
        "points": duration_axis(downsample_desc(samples)),
        "histogram": histogram(samples),
    }


# ---- heatmap -------------------------------------------------------------------


def traffic_heatmap(hourly: DataFrame, p: QueryParams) -> DataFrame:
    """Mean and peak hourly rate per (weekday, hour); hours without rows are absent."""
    rows = by_ip_version(by_links(in_range(hourly, p.start, p.end), p.link_tags), p.ip_version)
    rows = rows.filter(F.col("link_tag") != "")
    volume = {"in": F.col("bytes_in"), "out": F.col("bytes_out")}.get(
        p.direction, F.col("bytes_in") + F.col("bytes_out")
    )
    hours = rows.groupBy("ts").agg((F.sum(volume) * 8 / F.lit(3600)).alias("bps"))
    return hours.groupBy(iso_weekday("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.avg("bps").alias("mean_bps"), F.max("bps").alias("peak_bps")
    )


def dense_heatmap(cells: DataFrame) -> DataFrame:
    """The full 7 x 24 grid (a fixed 168 rows), zero-filled."""
    slots = cells.sparkSession.range(168).select(
        (F.floor(F.col("id") / 24) + 1).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour")
    )
    return slots.join(cells, ["day", "hour"], "left").select(
        "day", "hour", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_bps", "peak_bps")]
    )
