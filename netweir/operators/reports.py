"""Periodic report: the requested sections as one long (section, row_no, key, value) table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import QueryParams, report_window
from . import top
from .alerts import active_by_severity, severity_rank
from .capacity import links_capacity

SECTIONS = ("overview", "top_as", "top_country", "capacity", "alerts")
TOP_N = 20


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.when(F.col(name).isNotNull(), F.format_string("%.2f", name)) if kind == "double" else F.col(name).cast("string")


def _long(df: DataFrame, section: str, order: list[Column], names: list[str]) -> DataFrame:
    """A limited page (at most a few hundred rows) unpivoted, keeping its order as row_no."""
    numbered = df.withColumn("row_no", F.row_number().over(Window.orderBy(*order)))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.coalesce(_text(df, n), F.lit("")).alias("value")) for n in names])
    return numbered.select(F.lit(section).alias("section"), "row_no", F.explode(pairs).alias("kv")).select(
        "section", "row_no", "kv.key", "kv.value"
    )


def report(lake, links: DataFrame, as_dim: DataFrame, alerts: DataFrame, frequency: str, at: datetime, sections=SECTIONS):
    start, end = report_window(frequency, at)
    p = QueryParams(start, end, limit=TOP_N)
    parts: list[DataFrame] = []
    if "overview" in sections:
        totals = top.overview(
            lake["traffic_by_link"], lake["traffic_by_as"], lake["traffic_by_ip"], links, as_dim, p
        )["totals"]
        names = ["total_bytes_in", "total_bytes_out", "total_flows", "active_as_count"]
        parts.append(_long(totals, "overview", [F.lit(1)], names))
    if "top_as" in sections:
        page = top.top_as(lake["traffic_by_as"], as_dim, p)
        names = ["as_num", "as_name", "country", "total_bytes", "total_packets", "total_flows", "percent"]
        parts.append(_long(page, "top_as", [F.desc("total_bytes"), F.col("as_num")], names))
    if "top_country" in sections:
        page = top.top_country(lake["traffic_by_as"], as_dim, p)
        names = ["country_code", "total_bytes", "total_packets", "total_flows", "percent"]
        parts.append(_long(page, "top_country", [F.desc("total_bytes"), F.col("country_code")], names))
    if "capacity" in sections:
        page = links_capacity(lake, links, p)
        names = ["link_tag", "description", "capacity_mbps", "current_bps", "p95_bps", "utilization_pct"]
        parts.append(_long(page, "capacity", [F.desc("p95_bps"), F.col("link_tag")], names))
    if "alerts" in sections:
        counts = active_by_severity(alerts)
        parts.append(_long(counts, "alerts", [F.desc(severity_rank("severity")), F.col("severity")], ["severity", "alerts"]))
    if not parts:
        raise ValueError("no known section requested")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_bundle(long: DataFrame, path: str) -> None:
    """Titled CSV blocks: one folder per section."""
    ordered = long.repartition("section").sortWithinPartitions("section", "row_no")
    ordered.write.mode("overwrite").partitionBy("section").option("header", True).csv(path)
