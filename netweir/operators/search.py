"""Forensic flow search over the minute flow log, and its export columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import protocol_name, service_name
from ..params import FlowFilters
from ..plans.filters import forensic

TUPLE = ["link_tag", "src_ip", "dst_ip", "src_as", "dst_as", "protocol", "src_port", "dst_port", "ip_version"]

EXPORT_COLUMNS = [
    "ts", "link_tag", "src_ip", "dst_ip", "src_as", "dst_as", "protocol", "protocol_name", "src_port", "dst_port",
    "service", "tcp_flags", "ip_version", "bytes", "packets", "flow_count",
]


def search_flows(log: DataFrame, f: FlowFilters) -> DataFrame:
    grouped = forensic(log, f).groupBy(*TUPLE).agg(
        F.min("ts").alias("ts"), F.min("tcp_flags").alias("tcp_flags"),
        F.sum("bytes").alias("total_bytes"), F.sum("packets").alias("total_packets"),
        F.sum("flow_count").alias("total_flows"),
    )
    if f.min_bytes > 0:
        grouped = grouped.filter(F.col("total_bytes") >= f.min_bytes)
    first = "ts" if f.order_by == "ts" else "total_bytes"
    ordered = grouped.orderBy(F.desc(first), *TUPLE)
    page = ordered.offset(f.offset) if f.offset else ordered
    return page if f.limit is None else page.limit(f.limit)


def decorate(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"protocol_name": protocol_name("protocol"), "service": service_name("protocol", "dst_port")}
    )


def export_rows(rows: DataFrame) -> DataFrame:
    """The 16 export columns with RFC 3339 times."""
    named = decorate(rows).withColumnsRenamed(
        {"total_bytes": "bytes", "total_packets": "packets", "total_flows": "flow_count"}
    )
    stamped = named.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return stamped.select(*EXPORT_COLUMNS)
