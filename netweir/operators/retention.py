"""Retention catalogue, policy seeding, divergence and enforcement."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeb import instant

# Table -> (time column, days kept).
CATALOGUE = {
    "flows_raw": ("timestamp", 3),
    "traffic_by_as": ("ts", 90),
    "traffic_by_as_hourly": ("ts", 730),
    "traffic_by_as_daily": ("ts", 1825),
    "traffic_by_link": ("ts", 90),
    "traffic_by_link_hourly": ("ts", 730),
    "traffic_by_link_daily": ("ts", 1825),
    "traffic_by_ip": ("ts", 14),
    "traffic_by_ip_as": ("ts", 14),
    "traffic_by_prefix": ("ts", 30),
    "flows_log": ("ts", 180),
    "traffic_by_port": ("ts", 365),
    "traffic_by_dst_1min": ("ts", 7),
    "traffic_by_src_1min": ("ts", 7),
    "alerts": ("triggered_at", 365),
    "audit_log": ("ts", 365),
    "bgp_blocks": ("blocked_at", 365),
}


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(t, c, d) for t, (c, d) in CATALOGUE.items()]
    return spark.createDataFrame(rows, "table_name string, ttl_column string, default_days int")


def seed_policies(policies: DataFrame, live: DataFrame, flow_log_days: int = 0) -> DataFrame:
    """Policies for managed tables that have none: the live retention if known, else the default."""
    known = catalogue(policies.sparkSession)
    missing = known.join(policies, "table_name", "left_anti").join(live, "table_name", "left")
    days = F.coalesce(F.when(F.col("live_days") > 0, F.col("live_days")), F.col("default_days"))
    if flow_log_days > 0:
        days = F.when(F.col("table_name") == "flows_log", F.lit(flow_log_days)).otherwise(days)
    return missing.select("table_name", "ttl_column", days.cast("int").alias("ttl_days"), F.lit(1).alias("enabled"))


def diverging(policies: DataFrame, live: DataFrame) -> DataFrame:
    """Enabled policies of existing managed tables whose live retention differs."""
    known = catalogue(policies.sparkSession).select("table_name")
    wanted = policies.filter(F.col("enabled") == 1).join(known, "table_name", "left_semi")
    return wanted.join(live, "table_name").filter(F.col("ttl_days") != F.col("live_days"))


def retained(df: DataFrame, column: str, days: int, as_of: datetime) -> DataFrame:
    """Rows still inside the retention; a ``dt`` partition column prunes whole days."""
    cutoff = as_of - timedelta(days=days)
    if "dt" in df.columns:
        df = df.filter(F.col("dt") >= F.lit(cutoff.date()))
    return df.filter(F.col(column) >= instant(cutoff))


def enforce(tables: Mapping[str, DataFrame], as_of: datetime, days: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """What each managed table keeps, by its own policy where ``days`` has one, else by the catalogue."""
    kept = {}
    for name, (column, default) in CATALOGUE.items():
        if name in tables:
            kept[name] = retained(tables[name], column, (days or {}).get(name, default), as_of)
    return kept


def storage_stats(tables: dict[str, tuple[DataFrame, str]], policies: DataFrame) -> DataFrame:
    """Bytes, files, rows and time span per table, next to its retention policy.

    Each table is a file-based scan: bytes and files come from the scan's own file metadata.
    """
    parts = None
    for name, (df, column) in tables.items():
        per_file = df.groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).agg(
            F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
        )
        part = per_file.agg(
            F.lit(name).alias("table_name"), F.sum("size").alias("bytes"), F.count("*").alias("files"),
            F.sum("n").alias("row_count"), F.min("lo").alias("oldest"), F.max("hi").alias("newest"),
        )
        parts = part if parts is None else parts.unionByName(part)
    kept = policies.select("table_name", "ttl_days", F.col("enabled").alias("ttl_enabled"))
    return parts.join(kept, "table_name", "left")
