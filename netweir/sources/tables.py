"""Flow table, dimension, audit and export readers/writers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from .. import schema
from ..operators.search import export_rows
from ..plans.filters import in_range
from ..plans.rollup import by_day


def read_flows(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Fixed-schema scan of day partitions; the time range prunes ``dt`` and is pushed to row groups."""
    stored = T.StructType([*schema.FLOW.fields, T.StructField("dt", T.DateType())])
    return in_range(spark.read.schema(stored).parquet(path), start, end, "timestamp")


def write_flows(flows: DataFrame, path: str, mode: str = "append") -> None:
    """Day partitions, sorted so that row-group statistics prune on time, router and AS.

    A day is one task and file; a large one is dealt over several (:func:`by_day`).
    """
    out = flows.select(*schema.FLOW.names, F.to_date("timestamp").alias("dt"))
    (
        by_day(out)
        .sortWithinPartitions("dt", "timestamp", "router_ip", "src_as", "dst_as")
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#src_ip16", "true")
        .option("parquet.bloom.filter.enabled#dst_ip16", "true")
        # Sized by the distinct values seen, so a small file does not carry a megabyte of filter.
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy("dt")
        .parquet(path)
    )


def load_as_names(names: DataFrame, path: str) -> None:
    """Bulk load = append new versions; readers take the latest per number."""
    names.select(*[F.col(f.name).cast(f.dataType) for f in schema.AS_NAME.fields]).write.mode("append").parquet(path)


def export_flows_csv(rows: DataFrame, path: str) -> int:
    """Search result -> CSV, whole; returns the rows written (a bound is the search's own ``limit``)."""
    written = Observation()
    observed = rows.observe(written, F.count(F.lit(1)).alias("n"))
    export_rows(observed).write.mode("overwrite").option("header", True).csv(path)
    return written.get["n"]


def export_table(df: DataFrame, path: str, fmt: str) -> None:
    """CSV (quoted where needed, quotes doubled) or JSON lines."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export format: {fmt!r}")


def append_audit(entries: DataFrame, path: str) -> None:
    out = entries.select(*[F.col(f.name).cast(f.dataType) for f in schema.AUDIT.fields])
    # Months, as the trail is small next to the flows: day folders would be tiny files.
    out.withColumn("month", F.trunc("ts", "month")).write.mode("append").partitionBy("month").parquet(path)


def list_audit(audit: DataFrame, start: datetime, end: datetime, user: str = "", action: str = "", limit: int = 500):
    rows = in_range(audit, start, end)
    rows = rows.filter(F.col("user_email") == user) if user else rows
    rows = rows.filter(F.col("action") == action) if action else rows
    return rows.orderBy(F.desc("ts"), "resource").limit(limit if limit > 0 else 500)


def ingest_status(flows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Per router: last flow seen and rows in the window, with the window's total rows."""
    rows = in_range(flows, start, end, "timestamp")
    per_router = rows.groupBy("router_ip").agg(F.max("timestamp").alias("last_seen"), F.count("*").alias("flow_count"))
    total = per_router.agg(F.sum("flow_count").alias("t")).scalar()
    return per_router.withColumn("total_rows", total).orderBy(F.desc("flow_count"), "router_ip")
