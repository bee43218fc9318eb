"""Checks that keep broadcasts and driver-side lists bounded, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

BROADCAST_ROWS = 200_000
CONFIG_ROWS = 10_000


def is_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the row count is proven small; else Spark picks (AQE splits skew)."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def pin_if_small(df: DataFrame, max_rows: int = CONFIG_ROWS) -> DataFrame:
    """A config-sized dimension becomes a broadcast local relation, computed once per session use.

    Larger ones keep their plan, with a broadcast hint only under the broadcast bound.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return broadcast_if_bounded(df)


def config_rows(df: DataFrame, max_rows: int = CONFIG_ROWS) -> list[Row]:
    """Rows of an operator-maintained config table; refuses a table that is not one."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"config table has more than {max_rows} rows")
    return rows


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="netweir-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder under the cluster's shared checkpoint folder.

    Only a local master without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives executor loss."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
