"""Versioned dimension and config tables: latest version, upsert, delete, purge, lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.timeb import instant
from ..plans.sizing import pin_if_small


def latest_versions(df: DataFrame, key: str | list[str], version: str = "updated_at", keep_deleted: bool = False):
    """Newest row per key; tombstones are dropped.  One map-side combined aggregate, no sort."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    # Struct order makes equal versions deterministic: version first, then the other columns.
    ordered = [version] + [c for c in rest if c != version]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("v"))
    out = newest.select(*keys, "v.*").select(*df.columns)
    return out.filter(F.col("deleted") == 0) if "deleted" in df.columns and not keep_deleted else out


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Current row of one key: the filter is applied before the version aggregate."""
    return latest_versions(df.filter(F.col(key) == value), key)


def upsert(df: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions are appended; readers take the latest."""
    return df.unionByName(changes, allowMissingColumns=True)


def soft_delete(df: DataFrame, key: str, values: list, at: datetime) -> DataFrame:
    """Append a tombstone copy of the current version of the given keys."""
    doomed = latest_versions(df.filter(F.col(key).isin(values)), key)
    stones = doomed.withColumn("deleted", F.lit(1)).withColumn("updated_at", instant(at))
    return df.unionByName(stones)


def purge_tombstones(df: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Drop tombstone rows older than N days (the table is rewritten with what is left)."""
    if days < 1:
        raise ValueError("days must be at least 1")
    cutoff = instant(as_of) - F.make_dt_interval(F.lit(days))
    return df.filter(~((F.col("deleted") == 1) & (F.col("updated_at") < cutoff)))


def hard_delete(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(~F.col(key).eqNullSafe(F.lit(value)))


def current_links(links: DataFrame) -> DataFrame:
    return latest_versions(links, "tag")


def link_dim(links: DataFrame) -> DataFrame:
    return pin_if_small(current_links(links))


def as_dim(as_names: DataFrame) -> DataFrame:
    """Current AS names, broadcast when small enough (about 100k public ASNs exist)."""
    dim = latest_versions(as_names, "as_number").select("as_number", "as_name", "country")
    return pin_if_small(dim)


def with_as_info(df: DataFrame, as_dim: DataFrame, column: str = "as_number") -> DataFrame:
    """Left join on the current AS dimension; a miss gives '' (never NULL)."""
    dim = as_dim.withColumnRenamed("as_number", "_asn")
    joined = df.join(dim, F.col(column) == F.col("_asn"), "left").drop("_asn")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("as_name", "country")})


def with_link_info(df: DataFrame, links: DataFrame) -> DataFrame:
    dim = links.select(F.col("tag").alias("_tag"), "description", "capacity_mbps")
    joined = df.join(dim, F.col("link_tag") == F.col("_tag"), "left").drop("_tag")
    return joined.withColumns(
        {
            "description": F.coalesce("description", F.lit("")),
            "capacity_mbps": F.coalesce(F.col("capacity_mbps"), F.lit(0)).cast("long"),
        }
    )


def search_as(as_dim: DataFrame, text: str, limit: int) -> DataFrame:
    """Substring search on the number's digits or the lower-cased name."""
    q = text.lower()
    hit = F.col("as_number").cast("string").contains(q) | F.lower("as_name").contains(q)
    return as_dim.filter(hit).select("as_number", "as_name", "country").orderBy("as_number").limit(limit)
