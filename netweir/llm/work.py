"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="llm-work-")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local master may lack that setting (as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: A setting of Spark: shuffle files go when their query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once and reads them back: no recomputation, no long lineage, safe when executors go.

    What was shuffled for it is dropped once the table stands.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def by_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, text, id): the id and text of each row, and a key that no two rows share, in the order of the ids.

    Ids that are all different are their own keys. Otherwise the rows are written once, ranged by id, and those of one id are documents of their own, shorter
    texts first (equally long ones in the order of a hash, equal ones in any). A row without an id has no key.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("string").alias("text"))
    if rows.filter("own IS NOT NULL").groupBy("own").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        return rows.withColumn("id", F.col("own"))
    place = [F.col("own").asc_nulls_last(), F.octet_length("text"), F.xxhash64("text"), F.col("dealt")]
    ranged = rows.withColumn("dealt", F.monotonically_increasing_id()).repartitionByRange(*place).sortWithinPartitions(*place).drop("dealt")
    kept = stored(ranged.withColumn("id", F.monotonically_increasing_id()), "rows")
    return kept.withColumn("id", F.when(F.col("own").isNotNull(), F.col("id")))
