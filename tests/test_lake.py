"""The stored lake: one file a small day, the same reads as over the flows."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netweir.functions.addr import to_ip16
from netweir.plans import rollup as ro
from netweir.plans.lake import Lake, store_rollups
from netweir.plans.sizing import scratch_dir
from netweir.sources import tables

T0 = datetime(2024, 1, 1)
NAMES = ("traffic_by_link", "traffic_by_link_hourly", "traffic_by_link_daily", "traffic_by_dst_1min")


@pytest.fixture
def uncoalesced(spark):
    """Every task of a shuffle writes, as on large tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def make_flows(spark, days=6, a_day=48):
    i = F.col("id")
    rows = spark.range(days * a_day).select(
        i.alias("flow_id"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=i * (86400 // a_day))).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("10.255.0."), (1 + i % 2).cast("string")).alias("router_ip"), F.lit("core").alias("link_tag"),
        F.when(i % 2 == 0, "in").otherwise("out").alias("direction"), F.concat(F.lit("192.0.2."), (i % 7).cast("string")).alias("src_ip"),
        F.concat(F.lit("203.0.3."), (i % 5).cast("string")).alias("dst_ip"), F.lit(4).alias("ip_version"), (i % 3).alias("src_as"), (i % 4).alias("dst_as"),
        F.lit("").alias("src_prefix"), F.lit("").alias("dst_prefix"), F.lit(6).alias("protocol"), F.lit(1024).alias("src_port"), F.lit(80).alias("dst_port"),
        F.lit(2).alias("tcp_flags"), (i + 1).alias("bytes"), F.lit(1).cast("long").alias("packets"), F.lit(1).alias("sampling_rate"),
        F.lit(1).cast("long").alias("in_interface"), F.lit(2).cast("long").alias("out_interface"), F.lit("netflow9").alias("flow_type"))
    return rows.withColumns({"src_ip16": to_ip16("src_ip"), "dst_ip16": to_ip16("dst_ip")})


def files(path):
    return {d: sum(f.endswith(".parquet") for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("dt=")}


def as_set(df):
    return sorted(map(str, df.collect()))


def test_a_small_day_is_one_file_of_each_table(spark, uncoalesced):
    flows, root = make_flows(spark), scratch_dir(spark, "lake")
    tables.write_flows(flows, f"{root}/flows")
    store_rollups(flows, root, [ro.ROLLUPS[n] for n in NAMES])
    for name in ("flows", *NAMES):
        assert files(f"{root}/{name}") == {f"dt=2024-01-{d:02d}": 1 for d in range(1, 7)}, name
    ro.compact(spark, ro.ROLLUPS["traffic_by_link"], f"{root}/traffic_by_link", f"{root}/packed")
    assert set(files(f"{root}/packed").values()) == {1}
    lake = Lake.open(spark, root, NAMES)
    assert lake["flows"].count() == flows.count()
    for name in NAMES:
        spec = ro.ROLLUPS[name]
        assert as_set(lake[name].drop("dt").select(*spec.group_keys, *spec.sums)) == as_set(ro.build(flows, spec).select(*spec.group_keys, *spec.sums)), name


def test_a_large_day_is_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        flows, root = make_flows(spark, 1, 14_400).repartition(8), scratch_dir(spark, "day")
        tables.write_flows(flows, root)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert files(root)["dt=2024-01-01"] > 1
    assert spark.read.parquet(root).count() == 14_400


def test_a_lake_lists_only_the_tables_it_reads(spark):
    flows, root = make_flows(spark, 1), scratch_dir(spark, "lake")
    store_rollups(flows, root, [ro.ROLLUPS["traffic_by_link"]])
    assert Lake.open(spark, root)["traffic_by_link"].count() > 0
