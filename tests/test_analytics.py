"""Numeric operators against the expected values of their specification and brute force."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netweir.operators import capacity as cap, detect as de, series
from netweir.operators.dims import latest_versions
from netweir.operators.retention import CATALOGUE, catalogue


def samples(spark, values):
    return spark.createDataFrame([("l", float(v)) for v in values], "link_tag string, bps double")


@pytest.mark.parametrize("values, k, want", [([10, 10, 10, 10], 2.5, 10), ([1, 2, 3, 4, 5], 2.5, 3 + 2.5 * 1.4826), ([4, 1, 3, 2], 0, 2.5), ([5], 0, 5)])
def test_median_mad(spark, values, k, want):
    rows = samples(spark, values).withColumn("is_current", F.lit(False))
    assert de.median_mad(rows, k).first().baseline == pytest.approx(want)


@pytest.mark.parametrize("current, history, fires", [(300, [100] * 6, True), (121, [100] * 6, True), (110, [100] * 6, False), (50, [100] * 6, False),
                                                     (300, [100] * 3, False), (300, [0] * 6, False)])
def test_anomaly_decision(spark, current, history, fires):
    rows = samples(spark, history).withColumn("is_current", F.lit(False)).unionByName(samples(spark, [current]).withColumn("is_current", F.lit(True)))
    assert de.anomaly_decision(de.median_mad(rows, 2.5)).first().fires == fires


@pytest.mark.parametrize("values, slope, intercept", [([100 + 100 * i for i in range(10)], 100, 100), ([5] * 4, 0, 5)])
def test_trend(spark, values, slope, intercept):
    start = datetime(2024, 1, 1)
    rows = [("l", (start + timedelta(days=3 * i)).date(), float(v)) for i, v in enumerate(values)]
    fit = cap.trend(spark.createDataFrame(rows, "link_tag string, day date, bps double")).first()
    assert (fit.slope, fit.intercept) == (pytest.approx(slope), pytest.approx(intercept))


def test_trend_needs_two_days(spark):
    assert cap.trend(spark.createDataFrame([("l", datetime(2024, 1, 1).date(), 5.0)], "link_tag string, day date, bps double")).count() == 0


def test_days_to_level(spark):
    cases = [(100.0, 100.0, 9.0, 1500.0, 5.0), (100.0, 100.0, 9.0, 1000.0, 0.0), (100.0, 100.0, 9.0, 900.0, 0.0), (0.0, 100.0, 9.0, 900.0, None), (-1.0, 5.0, 9.0, 9.0, None)]
    df = spark.createDataFrame(cases, "s double, b double, x double, level double, want double")
    for row in df.withColumn("got", cap.days_to_level("s", "b", "x", F.col("level"))).collect():
        assert row.got == row.want


def test_downsample(spark):
    small = [r.bps for r in cap.downsample_desc(samples(spark, [3, 1, 2])).orderBy("i").collect()]
    assert small == [3, 2, 1]
    for n, most in ((1000, 500), (501, 500), (777, 100), (2160, 500)):
        points = [r.bps for r in cap.downsample_desc(samples(spark, range(n)), most).orderBy("i").collect()]
        ordered = sorted(map(float, range(n)), reverse=True)
        assert points == [ordered[i * (n - 1) // (most - 1)] for i in range(most)]


def test_histogram(spark):
    bins = cap.histogram(samples(spark, range(100))).orderBy("bin").collect()
    assert len(bins) == 20 and sum(b.samples for b in bins) == 100 and bins[-1].upper_bps == 99
    flat = cap.histogram(samples(spark, [7] * 5)).orderBy("bin").collect()
    assert [b.samples for b in flat] == [5] + [0] * 19


def test_heatmap_grid_is_dense(spark):
    cells = spark.createDataFrame([(3, 5, 1.0, 2.0)], "day int, hour int, mean_bps double, peak_bps double")
    grid = cap.dense_heatmap(cells).orderBy("day", "hour").collect()
    assert [(g.day, g.hour) for g in grid] == [(d, h) for d in range(1, 8) for h in range(24)]
    assert [g.peak_bps for g in grid if g.peak_bps] == [2.0]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_nearest_rank(spark, n):
    values = list(range(n))[::-1]
    got = spark.createDataFrame([(v,) for v in values], "v long").agg(series.nearest_rank("v").alias("p")).first().p
    assert got == sorted(values)[int((n - 1) * 0.95)]


def test_latest_version_and_tombstones(spark):
    rows = [("a", 1, "old", 0), ("a", 2, "new", 0), ("b", 1, "x", 0), ("b", 3, "x", 1)]
    df = spark.createDataFrame(rows, "id string, updated_at int, name string, deleted int")
    assert [(r.id, r.name) for r in latest_versions(df, "id").collect()] == [("a", "new")]


def test_retention_catalogue(spark):
    rows = {r.table_name: (r.ttl_column, r.default_days) for r in catalogue(spark).collect()}
    assert len(rows) == 17 and rows == CATALOGUE
    assert rows["flows_raw"] == ("timestamp", 3) and rows["alerts"] == ("triggered_at", 365)


def test_gap_fill_inserts_zero_points(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("l", t0 + timedelta(minutes=m), 1, 1, 1, 1) for m in (0, 1, 10)]
    df = spark.createDataFrame(rows, "link_tag string, period timestamp_ntz, bytes_in long, bytes_out long, packets_in long, packets_out long")
    out = series.gap_fill(df, 60).filter("inserted").orderBy("period").collect()
    assert [r.period for r in out] == [t0 + timedelta(minutes=2), t0 + timedelta(minutes=9)]
    assert series.infer_interval(df).first().interval_seconds == 60


def test_longest_prefix_is_one_join(spark):
    import ipaddress
    import random

    from netweir.functions.addr import to_ip16
    from netweir.operators import enrich

    rnd = random.Random(5)
    nets = {str(ipaddress.ip_network(f"10.{rnd.randint(0, 3)}.{rnd.randint(0, 255)}.0/{rnd.choice([8, 14, 16, 20, 24])}", strict=False)) for _ in range(80)}
    nets |= {"2001:db8::/32", "2001:db8:1::/48"}
    hosts = [f"10.{rnd.randint(0, 4)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}" for _ in range(200)] + ["2001:db8:1::5", "2001:db8:2::5", "192.0.2.1"]
    table = enrich.prefix_table(spark.createDataFrame([(n,) for n in nets], "px string"), "px")
    flows = spark.createDataFrame([(h,) for h in hosts], "ip string").withColumn("ip16", to_ip16("ip"))

    def best(host):
        hits = [n for n in map(ipaddress.ip_network, nets) if ipaddress.ip_address(host) in n]
        return str(max(hits, key=lambda n: n.prefixlen)) if hits else None

    want = sorted((h, best(h)) for h in hosts)
    key = lambda r: (r[0], r[1] or "")
    got = [(r.ip, r.matched_prefix) for r in enrich.match_prefixes(flows, "ip16", table).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    plan = enrich.match_prefixes(flows, "ip16", table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # the match and the way back to the rows
