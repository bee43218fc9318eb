"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netweir.operators import alerts as al
from netweir.plans import rollup as ro
from netweir.plans.sizing import scratch_dir
from netweir.sources import netflow
from netweir.streaming import jobs, state

from .test_decode import FIELDS, RECORD, flowset, template, v9

T0 = datetime(2024, 1, 1)


def make_flows(spark, n=600):
    rows = [(T0 + timedelta(seconds=37 * i), "l1" if i % 3 else "", "in" if i % 2 else "out", 100 + i % 7, 200 + i % 5, 4, 10 * i, i, 10) for i in range(n)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, link_tag string, direction string, src_as long, dst_as long, ip_version int, bytes long, packets long, sampling_rate int")


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def source(spark):
    path = scratch_dir(spark, "flows-src")
    df = make_flows(spark)
    df.repartition(6).write.parquet(path)
    return path, df


def test_partials_build_merge_and_coarsen_agree(spark):
    flows = make_flows(spark)
    five, hour = ro.ROLLUPS["traffic_by_as"], ro.ROLLUPS["traffic_by_as_hourly"]
    built = ro.build(flows, five)
    assert rows_of(ro.merge(ro.partials(flows, five), five)) == rows_of(built)
    assert rows_of(ro.merge(built.unionByName(built.limit(0)), five)) == rows_of(built)
    assert rows_of(ro.coarsen(built, hour)) == rows_of(ro.build(flows, hour))


def test_compaction_keeps_sums_and_shrinks(spark):
    flows, spec = make_flows(spark), ro.ROLLUPS["traffic_by_link"]
    raw, packed = scratch_dir(spark, "raw"), scratch_dir(spark, "packed")
    for i in range(3):
        ro.write_partials(ro.build(flows.filter(F.col("packets") % 3 == i), spec), spec, raw)
    ro.compact(spark, spec, raw, packed)
    again = spark.read.parquet(packed).drop("dt")
    assert again.count() < spark.read.parquet(raw).count()
    assert rows_of(again) == rows_of(ro.build(flows, spec))


def test_rollup_stream_survives_replay_of_a_batch(spark, source):
    path, df = source
    spec = ro.ROLLUPS["traffic_by_as"]
    root, ckpt = scratch_dir(spark, "roll"), scratch_dir(spark, "ckpt")
    stream = jobs.read_stream(spark, path, df.schema, max_files=2)
    jobs.rollup_stream(stream, [spec], root, ckpt).awaitTermination()
    want = rows_of(ro.build(df, spec))
    assert rows_of(jobs.read_rollup(spark, root, spec)) == want
    # A batch that is delivered twice replaces itself.
    stored = spark.read.parquet(f"{root}/{spec.name}")
    first = stored.filter("batch_id = 0").drop("batch_id", "dt").collect()
    ro.write_partials(spark.createDataFrame(first, ro.build(df, spec).schema), spec, f"{root}/{spec.name}", 0)
    assert rows_of(jobs.read_rollup(spark, root, spec)) == want


def test_windowed_rollup_emits_closed_windows_equal_to_batch(spark, source):
    path, df = source
    spec = ro.ROLLUPS["traffic_by_as_hourly"]
    out, ckpt = scratch_dir(spark, "win"), scratch_dir(spark, "win-ckpt")
    rows = jobs.windowed_rollup(jobs.read_stream(spark, path, df.schema), spec, "0 seconds")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = rows_of(spark.read.schema(rows.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    want = rows_of(ro.build(df, spec))
    assert got and set(got) <= set(want) and len(got) > len(want) // 2


def test_sliding_rates(spark):
    path, out, ckpt = (scratch_dir(spark, n) for n in ("min", "min-out", "min-ckpt"))
    minutes = spark.createDataFrame([(T0 + timedelta(minutes=i), "10.0.0.1", 6000, 60) for i in range(10)], "ts timestamp_ntz, dst_ip string, bytes long, packets long")
    minutes.write.parquet(path)
    rates = jobs.sliding_rates(jobs.read_stream(spark, path, minutes.schema), 60, 30, "0 seconds")
    rates.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    full = [r for r in spark.read.schema(rates.schema).parquet(out).collect()]
    assert full and {r.bps for r in full} == {800.0}


def test_alert_state_equals_batch_lifecycle(spark):
    path, out, ckpt = (scratch_dir(spark, n) for n in ("ticks", "events", "events-ckpt"))
    seconds = [0, 30, 60, 600, 630, 2000, 9000]
    rows = [("r", f"t{k}", T0 + timedelta(seconds=s + 30 * k), float(s), 900) for k in range(3) for s in seconds]
    ticks = spark.createDataFrame(rows, "rule_id string, target string, tick timestamp_ntz, metric_value double, cooldown_seconds int")
    ticks.coalesce(1).write.parquet(path)
    events = state.alert_events(jobs.read_stream(spark, path, ticks.schema))
    events.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(events.schema).parquet(out).collect()
    opened = sorted((e.target, e.triggered_at) for e in got if e.event == "opened")
    batch = al.lifecycle(ticks, T0 + timedelta(seconds=9100)).collect()
    assert opened == sorted((a.target, a.triggered_at) for a in batch)
    assert sum(e.event == "heartbeat" for e in got) == sum(a.heartbeats for a in batch)
    resolved = sorted((e.target, e.at) for e in got if e.event == "resolved")
    assert resolved == sorted((a.target, a.resolved_at) for a in batch if a.status == "resolved")


def test_template_state_keeps_templates_between_batches(spark):
    path, out, ckpt = (scratch_dir(spark, n) for n in ("dg", "dg-out", "dg-ckpt"))
    from .test_decode import datagrams

    first = datagrams(spark, v9(flowset(0, template(256, FIELDS)), seq=1))
    second = datagrams(spark, v9(flowset(256, RECORD * 2), seq=2), v9(flowset(256, RECORD), seq=3))
    for i, part in enumerate((first, second)):
        part.coalesce(1).write.mode("append").parquet(path)
        sets = netflow.export_sets(jobs.read_stream(spark, path, first.schema, max_files=1))
        matched = state.match_templates_stream(sets)
        matched.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    rows = netflow.read_records(spark.read.schema(matched.schema).parquet(out), "netflow9").collect()
    assert len(rows) == 3 and {r.bytes for r in rows} == {1234}


def drained(rows, out, ckpt):
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def test_template_state_of_an_idle_exporter_goes(spark):
    """Stale and late templates do not match, versions match by arrival, and a silent exporter leaves no state."""
    from .test_decode import datagrams

    path, out, ckpt = (scratch_dir(spark, n) for n in ("idle", "idle-out", "idle-ckpt"))
    swapped = [FIELDS[1], FIELDS[0], *FIELDS[2:]]
    idle = datagrams(spark, v9(flowset(0, template(256, FIELDS)), seq=1), v9(flowset(256, RECORD), seq=2), gap=1800, router="10.0.0.1")
    stale = datagrams(spark, v9(flowset(0, template(256, FIELDS)), seq=1), v9(flowset(256, RECORD), seq=2), gap=1801, router="10.0.0.2")
    busy = datagrams(spark, *(v9(flowset(0, template(256, FIELDS if i % 2 else swapped)), flowset(256, RECORD * 3), seq=i) for i in range(10)), gap=1500, router="10.0.0.3")
    data = idle.unionByName(stale).unionByName(busy)
    data.coalesce(1).write.parquet(path)
    matched = state.match_templates_stream(netflow.export_sets(jobs.read_stream(spark, path, data.schema)))
    rows = netflow.read_records(drained(matched, out, ckpt), "netflow9")
    batch = netflow.decode_netflow_v9(data)
    columns = ["router_ip", "timestamp", "src_ip", "dst_ip", "bytes", "protocol"]
    assert rows_of(rows.select(columns)) == rows_of(batch.select(columns))
    assert {r.router_ip: r["count"] for r in rows.groupBy("router_ip").count().collect()} == {"10.0.0.1": 1, "10.0.0.3": 30}
    held = spark.read.format("statestore").option("stateVarName", state.TEMPLATES).load(ckpt).select("key.router_ip").distinct().collect()
    assert [r.router_ip for r in held] == ["10.0.0.3"]


def test_templates_are_walked_once(spark):
    from .test_decode import datagrams

    plan = netflow.decode_netflow_v9(datagrams(spark, b""))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan


def test_sliding_alerts_equal_batch_lifecycle(spark):
    """Sliding sums and alert state chained in one query, over three batches in the order of time."""
    from netweir.functions.addr import to_ip16
    from netweir.operators import detect as de

    rule = de.Rule("r", "volume_in", threshold_bps=1000, window_seconds=120, cooldown_seconds=900, prefixes=("10.0.0.0/8",))
    rows = [(T0 + timedelta(minutes=m), f"10.0.0.{k}", b * 60 * 125, 1) for k in (1, 2) for m, b in ((0, 3), (1, 9), (2, 0), (40, 5), (41, 5), (47, 20), (300 + k, 7))]
    rows += [(T0, "192.0.2.1", 10**9, 1), (T0 + timedelta(days=2), "10.0.0.9", 0, 0)]
    minutes = spark.createDataFrame(rows, "ts timestamp_ntz, dst_ip string, bytes long, packets long").withColumn("dst_ip16", to_ip16("dst_ip"))
    path, out, ckpt = (scratch_dir(spark, n) for n in ("slide", "slide-out", "slide-ckpt"))
    for a, b in ((0, 30), (30, 200), (200, 10**5)):
        minutes.filter(f"ts >= TIMESTAMP_NTZ '2024-01-01' + INTERVAL '{a}' MINUTE AND ts < TIMESTAMP_NTZ '2024-01-01' + INTERVAL '{b}' MINUTE").coalesce(1).write.mode("append").parquet(path)
    events = state.sliding_alerts(jobs.read_stream(spark, path, minutes.schema, max_files=1), rule)
    end = T0 + timedelta(days=3)
    got = al.alerts_of_events(drained(events, out, ckpt), end)
    want = al.lifecycle(de.sliding_ticks(minutes, rule), end)
    assert rows_of(got) == rows_of(want) and want.count() >= 4


def test_ingest_counts_and_dead_letters(spark):
    from .test_decode import datagrams, v5

    path, root, ckpt = (scratch_dir(spark, n) for n in ("gram", "ingest", "ingest-ckpt"))
    good, bad = [v5(3), v5(5)], [v5(2, cut=5), b"", v5(1, version=9)]
    data = datagrams(spark, *good, *bad)
    data.repartition(3).write.parquet(path)
    jobs.ingest_v5(jobs.read_stream(spark, path, data.schema, max_files=1), root, ckpt).awaitTermination()
    counted = jobs.read_counters(spark, root).first().asDict()
    assert counted == {"received": 5, "decode_errors": 3, "written": 8, "clamped": 8}  # exported in 2023, received in 2024
    assert sorted(r.error for r in spark.read.parquet(f"{root}/dead_letters").collect()) == ["short header", "truncated", "wrong version"]
    assert spark.read.parquet(f"{root}/flows").count() == 8
    jobs.ingest_v5(jobs.read_stream(spark, path, data.schema, max_files=1), root, ckpt).awaitTermination()  # nothing new
    assert jobs.read_counters(spark, root).first().asDict() == counted


def test_counters_are_observed(spark):
    from pyspark.sql import Observation

    seen = Observation("ingest")
    df = spark.range(10).withColumn("clamped", F.col("id") < 3)
    df.observe(seen, F.count("*").alias("received"), F.count(F.when(F.col("clamped"), 1)).alias("clamped")).count()
    counted = jobs.ingest_counters(df).first()
    assert seen.get == {"received": counted.received, "clamped": counted.clamped} == {"received": 10, "clamped": 3}
    assert jobs.with_counters(df).count() == 10
