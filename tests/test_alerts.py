import random
from datetime import datetime, timedelta

import pytest


from netweir.operators import alerts as al, detect as de

T0 = datetime(2024, 1, 1)


def brute_force(ticks, end, stale, cooldown, tick):
    """Independent simulation on the evaluation grid: every cycle first resolves, then handles violations."""
    alerts, active, last_trigger = [], {}, {}
    times = sorted({t for _, t in ticks})
    t = min(times)
    pending = {}
    for key, when in ticks:
        pending.setdefault(when, []).append(key)
    while t <= end:
        for key, a in list(active.items()):
            if a["seen"] < t - stale:
                a.update(status="resolved", resolved=t)
                del active[key]
        for key in pending.get(t, []):
            if key in active:
                active[key]["seen"] = t
            elif key not in last_trigger or t - last_trigger[key] >= cooldown:
                a = {"key": key, "start": t, "seen": t, "status": "active", "resolved": None}
                alerts.append(a)
                active[key] = a
                last_trigger[key] = t
        t += tick
    return sorted((a["key"], a["start"], a["seen"], a["status"], a["resolved"]) for a in alerts)


@pytest.mark.parametrize("seed, cooldown", [(1, 300), (2, 1800), (3, 30), (4, 900)])
def test_lifecycle_matches_simulation(spark, seed, cooldown):
    rnd = random.Random(seed)
    ticks = sorted({(f"10.0.0.{k}", 30 * rnd.randint(0, 400)) for k in range(4) for _ in range(60)})
    rows = [("r", target, T0 + timedelta(seconds=s), 1.0, cooldown) for target, s in ticks]
    df = spark.createDataFrame(rows, "rule_id string, target string, tick timestamp_ntz, metric_value double, cooldown_seconds int")
    end = 30 * 500
    got = al.lifecycle(df, T0 + timedelta(seconds=end)).collect()
    secs = lambda t: None if t is None else int((t - T0).total_seconds())
    mine = sorted((r.target, secs(r.triggered_at), secs(r.last_seen_at), r.status, secs(r.resolved_at)) for r in got)
    assert mine == brute_force(ticks, end, 300, cooldown, 30)


def test_acknowledged_alert_no_longer_dedups(spark):
    rows = [("r", "t", T0, 1.0, 60, "violation"), ("r", "t", T0 + timedelta(seconds=30), 0.0, 60, "acknowledge"),
            ("r", "t", T0 + timedelta(seconds=45), 1.0, 60, "violation"), ("r", "t", T0 + timedelta(seconds=90), 1.0, 60, "violation")]
    df = spark.createDataFrame(rows, "rule_id string, target string, tick timestamp_ntz, metric_value double, cooldown_seconds int, action string")
    got = sorted((r.status, r.triggered_at) for r in al.lifecycle(df, T0 + timedelta(seconds=120)).collect())
    assert got == [("acknowledged", T0), ("active", T0 + timedelta(seconds=90))]


def test_severity_matrix(spark):
    names = ["info", "warning", "critical"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for row in df.withColumn("ok", al.severity_rank("a") >= al.severity_rank("b")).collect():
        assert row.ok == (names.index(row.a) >= names.index(row.b))


def test_blocks_skip_already_active_and_labels(spark):
    alerts = spark.createDataFrame(
        [("1", "r", "x", "active", "ip", "10.0.0.1", T0, 5.0), ("2", "r", "x", "active", "ip", "10.0.0.2", T0, 5.0), ("3", "r", "x", "active", "label", "transit", T0, 5.0),
         ("4", "q", "x", "active", "ip", "10.0.0.3", T0, 5.0)],
        "id string, rule_id string, rule_name string, status string, target_kind string, target string, triggered_at timestamp_ntz, metric_value double")
    alerts = alerts.selectExpr("*", "'bps' AS metric_type", "4.0D AS threshold", "array('1.1.1.1', '2.2.2.2') AS top_sources")
    rules = spark.createDataFrame([("r", "auto_block"), ("q", "notify")], "rule_id string, action string")
    blocks = spark.createDataFrame([("10.0.0.2", "active"), ("10.0.0.1", "withdrawn")], "ip string, status string")
    rows = al.block_candidates(alerts, rules, blocks, T0).collect()
    assert [r.ip for r in rows] == ["10.0.0.1"] and rows[0].expires_at == T0 + timedelta(hours=1)
    assert rows[0].description == "Auto-blocked by rule 'x': 5.00 bps exceeded threshold 4.00. Top sources: 1.1.1.1, 2.2.2.2"


def test_scope_falls_back_to_global(spark):
    rules = spark.createDataFrame([("a", "hg1", ""), ("b", "gone", "9.9.9.9/32"), ("c", "", "8.8.8.8/32"), ("d", "", "")], "rule_id string, hostgroup_id string, target_filter string")
    groups = spark.createDataFrame([("hg1", ["1.0.0.0/8", "2.0.0.0/8"])], "id string, cidrs array<string>")
    got = {}
    for r in de.resolve_scopes(rules, groups, ["10.0.0.0/8"]).collect():
        got.setdefault(r.rule_id, set()).add(r.cidr)
    assert got == {"a": {"1.0.0.0/8", "2.0.0.0/8"}, "b": {"10.0.0.0/8"}, "c": {"8.8.8.8/32"}, "d": {"10.0.0.0/8"}}


def test_rule_catalogue(spark):
    rows = de.default_rules(spark).collect()
    assert len(rows) == 15 and sum(not r.enabled for r in rows) == 1
    assert {r.rule_type for r in rows} == set(de.METRIC_TYPES)


def test_details_leave_empty_members_out(spark):
    df = spark.createDataFrame([(["1.1.1.1"], 3, 60), ([], 0, 60)], "top_sources array<string>, unique_count long, window_seconds int")
    got = sorted(r.d for r in df.select(al.details_json().alias("d")).collect())
    assert got == ['{"top_sources":["1.1.1.1"],"unique_count":3,"window_seconds":60}', '{"window_seconds":60}']


def test_sketch_rules_agree_with_exact(spark):
    from netweir.plans import rollup as ro

    rows = [(T0, f"10.0.0.{i % 3}", f"192.0.2.{i % 90}", 6, 2, i % 500, i % 200, 100, 1, 1) for i in range(3000)]
    flows = spark.createDataFrame(rows, "timestamp timestamp_ntz, dst_ip string, src_ip string, protocol int, tcp_flags int, src_port int, dst_port int, bytes long, packets long, sampling_rate int")
    from netweir.functions.addr import to_ip16

    flows = flows.withColumns({"src_ip16": to_ip16("src_ip"), "dst_ip16": to_ip16("dst_ip")})
    spec = ro.ROLLUPS["traffic_by_dst_1min"]
    rule = de.Rule("r", "amplification", threshold_count=1, window_seconds=3600)
    as_of = T0 + timedelta(minutes=5)
    run = lambda t, exact: {r.target: r.unique_count for r in de.evaluate_rules([rule], {"traffic_by_dst_1min": t}, None, as_of, exact=exact).collect()}
    exact, sketch = run(ro.partials(flows, spec), True), run(ro.build(flows, spec), False)
    assert exact.keys() == sketch.keys() and len(exact) == 3
    for target, n in exact.items():
        assert abs(sketch[target] - n) <= max(1, 0.05 * n)


def test_every_violation_is_kept_and_a_cut_is_asked_for(spark):
    from netweir.functions.addr import to_ip16

    rows = [(T0, f"10.{i // 250}.0.{i % 250}", 6, 10**6 + i, 1, 1, 0) for i in range(400)]
    table = spark.createDataFrame(rows, "ts timestamp_ntz, dst_ip string, protocol int, bytes long, packets long, flow_count long, syn_count long")
    table = table.withColumn("dst_ip16", to_ip16("dst_ip"))
    rule = de.Rule("r", "volume_in", threshold_bps=1, window_seconds=60)
    run = lambda **kw: de.evaluate_rules([rule], {"traffic_by_dst_1min": table}, None, T0, **kw)
    assert run().count() == 400
    assert {r.metric_value for r in run(max_targets=3).collect()} == {(10**6 + i) * 8 / 60 for i in (397, 398, 399)}


def test_subnet_rules_share_one_scan(spark):
    from netweir.functions.addr import to_ip16

    rows = [(T0, f"10.1.{i // 200}.{i % 200}", 1000, 2) for i in range(800)]
    table = spark.createDataFrame(rows, "ts timestamp_ntz, dst_ip string, bytes long, packets long").withColumn("dst_ip16", to_ip16("dst_ip"))
    rules = [de.Rule(f"r{n}", "subnet_flood", threshold_bps=1, window_seconds=60, subnet_prefix_len=n, prefixes=("10.0.0.0/8",)) for n in (16, 24, 25)]
    rules.append(de.Rule("none", "subnet_flood", threshold_bps=1, window_seconds=60, prefixes=("192.0.2.0/24",)))
    found = de.evaluate_rules(rules, {"traffic_by_dst_1min": table}, None, T0)
    got = sorted((r.rule_id, r.target, r.metric_value) for r in found.collect())
    assert [x for x in got if x[0] == "r16"] == [("r16", "10.1.0.0", 800 * 1000 * 8 // 60)]
    assert len([x for x in got if x[0] == "r24"]) == 4 and len([x for x in got if x[0] == "r25"]) == 8 and not [x for x in got if x[0] == "none"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + found._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_transitions_and_withdrawals_leave_other_rows_alone(spark):
    alerts = spark.createDataFrame([("a", "acknowledged", "eve", T0, None), ("b", "active", None, None, None)], "id string, status string, acknowledged_by string, acknowledged_at timestamp_ntz, resolved_at timestamp_ntz")
    done = al.transition(alerts, "id = 'b'", "resolved", T0)
    got = {r.id: r for r in al.apply_transitions(alerts, done).collect()}
    assert (got["a"].status, got["a"].acknowledged_by, got["a"].acknowledged_at) == ("acknowledged", "eve", T0)
    assert (got["b"].status, got["b"].resolved_at) == ("resolved", T0)
    blocks = spark.createDataFrame([("1", "x", "withdrawn", T0, "alice", "mistake"), ("2", "x", "active", None, None, None)], "id string, ip string, status string, unblocked_at timestamp_ntz, unblocked_by string, unblock_reason string")
    got = {r.id: r for r in al.withdraw(blocks, "x", T0, "bob", "over").collect()}
    assert (got["1"].unblocked_by, got["1"].unblock_reason, got["2"].unblocked_by, got["2"].status) == ("alice", "mistake", "bob", "withdrawn")


def test_top_sources_follow_each_alerts_own_window(spark):
    flows = spark.createDataFrame([(T0 - timedelta(seconds=30), "t", "s2", 1, 1, 1), (T0 - timedelta(seconds=900), "t", "s1", 9, 1, 1)], "timestamp timestamp_ntz, dst_ip string, src_ip string, bytes long, packets long, sampling_rate int")
    opened = spark.createDataFrame([("r60", "t", "ip", 60), ("r7200", "t", "ip", 7200), ("r", "label", "label", 60)], "rule_id string, target string, target_kind string, window_seconds int")
    got = {r.rule_id: r.top_sources for r in al.with_top_sources(opened, flows, T0).collect()}
    assert got == {"r60": ["s2"], "r7200": ["s1", "s2"], "r": []}


@pytest.mark.parametrize("seed,cooldown,stale", [(1, 900, 300), (2, 5000, 300), (3, 0, 60), (4, 250, 300)])
def test_lifecycle_equals_the_state_machine(spark, seed, cooldown, stale):
    """Islands and the fold against one state per key, with actions and cooldowns shorter and longer than the silence that resolves."""
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        now = 0
        for _ in range(60):
            now += rng.choice((30, 30, 30, 60, 330, 600, 1500))
            rows.append(("r", f"t{k}", T0 + timedelta(seconds=now), float(now), cooldown, rng.choice(("violation",) * 9 + ("acknowledge", "resolve"))))
    end = T0 + timedelta(seconds=12000)
    want = []
    for k in range(6):
        state, start = al.KeyState(), T0.replace(tzinfo=None)
        for _, _, at, metric, wait, action in sorted((r for r in rows if r[1] == f"t{k}"), key=lambda r: (r[2], r[5])):
            now = (at.replace(tzinfo=None) - start).total_seconds()
            if action == "violation":
                state.violate(now, metric, wait, stale, 30)
                continue
            state.expire(now, stale, 30)
            if state.triggered is not None:
                state.close("resolved" if action == "resolve" else "acknowledged", now if action == "resolve" else None)
        state.expire(12000, stale, 30)
        if state.triggered is not None:
            state.close("active", None)
        at = lambda x: None if x is None else start + timedelta(seconds=x)
        want += [(f"t{k}", at(a), at(b), at(c), d, e, f) for a, b, c, d, e, f in state.closed]
    df = spark.createDataFrame(rows, "rule_id string, target string, tick timestamp_ntz, metric_value double, cooldown_seconds int, action string")
    out = al.lifecycle(df, end, stale)
    got = [(r.target, r.triggered_at, r.last_seen_at, r.resolved_at, r.status, r.metric_value, r.heartbeats) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 12
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


FLOWS = "timestamp timestamp_ntz, src_ip string, dst_ip string, src_as long, protocol int, dst_port int, link_tag string, bytes long, packets long, sampling_rate long"


def _hour_flows(spark):
    at = T0.replace(minute=0, second=0, microsecond=0)
    rows = [(at - timedelta(minutes=1 + i % 59), f"10.0.0.{i % 3}", "192.0.2.1", 10 + i % 2, 6, 443, "up" if i % 4 else "down", 100 + i, 1, 2) for i in range(40)]
    rows += [(at - timedelta(hours=2), "10.9.9.9", "192.0.2.1", 99, 6, 80, "up", 10**9, 1, 1), (at, "10.9.9.9", "192.0.2.1", 99, 6, 80, "up", 10**9, 1, 1)]
    return rows, spark.createDataFrame(rows, FLOWS)


def test_anomaly_alerts_carry_their_links_explanation(spark):
    import json

    rows, flows = _hour_flows(spark)
    names = spark.createDataFrame([(10, "ten", "DE")], "as_number long, as_name string, country string")
    opened = spark.createDataFrame([("label", "up", "anomaly"), ("label", "idle", "anomaly"), ("label", "down", "link_capacity"), ("ip", "up", "volume_in")], "target_kind string, target string, rule_type string")
    opened = opened.selectExpr("*", "CAST(array() AS array<string>) AS top_sources", "0L AS unique_count", "3600 AS window_seconds")
    got = {(r.target, r.rule_type): json.loads(r.d) for r in al.with_explanations(opened, flows, names, T0).select("target", "rule_type", al.details_json(extra="extra").alias("d")).collect()}
    assert {k for k, d in got.items() if "extra" in d} == {("up", "anomaly")} and len(got) == 4
    entries = got["up", "anomaly"]["extra"]["explanation"]
    last = [r for r in rows[:40] if r[6] == "up"]
    whole = sum(2 * r[7] for r in last)
    for section, at in (("as", 3), ("ip", 1)):
        want = {}
        for r in last:
            want[str(r[at])] = want.get(str(r[at]), 0) + 2 * r[7]
        mine = [e for e in entries if e["section"] == section]
        assert [e["key"] for e in mine] == sorted(want, key=lambda k: (-want[k], k)) and [e["bytes"] for e in mine] == sorted(want.values(), reverse=True)
        assert all(abs(e["percent"] - 100 * e["bytes"] / whole) < 1e-9 for e in mine)


def test_top_sources_move_raw_flows_once(spark):
    """Joined by shuffle, a target's flows are summed where they met; nothing raw moves again."""
    from netweir.operators.top import top_sources

    rows, flows = _hour_flows(spark)
    targets = spark.createDataFrame([("192.0.2.1", rows[40][0])], "target string, since timestamp_ntz")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = top_sources(flows, targets, 2)
        plan = best._jdf.queryExecution().executedPlan().toString()
        got = [(r.src_ip, r.total_bytes) for r in best.orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # flows, targets, and the ranking of sums
    want = {}
    for r in rows:
        want[r[1]] = want.get(r[1], 0) + r[7] * r[9]
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2]


def test_retention_of_given_tables(spark):
    from netweir.operators import retention

    df = spark.createDataFrame([(T0 - timedelta(days=d),) for d in (0, 2, 5, 20)], "ts timestamp_ntz")
    kept = retention.enforce({"traffic_by_ip": df, "traffic_by_dst_1min": df, "not_managed": df}, T0, {"traffic_by_ip": 3})
    assert {n: t.count() for n, t in kept.items()} == {"traffic_by_ip": 2, "traffic_by_dst_1min": 3}
