"""The physical plans keep the shape they were written for."""

from datetime import datetime

import pytest

from netweir.catalog.context import context
from netweir.operators import detect as de, top
from netweir.params import QueryParams
from netweir.plans.lake import Lake, store_rollups
from netweir.plans.rollup import ROLLUPS
from netweir.plans.sizing import scratch_dir
from netweir.sources import tables

SF = "/root/testdata/sf0.001"
P = QueryParams(datetime(2024, 1, 5), datetime(2024, 1, 20))
NAMES = ("traffic_by_as", "traffic_by_ip", "traffic_by_dst_1min", "traffic_by_link_hourly")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def c(spark):
    return context(spark, SF)


@pytest.fixture(scope="module")
def lake(spark, c):
    root = scratch_dir(spark, "lake")
    tables.write_flows(c.ev["flows"], f"{root}/flows")
    store_rollups(c.ev["flows"], root, [ROLLUPS[n] for n in NAMES])
    return Lake.open(spark, root, NAMES), root


def test_stored_rollups_answer_like_views(c, lake):
    stored, _ = lake
    for op in (
        lambda t: top.top_as(t["traffic_by_as"], c.as_dim, P),
        lambda t: top.top_ip(t["traffic_by_ip"], c.as_dim, P),
        lambda t: top.as_remote_ips(t["flows"], 1004, P),
        lambda t: top.conversations(t["flows_log"], "src_dst_ip", P),
    ):
        assert op(stored).collect() == op(c.ev).collect()


def test_flow_scan_prunes_days_columns_and_row_groups(spark, lake):
    _, root = lake
    rows = tables.read_flows(spark, f"{root}/flows", P.start, P.end).select("src_as", "bytes")
    text = plan(rows)
    assert "PartitionFilters: [isnotnull(dt" in text and "GreaterThanOrEqual(timestamp" in text
    scan = text[text.index("ReadSchema"):].split("\n")[0]
    assert "src_as" in scan and "dst_ip" not in scan


def test_top_as_scans_once_and_never_sorts_all_groups(c):
    df = top.top_as(c.ev["traffic_by_as"], c.as_dim, P)
    df.collect()
    text = plan(df).split("Initial Plan")[0] + plan(df)
    assert "TakeOrderedAndProject" in text and "ReusedExchange" in text and "BroadcastHashJoin" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_link_attribution_does_not_shuffle_the_flows(c, lake):
    from netweir.operators import enrich

    stored, _ = lake
    text = plan(enrich.attribute_links(stored["flows"].drop("link_tag", "direction"), c.interfaces).select("link_tag"))
    assert text.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in text


def test_rules_of_a_family_share_one_aggregate_and_cut_per_rule_early(c, lake):
    stored, _ = lake
    rules = [de.Rule(f"r{i}", "volume_in", threshold_bps=10**i, window_seconds=3600) for i in range(1, 5)]
    text = plan(de.evaluate_rules(rules, stored, c.links, datetime(2024, 1, 20), max_targets=100, exact=False))
    assert text.count("FileScan") == 1 and "WindowGroupLimit" in text


def test_as_of_reads_prune_days(c, lake):
    stored, _ = lake
    at, scope = datetime(2024, 1, 20), ("192.0.2.0/24", "198.51.100.0/24")
    rule = lambda kind, **kw: de.Rule("r", kind, window_seconds=3600, prefixes=scope, **kw)
    rules = (rule("volume_in", threshold_bps=1), rule("amplification", threshold_count=1), rule("subnet_flood", threshold_bps=1), rule("smtp_abuse", threshold_pps=1))
    reads = [de.evaluate_rules([r], stored, c.links, at, exact=False) for r in rules]
    reads += [de.live_threats(stored["traffic_by_dst_1min"], at, prefixes=scope, exact=False), top.ip_info(stored["flows"], c.as_dim, "192.0.2.5", at)]
    for df in reads:
        scans = [line for line in plan(df).split("\n") if "FileScan" in line and "dt" in line]
        assert scans and all("PartitionFilters: [isnotnull(dt" in line for line in scans), plan(df)


def test_rollup_is_one_shuffle_with_map_side_combine(c, lake):
    from netweir.plans.rollup import build

    stored, _ = lake
    text = plan(build(stored["flows"], ROLLUPS["traffic_by_as"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("HashAggregate") == 2 and text.count("FileScan") == 1


def test_prefix_scope_is_tested_after_a_hash_aggregate(c, lake):
    _, root = lake
    p = P.with_(scope="internal", local_prefixes=("192.0.2.0/24", "198.51.100.0/24"))
    text = plan(top.top_prefix(c.ev["traffic_by_prefix"], c.as_dim, p))
    assert "SortAggregate" not in text
    below = text[text.index("Exchange hashpartitioning(prefix"):]
    assert "Filter" not in below.split("Generate")[0].replace("Filter isnotnull", "")


def test_headline_rollups_use_hash_aggregates(c, lake):
    from netweir.plans.rollup import build

    stored, _ = lake
    for name in ("traffic_by_as", "traffic_by_ip", "traffic_by_prefix", "traffic_by_link", "traffic_by_port", "flows_log"):
        assert "SortAggregate" not in plan(build(stored["flows"], ROLLUPS[name])), name
