"""Scopes kept as tables: any number of CIDRs, rules loaded from tables."""

import ipaddress
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from netweir.functions.addr import in_cidrs, to_ip16
from netweir.operators import detect, scopes

AS_OF = datetime(2024, 1, 1, 1)


def cidr_frame(spark, texts, key="s"):
    return spark.createDataFrame([(key, t) for t in texts], "scope string, cidr string")


def test_networks_read_what_the_list_form_reads(spark):
    texts = ["10.1.2.3/8", "192.0.2.7", "2001:DB8::1/32", "2001:db8::5", "::/0", "0:0:0:0:0:0:0:0/1", "0.0.0.0/0", " 198.51.100.0/24 ",
             "bad", "bad/24", "10.0.0.0/33", "10.0.0.0/-1", "10.0.0.0/", "1.2.3/8", "2001:db8::/129", "", None, "10.0.0.0/8/8", "300.1.1.1", "0:0/8"]
    got = {r.cidr: (bytes(r.net), r.length) for r in scopes.networks(spark.createDataFrame([(t,) for t in texts], "cidr string")).collect()}
    from netweir.functions.addr import parse_networks

    want = {t: n[0] for t in texts if t is not None and (n := parse_networks([t]))}
    assert got == want


def test_scope_table_is_disjoint(spark):
    texts = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "192.0.2.0/25", "192.0.2.128/25", "192.0.2.0/25", "2001:db8::/32", "2001:db8:1::/48"]
    got = {(bytes(r.net), r.length) for r in scopes.scope_table(cidr_frame(spark, texts)).collect()}
    keep = [ipaddress.ip_network(t) for t in ("10.0.0.0/8", "192.0.2.0/25", "192.0.2.128/25", "2001:db8::/32")]
    assert got == {((bytes(10) + b"\xff\xff" if n.version == 4 else b"") + n.network_address.packed, n.prefixlen + 96 * (n.version == 4)) for n in keep}
    other = scopes.scope_table(cidr_frame(spark, ["10.0.0.0/8"], "a").unionByName(cidr_frame(spark, ["10.1.0.0/16"], "b")))
    assert other.count() == 2


def test_a_hundred_thousand_cidrs(spark):
    rng = random.Random(5)
    lines = [f"{ipaddress.ip_address(rng.getrandbits(32))}/{rng.choice((16, 20, 24, 28, 32))}" for _ in range(60_000)]
    lines += [f"{ipaddress.ip_address((0x2001 << 112) | rng.getrandbits(100))}/{rng.choice((40, 48, 64, 128))}" for _ in range(40_000)] + ["bad"] * 10
    nets = [ipaddress.ip_network(x, strict=False) for x in lines if x != "bad"]
    known = {(n.version, n.prefixlen, int(n.network_address)) for n in nets}

    def inside(ip):
        a = ipaddress.ip_address(ip)
        bits = 32 if a.version == 4 else 128
        return any((a.version, n, int(a) >> (bits - n) << (bits - n)) in known for n in (16, 20, 24, 28, 32, 40, 48, 64, 128) if n <= bits)

    hosts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(3000)] + [str(n.network_address) for n in nets[::50]]
    rows = spark.createDataFrame([(h,) for h in hosts] + [(hosts[0],)] * 3 + [(None,)], "ip string").withColumn("ip16", F.when(F.col("ip").isNotNull(), to_ip16("ip")))
    cidrs = cidr_frame(spark, lines).repartition(4)
    kept = scopes.within(rows, "ip16", cidrs)
    assert sorted(r.ip for r in kept.collect()) == sorted(h for h in hosts + [hosts[0]] * 3 if inside(h))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert scopes.within(rows, "ip16", cidr_frame(spark, ["bad", "x/24"])).count() == rows.count()


def test_zero_networks_hold_both_families(spark):
    rows = spark.createDataFrame([("192.0.2.1",), ("2001:db8::1",)], "ip string").withColumn("ip16", to_ip16("ip"))
    for texts, want in ((["::/0"], 2), (["0.0.0.0/0"], 1), (["2000::/3"], 1), (["::ffff:192.0.2.0/120"], 1)):
        assert rows.filter(in_cidrs("ip16", texts)).count() == want
        assert scopes.within(rows, "ip16", cidr_frame(spark, texts)).count() == want


def test_rules_from_tables_equal_rules_with_lists(spark):
    """Every rule type with an address scope gives the same from a scope table as from a list."""
    rng = random.Random(8)
    minute = [AS_OF - timedelta(minutes=m) for m in range(1, 9)]
    flows = [(rng.choice(minute), f"10.0.{rng.randint(0, 3)}.{rng.randint(0, 40)}", f"10.0.{rng.randint(0, 3)}.{rng.randint(0, 40)}", rng.choice((6, 17, 1)),
              rng.choice((25, 80, 443)), rng.choice((2, 16)), rng.randint(100, 9000), rng.randint(100, 900)) for _ in range(1500)]
    raw = spark.createDataFrame(flows, "timestamp timestamp, src_ip string, dst_ip string, protocol int, dst_port int, tcp_flags int, bytes long, packets long")
    raw = raw.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "src_ip16": to_ip16("src_ip"), "dst_ip16": to_ip16("dst_ip"), "sampling_rate": F.lit(1).cast("long")})
    rows = raw.withColumns({"ts": F.col("timestamp"), "flow_count": F.lit(1).cast("long"), "syn_count": F.when(F.col("tcp_flags") == 2, F.col("packets")).otherwise(0)})
    tables = {"traffic_by_dst_1min": rows, "traffic_by_src_1min": rows, "flows": raw}
    group = [f"10.0.{a}.{b}" for a in (1, 2) for b in range(0, 41, 8)] + ["10.0.3.0/27", "junk"]
    types = [("volume_in", 10, 0, 0), ("volume_out", 10, 0, 0), ("syn_flood", 0, 0, 0), ("connection_flood", 0, 0, 3), ("port_scan", 0, 0, 1), ("amplification", 0, 0, 1),
             ("icmp_flood", 0, 0, 0), ("udp_flood", 0, 0, 0), ("subnet_flood", 1, 0, 0), ("smtp_abuse", 0, 0, 2)]
    config = [(f"r{i}-{g}", t, bps, pps, n, 300, g, f, 28) for i, (t, bps, pps, n) in enumerate(types) for g, f in (("big", ""),) + ((("", "10.0.0.0/28"), ("gone", ""), ("bad", "")) if i == 0 else ())]
    rules = spark.createDataFrame(config, "rule_id string, rule_type string, threshold_bps long, threshold_pps long, threshold_count long, window_seconds int, hostgroup_id string, target_filter string, subnet_prefix_len int")
    groups = spark.createDataFrame([("big", group), ("bad", ["nothing"] * 100)], "id string, cidrs array<string>")
    loaded, table = detect.load_rules(rules, groups, ["10.0.2.0/24"], inline=8)
    assert {r.scope for r in loaded} == {"", "big"} and all(not r.prefixes for r in loaded if r.scope)
    lists, none = detect.load_rules(rules, groups, ["10.0.2.0/24"], inline=1000)
    assert none is None
    got = detect.evaluate_rules(loaded, tables, None, AS_OF, scopes=table).collect()
    want = detect.evaluate_rules(lists, tables, None, AS_OF).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.rule_id for r in got}) == len(config)


def test_repeated_texts_are_parsed_once(spark):
    """The parsing filters stay above the distinct: a list of many equal texts is not parsed row by row."""
    lines = spark.range(1000).select(F.lit("s").alias("scope"), F.concat(F.lit("10."), (F.col("id") % 3).cast("string"), F.lit(".0.0/16")).alias("cidr"))
    lines = lines.unionByName(cidr_frame(spark, ["bad", "bad/5", "10.0.0.0/8", None]))
    table = scopes.scope_table(lines)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in text and "FileScan" in text  # the list itself is behind what was written
    assert [(bytes(r.net), r.length) for r in table.collect()] == [(bytes(10) + b"\xff\xff\x0a\0\0\0", 104)]
