"""Detection, alerts, config, retention, reports, functions and streams (ALR, CFG, RET, REP, FUN, STR and the rest of JON)."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions import addr, asn, fmt, timeb
from ..operators import alerts as al, detect as de, dims, enrich, reports, retention as ret, top
from ..operators.quantiles import group_quantiles
from ..params import QueryParams, report_window
from ..plans import rollup as ro
from ..plans.sizing import scratch_dir
from ..sources import netflow
from ..streaming import jobs, state
from . import encode, fixtures as fx
from .q_flows import _ALERTS, _BLOCKS, _CIDR_HIT, _CIDR_ROWS, _HG, EV, EV_END, EV_START, cut, raw_v4, stream_of
from .q_reads import big, iff, q95
from .registry import query
from .sql import SUMS, TOTALS, gname, grouped, local, net24, proto, service, sql, tb

MONTH = 30 * 86400
SCOPE = fx.LOCAL_PREFIXES
AS_OF = EV_END
SINCE = "ts >= TIMESTAMP '2024-01-01 00:00:00'"


# ---- rules -----------------------------------------------------------------------


def _rule(kind: str, **kw) -> de.Rule:
    return de.Rule("r", kind, window_seconds=MONTH, prefixes=SCOPE, **kw)


def _violations(c, rule: de.Rule, as_of: datetime = AS_OF) -> DataFrame:
    return de.evaluate_rules([rule], c.ev, c.links, as_of, exact=c.exact).drop("rule_id")


def _hosts(side: str, having: str, metric: str, unique: str, protocol: str, extra: str = "", table: str | None = None) -> str:
    return f"""SELECT 'ip' AS target_kind, {side}_ip AS target, CAST({protocol} AS INT) AS protocol, CAST({metric} AS DOUBLE) AS metric_value, CAST({unique} AS BIGINT) AS unique_count
 FROM {table or 'r_' + side} WHERE {SINCE} AND {local(side + '_ip')} {extra} GROUP BY {side}_ip HAVING {having}"""


_BPS, _PPS = f"({big('sum(bytes)')} * 8 / {MONTH})", f"({big('sum(packets)')} / {MONTH})"


@query("ALR-01_volume_in", sql("ev", _hosts("dst", f"{_BPS} > 1000", _BPS, "0", "min(protocol)"), "r_dst"))
def _(c):
    return _violations(c, _rule("volume_in", threshold_bps=1000))


@query("ALR-02_volume_out", sql("ev", _hosts("src", f"{_BPS} > 1000", _BPS, "0", "min(protocol)"), "r_src"))
def _(c):
    return _violations(c, _rule("volume_out", threshold_bps=1000))


_SYN = f"({big('sum(syn_count)')} / {MONTH})"


@query("ALR-03_syn_flood", sql("ev", _hosts("dst", f"{_SYN} > 0", _SYN, "0", "6", "AND protocol = 6"), "r_dst"))
def _(c):
    return _violations(c, _rule("syn_flood", threshold_pps=0))


@query("ALR-04_amplification", sql("ev", _hosts("dst", f"count(DISTINCT src_ip) > 30 AND {_BPS} >= 500", "count(DISTINCT src_ip)", "count(DISTINCT src_ip)", "min(protocol)"), "r_dst"))
def _(c):
    return _violations(c, _rule("amplification", threshold_count=30, threshold_bps=500))


def _proto_flood(number: int) -> str:
    pps = big(f"floor(CAST(sum(packets) AS BIGINT) / 600)")
    return f"""SELECT 'ip' AS target_kind, dst_ip AS target, {number} AS protocol, CAST({pps} AS DOUBLE) AS metric_value, CAST(0 AS BIGINT) AS unique_count
 FROM r_dst WHERE ts >= TIMESTAMP '2023-12-31 23:50:00' AND protocol = {number} AND {local('dst_ip')} GROUP BY dst_ip HAVING {pps} > 10"""


# A ten-minute window ending ten minutes into the data would see little; "since" has no upper bound, so an early
# evaluation time covers the whole table.
_EARLY = datetime(2024, 1, 1)


@query("ALR-05_icmp_flood", sql("ev", _proto_flood(1), "r_dst"))
def _(c):
    return _violations(c, de.Rule("r", "icmp_flood", threshold_pps=10, window_seconds=600, prefixes=SCOPE), _EARLY)


@query("ALR-06_udp_flood", sql("ev", _proto_flood(17), "r_dst"))
def _(c):
    return _violations(c, de.Rule("r", "udp_flood", threshold_pps=10, window_seconds=600, prefixes=SCOPE), _EARLY)


@query("ALR-07_connection_flood", sql("ev", _hosts("dst", "count(*) > 60", "count(*)", "count(*)", "min(protocol)"), "r_dst"))
def _(c):
    return _violations(c, _rule("connection_flood", threshold_count=60))


@query("ALR-08_port_scan", sql("ev", _hosts("src", "count(DISTINCT dst_port) > 2", "count(DISTINCT dst_port)", "count(DISTINCT dst_port)", "min(protocol)"), "r_src"))
def _(c):
    return _violations(c, _rule("port_scan", threshold_count=2))


@query("ALR-09_subnet_flood", sql("ev", f"""SELECT 'ip' AS target_kind, net AS target, 0 AS protocol, CAST({big('floor(' + _BPS + ')')} AS DOUBLE) AS metric_value, CAST(0 AS BIGINT) AS unique_count FROM (
 SELECT {net24('dst_ip')} AS net, bytes, packets FROM r_dst WHERE {SINCE} AND dst_ip LIKE '%.%.%.%') GROUP BY net
 HAVING floor({_BPS}) > 2000 OR floor({_PPS}) > 1""", "r_dst"))
def _(c):
    rule = de.Rule("r", "subnet_flood", threshold_bps=2000, threshold_pps=1, window_seconds=MONTH, prefixes=("0.0.0.0/0",))
    return _violations(c, rule)


@query("ALR-10_smtp_abuse", sql("ev", f"""SELECT 'ip' AS target_kind, src_ip AS target, 6 AS protocol, CAST(count(*) AS DOUBLE) AS metric_value, count(*) AS unique_count
 FROM f WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND protocol = 6 AND dst_port IN (25, 465, 587) AND {local('src_ip')} GROUP BY src_ip HAVING count(*) > 3"""))
def _(c):
    return _violations(c, _rule("smtp_abuse", threshold_count=3))


@query("ALR-11_link_capacity", sql("ev", f"""SELECT 'label' AS target_kind, link_tag AS target, 0 AS protocol, util AS metric_value, CAST(0 AS BIGINT) AS unique_count FROM (
 SELECT link_tag, quantile_cont(bps, 0.95) / (capacity_mbps * 1e6) * 100 AS util FROM (
 SELECT link_tag, ts, CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600 AS bps FROM r_linkh WHERE {SINCE} GROUP BY 1, 2) JOIN lk ON tag = link_tag WHERE capacity_mbps > 0 GROUP BY link_tag, capacity_mbps)
 WHERE util > 1 ORDER BY util DESC, link_tag LIMIT 1""", "r_linkh"))
def _(c):
    return _violations(c, _rule("link_capacity", threshold_count=1))


_CURRENT = datetime(2024, 1, 30, 22)
_ANOMALY = f""", s AS (SELECT link_tag, ts, CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600 AS bps, ts = TIMESTAMP '2024-01-30 21:00:00' AS cur FROM r_linkh
 WHERE isodow(ts) = 2 AND hour(ts) = 21 AND ts <= TIMESTAMP '2024-01-30 21:00:00' AND ts >= TIMESTAMP '2023-12-05 21:00:00' GROUP BY 1, 2),
 md AS (SELECT link_tag, median(bps) AS med, count(*) AS samples FROM s WHERE NOT cur GROUP BY 1),
 bl AS (SELECT link_tag, any_value(samples) AS samples, any_value(med) + 2.5 * 1.4826 * median(abs(bps - med)) AS baseline FROM s JOIN md USING (link_tag) WHERE NOT cur GROUP BY 1),
 rt AS (SELECT link_tag, samples, baseline, coalesce((SELECT max(bps) FROM s WHERE cur AND s.link_tag = bl.link_tag), 0.0) AS current FROM bl)"""


@query("ALR-12_anomaly", sql("ev", _ANOMALY + """ SELECT link_tag, current, round(baseline, 6) AS baseline, round(current / baseline, 9) AS deviation, samples, CAST(2.5 AS DOUBLE) AS sensitivity_k FROM rt
 WHERE samples >= 4 AND baseline > 0 AND current > baseline AND current / baseline >= 1.2 ORDER BY current / baseline DESC, link_tag LIMIT 1""", "r_linkh"))
def _(c):
    found = de.anomalies(c.ev["traffic_by_link_hourly"], 2.5, _CURRENT)
    return found.withColumns({"baseline": F.round("baseline", 6), "deviation": F.round("deviation", 9)})


_LINK_RULES = [
    de.Rule("c1", "link_capacity", threshold_count=1, window_seconds=MONTH), de.Rule("c2", "link_capacity", threshold_count=1, window_seconds=MONTH // 3),
    de.Rule("a1", "anomaly", threshold_count=25), de.Rule("a2", "anomaly", threshold_count=1), de.Rule("a3", "anomaly", threshold_count=10, target_filter="transit-2"),
]


def _capacity_hit(rule: str, window: int) -> str:
    return f"""(SELECT '{rule}' AS rule_id, link_tag AS target, util AS metric_value FROM (SELECT link_tag, quantile_cont(bps, 0.95) / (capacity_mbps * 1e6) * 100 AS util FROM (
 SELECT link_tag, ts, CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600 AS bps FROM r_linkh WHERE ts >= TIMESTAMP '{_CURRENT - timedelta(seconds=window):%Y-%m-%d %H:%M:%S}' GROUP BY 1, 2)
 JOIN lk ON tag = link_tag WHERE capacity_mbps > 0 GROUP BY link_tag, capacity_mbps) WHERE util > 1 ORDER BY util DESC, link_tag LIMIT 1)"""


def _anomaly_hit(rule: str, k: float, where: str = "") -> str:
    baseline = f"(med + {k} * 1.4826 * mad)"
    return f"""(SELECT '{rule}' AS rule_id, link_tag AS target, current AS metric_value FROM mm WHERE samples >= 4 AND {baseline} > 0 AND current > {baseline} AND current / {baseline} >= 1.2 {where}
 ORDER BY current / {baseline} DESC, link_tag LIMIT 1)"""


@query("ALR-12_link_rules_together", sql("ev", _ANOMALY + """, mm AS (SELECT link_tag, any_value(samples) AS samples, any_value(med) AS med, median(abs(bps - med)) AS mad,
 coalesce((SELECT max(bps) FROM s t WHERE cur AND t.link_tag = s.link_tag), 0.0) AS current FROM s JOIN md USING (link_tag) WHERE NOT cur GROUP BY 1) """ + " UNION ALL ".join((
    _capacity_hit("c1", MONTH), _capacity_hit("c2", MONTH // 3), _anomaly_hit("a1", 2.5), _anomaly_hit("a2", 0.1), _anomaly_hit("a3", 1.0, "AND link_tag = 'transit-2'"))), "r_linkh"))
def _(c):
    return de.evaluate_rules(_LINK_RULES, c.ev, c.links, _CURRENT).select("rule_id", "target", "metric_value")


_EXPLAIN = f"link_tag = 'transit-1' AND {cut(EV, 'timestamp')}"


def _explain(section: str, key: str, name: str, where: str = "") -> str:
    return f"""SELECT '{section}' AS section, row_number() OVER (ORDER BY bytes DESC, key) AS rank, key, {name} AS name, bytes, packets, bytes / (SELECT sum(bytes) FROM f WHERE {_EXPLAIN}) * 100 AS percent FROM (
 SELECT {key} AS key, any_value(src_as) AS asn, any_value(protocol) AS pr, any_value(dst_port) AS po, {big('sum(bytes)')} AS bytes, {big('sum(packets)')} AS packets FROM f WHERE {_EXPLAIN} {where} GROUP BY 1 ORDER BY bytes DESC, key LIMIT 10)"""


@query("ALR-13_anomaly_explain", sql("ev", " UNION ALL ".join("(" + s + ")" for s in (
    _explain("as", "CAST(src_as AS VARCHAR)", "coalesce((SELECT as_name FROM an WHERE as_number = asn), '')", "AND src_as > 0"),
    _explain("ip", "src_ip", "''"),
    _explain("port", "CAST(protocol AS VARCHAR) || '/' || CAST(dst_port AS VARCHAR)", f"trim({proto('pr')} || ' ' || {service('pr', 'po')})"))), "svc"))
def _(c):
    return de.anomaly_explain(c.ev["flows"], c.as_dim, "transit-1", EV_START, EV_END)


_THREATS = f"""SELECT dst_ip AS target, {big('floor(CAST(sum(bytes) AS BIGINT) * 8 / 3600)')} AS bps, {big('floor(CAST(sum(packets) AS BIGINT) / 3600)')} AS pps,
 {big('floor(CAST(sum(syn_count) AS BIGINT) / 3600)')} AS syn_pps, count(DISTINCT src_ip) AS unique_src_ips FROM r_dst WHERE ts >= TIMESTAMP '2023-12-31 23:00:00' AND {local('dst_ip')}
 GROUP BY 1 ORDER BY bps DESC, target LIMIT 200"""


def _threats(c) -> DataFrame:
    return de.live_threats(c.ev["traffic_by_dst_1min"], _EARLY, 3600, 200, SCOPE)


@query("ALR-14_live_threats", sql("ev", _THREATS, "r_dst"))
def _(c):
    return _threats(c)


_GRADING = [
    de.Rule("g1", "volume_in", "volume", threshold_bps=3_000_000), de.Rule("g2", "syn_flood", "syn", threshold_pps=20),
    de.Rule("g3", "amplification", "reflection", threshold_count=90), de.Rule("g4", "subnet_flood", "carpet", threshold_bps=4_000_000),
    de.Rule("g5", "udp_flood", "udp", threshold_pps=1), de.Rule("g6", "volume_in", "off", threshold_bps=1, enabled=False),
]
_ANNOTATED = f"""SELECT *, CASE WHEN worst_pct >= 100 THEN 'critical' WHEN worst_pct >= 50 THEN 'warn' ELSE 'ok' END AS status FROM (
 SELECT target, bps, pps, syn_pps, unique_src_ips, worst_pct, CASE worst_pct WHEN 0.0 THEN '' WHEN p1 THEN 'volume' WHEN p2 THEN 'syn' WHEN p3 THEN 'reflection' ELSE 'carpet' END AS worst_rule FROM (
 SELECT *, greatest(p1, p2, p3, p4) AS worst_pct FROM (SELECT *, bps / 3000000 * 100 AS p1, syn_pps / 20 * 100 AS p2, unique_src_ips / 90 * 100 AS p3, bps / 4000000 * 100 AS p4 FROM ({_THREATS}))))"""


@query("ALR-15_annotate_threats", sql("ev", _ANNOTATED, "r_dst"))
def _(c):
    return de.annotate_threats(_threats(c), _GRADING)


@query("JON-08_threats_by_rules", sql("ev", f"SELECT worst_rule, count(*) AS n, max(worst_pct) AS worst_pct FROM ({_ANNOTATED}) GROUP BY 1", "r_dst"))
def _(c):
    rows = de.annotate_threats(_threats(c), _GRADING)
    return rows.groupBy("worst_rule").agg(F.count("*").alias("n"), F.max("worst_pct").alias("worst_pct"))


@query("JON-09_dual_stack_merge", sql("ev", f""", v4 AS (SELECT {grouped('as_number')} AS n, {big('sum(bytes)')} AS b FROM r_as WHERE ip_version = 4 GROUP BY 1 ORDER BY b DESC, n LIMIT 50),
 v6 AS (SELECT {grouped('as_number')} AS n, {big('sum(bytes)')} AS b FROM r_as WHERE ip_version = 6 GROUP BY 1 ORDER BY b DESC, n LIMIT 50)
 SELECT as_num, {gname('as_num', 'as_name')} AS as_name, v4_bytes, v6_bytes, v4_bytes + v6_bytes AS total_bytes FROM (
 SELECT coalesce(v4.n, v6.n) AS as_num, coalesce(v4.b, 0) AS v4_bytes, coalesce(v6.b, 0) AS v6_bytes FROM v4 FULL JOIN v6 ON v4.n = v6.n) LEFT JOIN an ON as_num = as_number
 ORDER BY total_bytes DESC, as_num LIMIT 50""", "r_as"))
def _(c):
    page = lambda v: top.top_as(c.ev["traffic_by_as"].filter(F.col("ip_version") == v), c.as_dim, EV.with_(limit=50))
    return top.dual_stack_merge(page(4), page(6))


_SET = [
    de.Rule("v1", "volume_in", threshold_bps=3_000_000, window_seconds=3600, prefixes=SCOPE),
    de.Rule("v2", "volume_in", threshold_bps=30_000_000, window_seconds=600, prefixes=("192.0.2.0/24",)),
    de.Rule("s1", "syn_flood", threshold_pps=5, window_seconds=3600, prefixes=SCOPE),
    de.Rule("c1", "connection_flood", threshold_count=90, window_seconds=600, prefixes=SCOPE),
    de.Rule("o1", "volume_out", threshold_bps=3_000_000, window_seconds=3600, prefixes=SCOPE),
    de.Rule("off", "volume_out", threshold_bps=1, window_seconds=3600, prefixes=SCOPE, enabled=False),
]


def _one(rule: str, side: str, window: int, metric: str, limit: str, extra: str = "", scope: str = "") -> str:
    since = (datetime(2024, 1, 1) - timedelta(seconds=window)).strftime("%Y-%m-%d %H:%M:%S")
    return f"""(SELECT '{rule}' AS rule_id, {side}_ip AS target, CAST({metric} AS DOUBLE) AS metric_value FROM r_{side} WHERE ts >= TIMESTAMP '{since}' AND {scope or local(side + '_ip')} {extra}
 GROUP BY {side}_ip HAVING {metric} > {limit})"""


def _seeded(r: de.Rule) -> str:
    """SQL of a seeded per-host rule evaluated over the whole table."""
    w = r.window_seconds
    bps, pps = f"CAST(sum(bytes) AS BIGINT) * 8 / {w}", f"CAST(sum(packets) AS BIGINT) / {w}"
    flood = {"icmp_flood": 1, "udp_flood": 17}
    if r.rule_type in ("volume_in", "volume_out"):
        return _one(r.rule_id, "dst" if r.rule_type == "volume_in" else "src", w, bps, str(r.threshold_bps))
    if r.rule_type == "syn_flood":
        return _one(r.rule_id, "dst", w, f"CAST(sum(syn_count) AS BIGINT) / {w}", str(r.threshold_pps), "AND protocol = 6")
    if r.rule_type in flood:
        return _one(r.rule_id, "dst", w, f"floor({pps})", str(r.threshold_pps), f"AND protocol = {flood[r.rule_type]}")
    if r.rule_type == "connection_flood":
        return _one(r.rule_id, "dst", w, "count(*)", str(r.threshold_count))
    if r.rule_type == "amplification":
        return _one(r.rule_id, "dst", w, f"CASE WHEN {bps} >= {r.threshold_bps} THEN count(DISTINCT src_ip) ELSE 0 END", str(r.threshold_count))
    if r.rule_type == "port_scan":
        return _one(r.rule_id, "src", w, "count(DISTINCT dst_port)", str(r.threshold_count))
    since = f"ts >= TIMESTAMP '{(datetime(2024, 1, 1) - timedelta(seconds=w)).strftime('%Y-%m-%d %H:%M:%S')}'"
    if r.rule_type == "subnet_flood":
        return f"(SELECT {net24('dst_ip')} AS net FROM r_dst WHERE {since} AND {local('dst_ip')} AND dst_ip LIKE '%.%.%.%' GROUP BY 1 HAVING floor({bps}) > {r.threshold_bps})"
    if r.rule_type == "smtp_abuse":
        return f"(SELECT src_ip FROM f WHERE {since.replace('ts', 'timestamp', 1)} AND protocol = 6 AND dst_port IN (25, 465, 587) AND {local('src_ip')} GROUP BY 1 HAVING floor({pps}) > {r.threshold_pps})"
    if r.rule_type == "link_capacity":
        return f"""(SELECT link_tag FROM (SELECT link_tag, quantile_cont(bps, 0.95) / (capacity_mbps * 1e6) * 100 AS util FROM (
 SELECT link_tag, ts, CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600 AS bps FROM r_linkh WHERE {since} GROUP BY 1, 2) JOIN lk ON tag = link_tag WHERE capacity_mbps > 0 GROUP BY link_tag, capacity_mbps) WHERE util > {r.threshold_count} LIMIT 1)"""
    assert not r.enabled, r.rule_type
    return ""


_V4_SCOPE = tuple(p for p in SCOPE if "." in p)


@query("ALR-17_evaluate_rules", sql("ev", " UNION ALL ".join((
    _one("v1", "dst", 3600, "CAST(sum(bytes) AS BIGINT) * 8 / 3600", "3000000"),
    _one("v2", "dst", 600, "CAST(sum(bytes) AS BIGINT) * 8 / 600", "30000000", scope="dst_ip LIKE '192.0.2.%'"),
    _one("s1", "dst", 3600, "CAST(sum(syn_count) AS BIGINT) / 3600", "5", "AND protocol = 6"),
    _one("c1", "dst", 600, "count(*)", "90"),
    _one("o1", "src", 3600, "CAST(sum(bytes) AS BIGINT) * 8 / 3600", "3000000"))), "r_dst", "r_src"))
def _(c):
    return de.evaluate_rules(_SET, c.ev, c.links, _EARLY).select("rule_id", "target", "metric_value")


_GROUP = f"SELECT DISTINCT 'outer' AS id, cidr FROM ({_CIDR_ROWS}) c"
_RULE_TABLE = """SELECT concat('t-', CAST(n_nationkey AS VARCHAR(20))) AS rule_id, CASE WHEN n_nationkey % 5 = 4 THEN 'volume_out' ELSE 'volume_in' END AS rule_type,
 CAST((1 + n_nationkey) * 100000 AS BIGINT) AS threshold_bps, 3600 AS window_seconds, CASE n_nationkey % 4 WHEN 0 THEN 'outer' WHEN 1 THEN 'gone' ELSE '' END AS hostgroup_id,
 CASE WHEN n_nationkey % 4 = 2 THEN '192.0.2.0/24' ELSE '' END AS target_filter FROM nation"""


def _table_rules(side: str, kind: str) -> str:
    own = f"hostgroup_id = '' AND target_filter <> '' AND {side}_ip LIKE '192.0.2.%'"
    outer = _CIDR_HIT.replace("dst_ip", f"{side}_ip")
    return f"""SELECT rule_id, {side}_ip AS target, bps AS metric_value FROM rt JOIN (SELECT {side}_ip, CAST(sum(bytes) AS BIGINT) * 8 / 3600 AS bps FROM r_{side} WHERE ts >= TIMESTAMP '2023-12-31 23:00:00' GROUP BY 1)
 ON rule_type = '{kind}' AND bps > threshold_bps AND (CASE WHEN hostgroup_id = 'outer' THEN {outer} WHEN target_filter <> '' THEN {own} ELSE {local(side + '_ip')} END)"""


@query("ALR-17_rules_from_tables", sql("ev", f""", cidrs AS ({_CIDR_ROWS}), rt AS ({_RULE_TABLE}) {_table_rules('dst', 'volume_in')} UNION ALL {_table_rules('src', 'volume_out')}""", "r_dst", "r_src"))
def _(c):
    """Rules and host groups read from tables; one group holds a CIDR list that grows with the orders and stays a table."""
    group = c.sql(_GROUP, "orders").groupBy("id").agg(F.collect_list("cidr").alias("cidrs"))
    rules, scopes = de.load_rules(c.sql(_RULE_TABLE, "nation"), group, SCOPE)
    return de.evaluate_rules(rules, c.ev, c.links, _EARLY, scopes=scopes).select("rule_id", "target", "metric_value")


@query("ALR-16_rule_catalogue", sql("ev", "SELECT rule_id, name, CAST(violations AS BIGINT) AS violations FROM (VALUES " + ", ".join(
    f"('{r.rule_id}', '{r.name}', {'(SELECT count(*) FROM ' + _seeded(r) + ')' if _seeded(r) else 0})" for r in de.DEFAULT_RULES) + ") AS t(rule_id, name, violations)", "r_dst", "r_src", "r_linkh"))
def _(c):
    """The seeded catalogue with the number of violations each rule finds in the whole table."""
    scoped = [replace(r, prefixes=_V4_SCOPE if r.rule_type == "subnet_flood" else SCOPE) for r in de.DEFAULT_RULES]
    found = de.evaluate_rules(scoped, c.ev, c.links, _EARLY).groupBy("rule_id").agg(F.count("*").alias("violations"))
    rows = de.default_rules(c.spark).join(found, "rule_id", "left")
    return rows.select("rule_id", "name", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))


# ---- alert lifecycle ---------------------------------------------------------------

TICKER = de.Rule("tick", "volume_in", threshold_bps=1_000_000, window_seconds=600, cooldown_seconds=300, prefixes=SCOPE)
_TICKS = f""", mins AS (SELECT ts, dst_ip, {big('sum(bytes)')} AS b FROM r_dst WHERE {local('dst_ip')} GROUP BY 1, 2),
 ticks AS (SELECT dst_ip AS target, ts + i * INTERVAL '30' SECOND AS tick, CAST(sum(b) AS BIGINT) * 8 / 600 AS metric_value FROM mins, range(21) t(i) GROUP BY 1, 2 HAVING CAST(sum(b) AS BIGINT) * 8 / 600 > 1000000)"""


@query("STR-02_sliding_evaluation", sql("ev", _TICKS + " SELECT target, tick, metric_value FROM ticks", "r_dst"))
def _(c):
    return de.sliding_ticks(c.ev["traffic_by_dst_1min"], TICKER).select("target", "tick", "metric_value")


# With a cooldown no longer than the stale time an island of ticks is exactly one alert.
_ISLANDS = _TICKS + """, isl AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY tick) AS g FROM (
 SELECT *, date_diff('second', lag(tick) OVER (PARTITION BY target ORDER BY tick), tick) AS gap FROM ticks)),
 alerts AS (SELECT target, min(tick) AS triggered_at, max(tick) AS last_seen_at, arg_min(metric_value, tick) AS metric_value, count(*) - 1 AS heartbeats FROM isl GROUP BY target, g)"""


@query("ALR-18_alert_lifecycle", sql("ev", _ISLANDS + """ SELECT target, triggered_at, last_seen_at, metric_value, heartbeats,
 CASE WHEN last_seen_at + INTERVAL '300' SECOND < TIMESTAMP '2024-02-01 00:00:00' THEN 'resolved' ELSE 'active' END AS status,
 CASE WHEN last_seen_at + INTERVAL '300' SECOND < TIMESTAMP '2024-02-01 00:00:00' THEN last_seen_at + INTERVAL '330' SECOND END AS resolved_at FROM alerts""", "r_dst"))
def _(c):
    ticks = de.sliding_ticks(c.ev["traffic_by_dst_1min"], TICKER)
    return al.lifecycle(ticks, datetime(2024, 2, 1)).drop("rule_id")


@query("ALR-19_auto_resolve", f"""SELECT id, CASE WHEN gone THEN 'resolved' ELSE status END AS status, CASE WHEN gone THEN TIMESTAMP '2024-01-15 00:00:00' ELSE resolved_at END AS resolved_at FROM (
 SELECT id, status, resolved_at, status = 'active' AND last_seen_at < TIMESTAMP '2024-01-14 23:55:00' AS gone FROM {_ALERTS})""")
def _(c):
    return al.auto_resolve(c.alerts, datetime(2024, 1, 15)).select("id", "status", "resolved_at")


# FNV-1a over the label's bytes, as the last 64 bits of an address in 0100::/64.
_FNV = """list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(strlen(link_tag)), lambda i: ('0x' || substr(hex(encode(link_tag)), 2 * i::INT + 1, 2))::UHUGEINT)),
 lambda a, b: (xor((a % 18446744073709551616)::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211) % 18446744073709551616)"""
_GROUPS = " || ':' || ".join(f"ltrim(substr(h, {i}, 4), '0')" for i in (1, 5, 9, 13))


@query("ALR-20_target_identity", sql("ev", f"""SELECT 'label' AS target_kind, link_tag AS target, '100::' || {_GROUPS} AS target_id FROM (SELECT link_tag, lpad(lower(to_hex({_FNV}::UBIGINT)), 16, '0') AS h
 FROM (SELECT DISTINCT link_tag FROM f WHERE link_tag != '')) UNION ALL SELECT 'ip', dst_ip, dst_ip FROM (SELECT DISTINCT dst_ip FROM f)"""))
def _(c):
    tags = c.ev["flows"].filter("link_tag != ''").select(F.lit("label").alias("target_kind"), F.col("link_tag").alias("target"))
    hosts = c.ev["flows"].select(F.lit("ip").alias("target_kind"), F.col("dst_ip").alias("target"))
    return al.target_identity(tags.unionByName(hosts).distinct())


_SHORT = 10 * 86400


def _opened(c) -> DataFrame:
    """Two alerts on every target, of a long and a short window."""
    hosts = c.ev["flows"].filter("protocol = 1").groupBy(F.col("dst_ip").alias("target")).agg(F.count("*").alias("unique_count"))
    return hosts.withColumns({"target_kind": F.lit("ip"), "window_seconds": F.explode(F.array(F.lit(MONTH), F.lit(_SHORT)))})


_OPENED = f"SELECT dst_ip AS target, count(*) AS unique_count, unnest([{MONTH}, {_SHORT}]) AS window_seconds FROM f WHERE protocol = 1 GROUP BY 1"
_SOURCES = " UNION ALL ".join(f"""SELECT dst_ip, {w} AS w, list(src_ip ORDER BY rank) AS top_sources FROM (SELECT dst_ip, src_ip, row_number() OVER (PARTITION BY dst_ip ORDER BY sum(bytes) DESC, src_ip) AS rank
 FROM f WHERE timestamp >= TIMESTAMP '{(AS_OF - timedelta(seconds=w)).strftime('%Y-%m-%d %H:%M:%S')}' GROUP BY 1, 2) WHERE rank <= 5 GROUP BY 1""" for w in (MONTH, _SHORT))


@query("ALR-21_top_source_enrichment", sql("ev", f"SELECT target, window_seconds, unique_count, coalesce(array_to_string(top_sources, ', '), '') AS top_sources FROM ({_OPENED}) LEFT JOIN ({_SOURCES}) ON dst_ip = target AND w = window_seconds"))
def _(c):
    rows = al.with_top_sources(_opened(c), c.ev["flows"], AS_OF)
    return rows.select("target", "window_seconds", "unique_count", F.array_join("top_sources", ", ").alias("top_sources"))


@query("ALR-22_details_payload", sql("ev", f"""SELECT target, '{{' || coalesce('"top_sources":["' || array_to_string(top_sources, '","') || '"],', '') || '"unique_count":' || CAST(unique_count AS VARCHAR) || ',"window_seconds":' || CAST(window_seconds AS VARCHAR) || '}}' AS details
 FROM ({_OPENED}) LEFT JOIN ({_SOURCES}) ON dst_ip = target AND w = window_seconds"""))
def _(c):
    rows = al.with_top_sources(_opened(c), c.ev["flows"], AS_OF)
    return rows.select("target", al.details_json().alias("details"))


_LAST_HOUR = "link_tag != '' AND timestamp >= TIMESTAMP '2024-01-30 23:00:00' AND timestamp < TIMESTAMP '2024-01-31 00:00:00'"


def _why(section: str, key: str, name: str, where: str = "") -> str:
    return f"""SELECT link_tag AS target, '{section}' AS section, rank, key, {name} AS name, bytes, packets, bytes / whole * 100 AS percent FROM (
 SELECT *, row_number() OVER (PARTITION BY link_tag ORDER BY bytes DESC, key) AS rank FROM (SELECT link_tag, {key} AS key, any_value(src_as) AS asn, any_value(protocol) AS pr, any_value(dst_port) AS po,
 {big('sum(bytes)')} AS bytes, {big('sum(packets)')} AS packets FROM f WHERE {_LAST_HOUR} {where} GROUP BY 1, 2))
 JOIN (SELECT link_tag, sum(bytes) AS whole FROM f WHERE {_LAST_HOUR} GROUP BY 1) USING (link_tag) WHERE rank <= 10"""


@query("ALR-22_label_explanation", sql("ev", " UNION ALL ".join((
    _why("as", "CAST(src_as AS VARCHAR)", "coalesce((SELECT as_name FROM an WHERE as_number = asn), '')", "AND src_as > 0"),
    _why("ip", "src_ip", "''"),
    _why("port", "CAST(protocol AS VARCHAR) || '/' || CAST(dst_port AS VARCHAR)", f"trim({proto('pr')} || ' ' || {service('pr', 'po')})"))), "svc"))
def _(c):
    """The explanations that anomaly alerts on all links carry in their details."""
    labels = c.links.select(F.lit("label").alias("target_kind"), F.col("tag").alias("target"), F.lit("anomaly").alias("rule_type"))
    rows = al.with_explanations(labels, c.ev["flows"], c.as_dim, AS_OF)
    return rows.select("target", F.explode(F.col("extra")["explanation"]).alias("e")).select("target", "e.*")


@query("ALR-23_list_alerts", f"SELECT id, severity, triggered_at, status FROM {_ALERTS} WHERE status = 'active' ORDER BY triggered_at DESC, id LIMIT 100")
def _(c):
    return al.list_alerts(c.alerts, "active").select("id", "severity", "triggered_at", "status")


@query("ALR-24_active_by_severity", f"SELECT severity, count(*) AS alerts, (SELECT count(*) FROM {_ALERTS} WHERE status = 'active') AS total FROM {_ALERTS} WHERE status = 'active' GROUP BY 1")
def _(c):
    return al.active_by_severity(c.alerts)


@query("ALR-25_transitions", f"""SELECT id, CASE WHEN severity = 'info' AND status = 'active' THEN 'resolved' WHEN severity = 'warning' AND status = 'active' THEN 'acknowledged' ELSE status END AS status,
 CASE WHEN severity = 'warning' AND status = 'active' THEN 'ops@example.net' ELSE acknowledged_by END AS acknowledged_by, CASE WHEN severity = 'info' AND status = 'active' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE resolved_at END AS resolved_at FROM {_ALERTS}""")
def _(c):
    active = F.col("status") == "active"
    at = datetime(2024, 2, 1)
    acks = al.transition(c.alerts, active & (F.col("severity") == "warning"), "acknowledged", at, "ops@example.net")
    done = al.transition(c.alerts, active & (F.col("severity") == "info"), "resolved", at)
    return al.apply_transitions(c.alerts, acks.unionByName(done)).select("id", "status", "acknowledged_by", "resolved_at")


_RULES_SQL = """SELECT concat('r-', CAST(n_nationkey AS VARCHAR(20))) AS rule_id, CASE WHEN n_nationkey = 3 THEN 'auto_block' ELSE 'notify' END AS action,
 concat('w-', CAST(n_nationkey % 4 AS VARCHAR(20))) AS w1, concat('w-', CAST(n_regionkey AS VARCHAR(20))) AS w2 FROM nation"""
_HOOKS_SQL = """SELECT concat('w-', CAST(r_regionkey AS VARCHAR(20))) AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'slack' ELSE 'generic' END AS webhook_type,
 CASE WHEN r_regionkey = 3 THEN 0 ELSE 1 END AS enabled, CASE r_regionkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS min_severity FROM region"""
_RANK = "CASE {} WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"


def _rules(c) -> DataFrame:
    rows = c.sql(_RULES_SQL, "nation")
    return rows.withColumn("webhook_ids", F.array_distinct(F.array("w1", "w2")))


@query("ALR-26_route_notifications", f"""SELECT a.id AS alert_id, h.id AS webhook_id, webhook_type FROM {_ALERTS} a JOIN (SELECT DISTINCT rule_id, w FROM (SELECT rule_id, w1 AS w FROM ({_RULES_SQL}) UNION ALL SELECT rule_id, w2 FROM ({_RULES_SQL}))) r
 ON r.rule_id = a.rule_id JOIN ({_HOOKS_SQL}) h ON h.id = r.w WHERE enabled = 1 AND {_RANK.format('severity')} >= {_RANK.format('min_severity')}""")
def _(c):
    routed = al.route_notifications(c.alerts, _rules(c), c.sql(_HOOKS_SQL, "region"))
    return routed.select(F.col("id").alias("alert_id"), "webhook_id", "webhook_type")


@query("ALR-27_block_candidates", f"""SELECT ip, 32 AS prefix_len, 'auto_block' AS reason, alert_id, rule_name, metric_value, metric_type, threshold, CASE WHEN odd THEN '192.0.2.9, 192.0.2.8' ELSE '' END AS top_sources,
 printf('Auto-blocked by rule ''%s'': %.2f %s exceeded threshold %.2f.%s', rule_name, metric_value, metric_type, threshold, CASE WHEN odd THEN ' Top sources: 192.0.2.9, 192.0.2.8' ELSE '' END) AS description,
 'engine' AS blocked_by, 3600 AS duration_seconds, TIMESTAMP '2024-01-31 00:00:00' AS blocked_at, TIMESTAMP '2024-01-31 01:00:00' AS expires_at FROM (
 SELECT target AS ip, id AS alert_id, rule_name, CAST(metric_value AS DOUBLE) AS metric_value, metric_type, threshold, metric_value % 2 = 1 AS odd, row_number() OVER (PARTITION BY target ORDER BY triggered_at, id) AS rn
 FROM {_ALERTS} WHERE status = 'active' AND target_kind = 'ip' AND rule_id = 'r-3' AND target NOT IN (SELECT ip FROM {_BLOCKS} WHERE status = 'active')) WHERE rn = 1""")
def _(c):
    none = F.array().cast("array<string>")
    alerts = c.alerts.withColumn("top_sources", F.when(F.col("metric_value") % 2 == 1, F.array(F.lit("192.0.2.9"), F.lit("192.0.2.8"))).otherwise(none))
    return al.block_candidates(alerts, _rules(c), c.blocks, AS_OF).drop("status").withColumn("top_sources", F.array_join("top_sources", ", "))


@query("ALR-28_blocks_at", f"SELECT id, ip FROM {_BLOCKS} WHERE blocked_at <= TIMESTAMP '2024-01-05 03:10:00' AND TIMESTAMP '2024-01-05 03:10:00' < least(expires_at, coalesce(unblocked_at, expires_at))")
def _(c):
    return al.blocks_at(c.blocks, datetime(2024, 1, 5, 3, 10)).select("id", "ip")


@query("ALR-28_block_history", f"SELECT id, ip, status, blocked_at FROM {_BLOCKS} ORDER BY blocked_at DESC, id LIMIT 1000")
def _(c):
    return al.block_history(c.blocks, 1000).select("id", "ip", "status", "blocked_at")


@query("ALR-28_withdraw", f"SELECT id, CASE WHEN hit THEN 'withdrawn' ELSE status END AS status, CASE WHEN hit THEN 'ops' ELSE unblocked_by END AS unblocked_by, CASE WHEN hit THEN 'done' ELSE unblock_reason END AS unblock_reason FROM (SELECT *, ip = '203.0.1.2' AND status = 'active' AS hit FROM {_BLOCKS})")
def _(c):
    return al.withdraw(c.blocks, "203.0.1.2", AS_OF, "ops", "done").select("id", "status", "unblocked_by", "unblock_reason")


@query("ALR-29_threat_summary", sql("ev", f"SELECT count(*) FILTER (status = 'critical') AS critical, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'ok') AS ok FROM ({_ANNOTATED})", "r_dst"))
def _(c):
    return de.threat_summary(de.annotate_threats(_threats(c), _GRADING))


@query("ALR-29_visible_threats", sql("ev", f"SELECT target, status, worst_pct FROM ({_ANNOTATED}) WHERE status != 'ok'", "r_dst"))
def _(c):
    rows = de.visible_threats(de.annotate_threats(_threats(c), _GRADING), "worst_pct")
    return rows.select("target", "status", "worst_pct")


# ---- versioned config ----------------------------------------------------------------

_HGV = f"({fx.HOSTGROUPS})"


@query("CFG-01_latest_versions", _HG)
def _(c):
    return dims.latest_versions(c.hostgroups, "id").drop("deleted")


@query("CFG-02_upsert", f"""SELECT id, name, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM (
 SELECT id, name, updated_at, deleted FROM {_HGV} UNION ALL SELECT id, 'renamed', TIMESTAMP '2030-01-01 00:00:00', 0 FROM {_HGV} WHERE deleted = 1)) WHERE rn = 1 AND deleted = 0""")
def _(c):
    at = timeb.instant(datetime(2030, 1, 1))
    changed = c.hostgroups.filter("deleted = 1").withColumns({"name": F.lit("renamed"), "updated_at": at, "deleted": F.lit(0)})
    return dims.latest_versions(dims.upsert(c.hostgroups, changed), "id").select("id", "name", "updated_at")


@query("CFG-03_soft_delete", f"SELECT id, name FROM ({_HG}) WHERE id NOT IN ('hg-1', 'hg-2', 'hg-3')")
def _(c):
    return dims.latest_versions(dims.soft_delete(c.hostgroups, "id", ["hg-1", "hg-2", "hg-3"], datetime(2031, 1, 1)), "id").select("id", "name")


@query("CFG-04_purge_tombstones", f"SELECT id, name, deleted FROM {_HGV} WHERE NOT (deleted = 1 AND updated_at < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL '30' DAY)")
def _(c):
    return dims.purge_tombstones(c.hostgroups, datetime(2000, 1, 1), 30).select("id", "name", "deleted")


@query("CFG-05_hard_delete", f"SELECT id, count(*) AS versions FROM {_HGV} WHERE id != 'hg-5' GROUP BY 1")
def _(c):
    return dims.hard_delete(c.hostgroups, "id", "hg-5").groupBy("id").agg(F.count("*").alias("versions"))


@query("CFG-06_lookup", f"SELECT id, name, cidr FROM ({_HG}) WHERE id = 'hg-8'")
def _(c):
    return dims.lookup(c.hostgroups, "id", "hg-8").select("id", "name", "cidr")


# ---- retention -----------------------------------------------------------------------

_KNOWN = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{col}' AS ttl_column, {d} AS default_days" for t, (col, d) in ret.CATALOGUE.items())
# Policies and live retentions derived per table from row counts of the given tables.
_LIVE = """SELECT 'flows_raw' AS table_name, CAST(count(*) % 50 + 1 AS INT) AS live_days FROM events UNION ALL SELECT 'flows_log', CAST(count(*) % 70 + 1 AS INT) FROM lineitem
 UNION ALL SELECT 'alerts', CAST(count(*) % 90 + 1 AS INT) FROM orders UNION ALL SELECT 'unmanaged', CAST(count(*) AS INT) FROM customer"""
_POLICIES = """SELECT 'flows_raw' AS table_name, 'timestamp' AS ttl_column, CAST(count(*) % 40 + 2 AS INT) AS ttl_days, 1 AS enabled FROM events
 UNION ALL SELECT 'traffic_by_ip', 'ts', CAST(count(*) % 30 + 5 AS INT), 1 FROM lineitem UNION ALL SELECT 'alerts', 'triggered_at', CAST(count(*) % 90 + 1 AS INT), 1 FROM orders
 UNION ALL SELECT 'unmanaged', 'ts', 1, 1 FROM region GROUP BY 1"""


@query("RET-02_seed_policies", f"""SELECT table_name, ttl_column, CASE WHEN table_name = 'flows_log' THEN 120 ELSE coalesce(live_days, default_days) END AS ttl_days, 1 AS enabled
 FROM ({_KNOWN}) k LEFT JOIN ({_LIVE}) l USING (table_name) WHERE table_name NOT IN (SELECT table_name FROM ({_POLICIES}))""")
def _(c):
    return ret.seed_policies(c.sql(_POLICIES, "events", "lineitem", "orders", "region"), c.sql(_LIVE, "events", "lineitem", "orders", "customer"), 120)


@query("RET-03_diverging", f"SELECT table_name, ttl_days, live_days FROM ({_POLICIES}) JOIN ({_LIVE}) USING (table_name) JOIN ({_KNOWN}) USING (table_name) WHERE ttl_days != live_days")
def _(c):
    rows = ret.diverging(c.sql(_POLICIES, "events", "lineitem", "orders", "region"), c.sql(_LIVE, "events", "lineitem", "orders", "customer"))
    return rows.select("table_name", "ttl_days", "live_days")


# Managed tables and their SQL. The audit log is derived from orders, so it is judged at the end of their time.
_MANAGED = {
    "flows_raw": "f", "traffic_by_as": "r_as", "traffic_by_as_hourly": "r_ash", "traffic_by_as_daily": "r_asd", "traffic_by_link": "r_link", "traffic_by_link_hourly": "r_linkh",
    "traffic_by_link_daily": "r_linkd", "traffic_by_ip": "r_ip", "traffic_by_ip_as": "r_ipas", "traffic_by_prefix": "r_px", "flows_log": "r_log", "traffic_by_port": "r_port",
    "traffic_by_dst_1min": "r_dst", "traffic_by_src_1min": "r_src", "alerts": f"({fx.ALERTS})", "audit_log": f"({fx.AUDIT})", "bgp_blocks": f"({fx.BLOCKS})",
}
_RETAINED_AT = {t: datetime(1998, 8, 2) if t == "audit_log" else AS_OF for t in _MANAGED}


def _kept(table: str, source: str) -> str:
    column, days = ret.CATALOGUE[table]
    return f"SELECT '{table}' AS table_name, {days} AS days, count(*) FILTER ({column} >= TIMESTAMP '{_RETAINED_AT[table]:%Y-%m-%d %H:%M:%S}' - INTERVAL '{days}' DAY) AS kept, count(*) AS total FROM {source}"


@query("RET-01_catalogue_applied", sql("ev", " UNION ALL ".join(_kept(*x) for x in _MANAGED.items()), *sorted({s for s in _MANAGED.values() if s.startswith("r_")})))
def _(c):
    """Every table of the catalogue under its retention."""
    own = {"flows_raw": c.ev["flows"], "alerts": c.alerts, "audit_log": c.audit, "bgp_blocks": c.blocks}
    out = None
    for name in ret.CATALOGUE:
        rows = own[name] if name in own else c.ev[name]
        kept = ret.enforce({name: rows}, _RETAINED_AT[name])[name].agg(F.lit(name).alias("table_name"), F.lit(ret.CATALOGUE[name][1]).alias("days"), F.count("*").alias("kept"))
        n = kept.withColumn("total", rows.agg(F.count("*").alias("n")).scalar())
        out = n if out is None else out.unionByName(n)
    return out


@query("RET-04_apply_retention", sql("ev", "SELECT flow_id, timestamp FROM f WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00'"))
def _(c):
    return ret.retained(c.ev["flows"], "timestamp", 7, AS_OF).select("flow_id", "timestamp")


# ---- reports --------------------------------------------------------------------------


def _unpivot(section: str, order: str, inner: str, cells: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT row_no, '{k}' AS key, coalesce({v}, '') AS value FROM n" for k, v in cells.items())
    return f"(WITH n AS (SELECT *, row_number() OVER (ORDER BY {order}) AS row_no FROM ({inner})) SELECT '{section}' AS section, row_no, key, value FROM ({rows}))"


def _report_capacity(p: QueryParams) -> str:
    rate = f"CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / {p.step}"
    tail = QueryParams(p.end - timedelta(seconds=p.step), p.end)
    return f"""SELECT tag AS link_tag, description, capacity_mbps, coalesce(current_bps, 0) AS current_bps, coalesce(p95_bps, 0) AS p95_bps,
 CASE WHEN capacity_mbps > 0 THEN coalesce(p95_bps, 0) / (capacity_mbps * 1e6) * 100 END AS u FROM lk
 LEFT JOIN (SELECT link_tag, {q95('bps')} AS p95_bps FROM (SELECT link_tag, {tb(p.step, 'ts')} AS b, {rate} AS bps FROM r_link WHERE {cut(p)} GROUP BY 1, 2) GROUP BY 1) q ON q.link_tag = tag
 LEFT JOIN (SELECT link_tag, {big(f'floor({rate})')} AS current_bps FROM r_link WHERE {cut(tail)} GROUP BY 1) w ON w.link_tag = tag"""


def _report(frequency: str) -> str:
    p = QueryParams(*report_window(frequency, AS_OF))
    txt = lambda c: f"CAST({c} AS VARCHAR)"
    pct = lambda c: f"printf('%.2f', {c})"
    three = {k: txt(k) for k in ("total_bytes", "total_packets", "total_flows")}
    return " UNION ALL ".join((
        _unpivot("overview", "1", f"SELECT {iff('true', 'bytes_in')} AS i, {iff('true', 'bytes_out')} AS o, {iff('true', 'flow_count')} AS n, (SELECT count(DISTINCT as_number) FROM r_as WHERE {cut(p)}) AS a FROM r_link WHERE {cut(p)}",
                 {"total_bytes_in": txt("i"), "total_bytes_out": txt("o"), "total_flows": txt("n.n"), "active_as_count": txt("a")}),
        _unpivot("top_as", "total_bytes DESC, as_num", f"""SELECT as_num, {gname('as_num', 'as_name')} AS nm, coalesce(country, '') AS country, total_bytes, total_packets, total_flows, total_bytes / (SELECT sum(bytes) FROM r_as WHERE {cut(p)}) * 100 AS pc FROM (
          SELECT {grouped('as_number')} AS as_num, {TOTALS} FROM r_as WHERE {cut(p)} GROUP BY 1 ORDER BY total_bytes DESC, as_num LIMIT 20) LEFT JOIN an ON as_num = as_number""",
                 {"as_num": txt("as_num"), "as_name": "nm", "country": "country", **three, "percent": pct("pc")}),
        _unpivot("top_country", "total_bytes DESC, cc", f"""SELECT cc, total_bytes, total_packets, total_flows, total_bytes / (SELECT sum(bytes) FROM r_as WHERE {cut(p)}) * 100 AS pc FROM (
          SELECT CASE WHEN coalesce(country, '') = '' THEN 'Unknown' ELSE country END AS cc, {TOTALS} FROM r_as r LEFT JOIN an ON r.as_number = an.as_number WHERE {cut(p)} GROUP BY 1 ORDER BY total_bytes DESC, cc LIMIT 20)""",
                 {"country_code": "cc", **three, "percent": pct("pc")}),
        _unpivot("capacity", "p95_bps DESC, link_tag", _report_capacity(p),
                 {"link_tag": "link_tag", "description": "description", **{k: txt(k) for k in ("capacity_mbps", "current_bps", "p95_bps")}, "utilization_pct": pct("u")}),
        _unpivot("alerts", "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END", f"SELECT severity, count(*) AS n FROM {_ALERTS} WHERE status = 'active' GROUP BY 1",
                 {"severity": "severity", "alerts": txt("n.n")}),
    ))


@query("REP-01_report", sql("ev", _report("weekly"), "r_as", "r_link"))
def _(c):
    return reports.report(c.ev, c.links, c.as_dim, c.alerts, "weekly", AS_OF)


@query("REP-01_report_all_sections", sql("ev", _report("monthly"), "r_as", "r_link"))
def _(c):
    return reports.report(c.ev, c.links, c.as_dim, c.alerts, "monthly", AS_OF)


@query("SRC-12_report_bundle", sql("ev", _report("daily"), "r_as", "r_link"))
def _(c):
    path = scratch_dir(c.spark, "report")
    reports.write_bundle(reports.report(c.ev, c.links, c.as_dim, c.alerts, "daily", AS_OF), path)
    back = c.spark.read.schema("row_no int, key string, value string, section string").option("header", True).csv(path)
    return back.withColumn("value", F.coalesce("value", F.lit("")))


@query("REP-02_report_window", sql("ev", " UNION ALL ".join(
    f"SELECT '{n}' AS frequency, count(*) AS flows FROM f WHERE {cut(QueryParams(*report_window(n, AS_OF)), 'timestamp')}" for n in ("daily", "weekly", "monthly"))))
def _(c):
    inside = [F.when(timeb.between("timestamp", *report_window(n, AS_OF)), F.lit(n)) for n in ("daily", "weekly", "monthly")]
    rows = c.ev["flows"].select(F.explode(F.array(*inside)).alias("frequency")).filter("frequency IS NOT NULL")
    return rows.groupBy("frequency").agg(F.count("*").alias("flows"))


# ---- scalar and aggregate functions ------------------------------------------------------


@query("FUN-01_bucket_starts", sql("ev", "SELECT flow_id, date_trunc('minute', timestamp) AS minute, time_bucket(INTERVAL '5 minutes', timestamp) AS five, date_trunc('hour', timestamp) AS hour, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS day FROM f"))
def _(c):
    out = c.ev["flows"].select("flow_id", "timestamp")
    for name, seconds in (("minute", 60), ("five", 300), ("hour", 3600), ("day", 86400)):
        out = out.withColumn(name, timeb.bucket("timestamp", seconds))
    return out.drop("timestamp")


@query("FUN-02_interval_start", sql("li", f"SELECT {tb(900)} AS period, count(*) AS n FROM f GROUP BY 1"))
def _(c):
    return c.li["flows"].groupBy(timeb.bucket("timestamp", 900).alias("period")).agg(F.count("*").alias("n"))


@query("FUN-03_calendar_parts", sql("li", "SELECT isodow(timestamp) AS day, hour(timestamp) AS hour, count(*) AS n, count(DISTINCT CAST(timestamp AS DATE)) AS dates FROM f GROUP BY 1, 2"))
def _(c):
    return c.li["flows"].groupBy(timeb.iso_weekday("timestamp").alias("day"), F.hour("timestamp").alias("hour")).agg(
        F.count("*").alias("n"), F.count_distinct(F.to_date("timestamp")).alias("dates"))


@query("FUN-04_basic_aggregates", sql("li", f"SELECT link_tag, {big('sum(bytes)')} AS s, count(*) AS n, {iff('protocol = 6')} AS s_if, round(avg(packets), 6) AS a, max(bytes) AS hi, min(bytes) AS lo FROM f GROUP BY 1"))
def _(c):
    return top.volumes(c.li["flows"]).groupBy("link_tag").agg(
        F.sum("bytes").alias("s"), F.count("*").alias("n"), top.when_sum(F.col("protocol") == 6, "bytes").alias("s_if"),
        F.round(F.avg("packets"), 6).alias("a"), F.max("bytes").alias("hi"), F.min("bytes").alias("lo"))


@query("FUN-05_any_as_min", sql("li", "SELECT src_prefix, min(src_as) AS any_as FROM f GROUP BY 1"))
def _(c):
    return c.li["flows"].groupBy("src_prefix").agg(F.min("src_as").alias("any_as"))


@query("FUN-06_distinct_counts", sql("li", "SELECT protocol, count(DISTINCT src_ip) AS exact, true AS close FROM f GROUP BY 1"))
def _(c):
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("src_ip", F.lit(ro.LG_K)))
    rows = c.li["flows"].groupBy("protocol").agg(F.count_distinct("src_ip").alias("exact"), sketch.alias("estimate"))
    return rows.select("protocol", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.05).alias("close"))


@query("FUN-07_quantiles", sql("li", "SELECT protocol, quantile_cont(CAST(bytes AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(bytes AS DOUBLE), 0.95) AS p95 FROM f GROUP BY 1"))
def _(c):
    return group_quantiles(top.volumes(c.li["flows"]), ["protocol"], "bytes", {"p50": 0.5, "p95": 0.95})


@query("FUN-08_median_mad", sql("ev", """, d AS (SELECT link_tag, ts, CAST(sum(bytes_in + bytes_out) AS DOUBLE) AS bps FROM r_linkh GROUP BY 1, 2), m AS (SELECT link_tag, median(bps) AS med FROM d GROUP BY 1)
 SELECT link_tag, any_value(med) AS med, median(abs(bps - med)) AS mad FROM d JOIN m USING (link_tag) GROUP BY 1""", "r_linkh"))
def _(c):
    hours = c.ev["traffic_by_link_hourly"].groupBy("link_tag", "ts").agg((F.sum("bytes_in") + F.sum("bytes_out")).cast("double").alias("bps"))
    return de.median_mad(hours.withColumn("is_current", F.lit(False)), 2.5).select("link_tag", "med", "mad")


@query("FUN-09_least_greatest", sql("li", "SELECT src_as, dst_as, least(src_as, dst_as) AS lo, greatest(src_as, dst_as) AS hi, abs(src_as - dst_as) AS gap, count(*) AS n FROM f GROUP BY 1, 2"))
def _(c):
    a, b = F.col("src_as"), F.col("dst_as")
    sums = c.li["flows"].groupBy("src_as", "dst_as").agg(F.count("*").alias("n"))
    return sums.select("src_as", "dst_as", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.abs(a - b).alias("gap"), "n")


@query("FUN-10_conditionals", sql("li", "SELECT CASE WHEN bytes > 50000000 THEN 'large' WHEN bytes > 5000000 THEN 'medium' ELSE 'small' END AS size, count(*) AS n FROM f GROUP BY 1"))
def _(c):
    size = F.when(F.col("bytes") > 50_000_000, "large").when(F.col("bytes") > 5_000_000, "medium").otherwise("small")
    return top.volumes(c.li["flows"]).groupBy(size.alias("size")).agg(F.count("*").alias("n"))


@query("FUN-11_strings", sql("li", "SELECT CAST(protocol AS VARCHAR) || '/' || CAST(dst_port AS VARCHAR) AS k, lower(split_part(src_prefix, '/', 1)) AS net, src_prefix LIKE '203.%' AS ext, count(*) AS n FROM f GROUP BY 1, 2, 3"))
def _(c):
    k = F.concat(F.col("protocol").cast("string"), F.lit("/"), F.col("dst_port").cast("string"))
    net = F.lower(addr.strip_mapped(F.split_part("src_prefix", F.lit("/"), F.lit(1))))
    return c.li["flows"].groupBy(k.alias("k"), net.alias("net"), F.col("src_prefix").like("203.%").alias("ext")).agg(F.count("*").alias("n"))


@query("FUN-12_bit_and", sql("li", "SELECT tcp_flags & 2 AS syn, tcp_flags & 16 AS ack, count(*) AS n FROM f GROUP BY 1, 2"))
def _(c):
    bit = lambda n: F.col("tcp_flags").bitwiseAND(F.lit(n))
    return c.li["flows"].groupBy(bit(2).alias("syn"), bit(16).alias("ack")).agg(F.count("*").alias("n"))


@query("FUN-13_in_network", sql("ev", "SELECT dst_ip LIKE '198.51.100.%' AND coalesce(TRY_CAST(split_part(dst_ip, '.', 4) AS INT), 0) BETWEEN 8 AND 15 AS hit, count(*) AS n FROM f GROUP BY 1"))
def _(c):
    return c.ev["flows"].groupBy(addr.in_network("dst_ip16", "198.51.100.8/29").alias("hit")).agg(F.count("*").alias("n"))


@query("FUN-14_network_of", sql("ev", f"""SELECT CASE WHEN dst_ip LIKE '2001:db8:ff::%' THEN '2001:db8:ff::' WHEN dst_ip LIKE '2001:db8:1::%' THEN '2001:db8:1::' ELSE {net24('dst_ip')} END AS net,
 CASE WHEN dst_ip LIKE '%:%' THEN 48 ELSE 24 END AS bits, count(*) AS n FROM f GROUP BY 1, 2"""))
def _(c):
    sums = c.ev["flows"].groupBy("dst_ip16", "ip_version").agg(F.count("*").alias("n"))
    bits = F.when(F.col("ip_version") == 6, 48).otherwise(24)
    net = addr.network_of("dst_ip16", F.when(F.col("ip_version") == 6, 48).otherwise(120))
    nets = sums.select(net.alias("b"), bits.alias("bits"), "n").groupBy("b", "bits").agg(F.sum("n").alias("n"))
    return nets.select(addr.ip_text("b").alias("net"), "bits", "n")


@query("FUN-15_address_spellings", sql("ev", "SELECT src_ip, src_ip AS back, true AS same FROM f GROUP BY 1"))
def _(c):
    hosts = c.ev["flows"].select("src_ip").distinct()
    mapped = F.when(F.col("src_ip").contains("."), F.concat(F.lit("::ffff:"), "src_ip")).otherwise(F.upper("src_ip"))
    return hosts.select("src_ip", addr.ip_text(addr.to_ip16(mapped)).alias("back"), (addr.to_ip16(mapped) == addr.to_ip16("src_ip")).alias("same"))


@query("FUN-16_relative_window", sql("ev", "SELECT count(*) AS n FROM f WHERE timestamp >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '86400' SECOND"))
def _(c):
    return c.ev["flows"].filter(F.col("timestamp") >= timeb.instant(AS_OF) - F.make_dt_interval(secs=F.lit(86400))).agg(F.count("*").alias("n"))


@query("FUN-17_grouped_as", sql("li", f"SELECT dst_as, {grouped('dst_as')} AS grp, {gname(grouped('dst_as'), 'as_name')} AS name, count(*) AS n FROM f LEFT JOIN an ON dst_as = as_number GROUP BY ALL"))
def _(c):
    sums = dims.with_as_info(c.li["flows"].groupBy("dst_as").agg(F.count("*").alias("n")), c.as_dim, "dst_as")
    group = asn.grouped_as("dst_as")
    return sums.select("dst_as", group.alias("grp"), asn.grouped_as_name(group, "as_name").alias("name"), "n")


def _human(v: str, units: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {v} < {10 ** (3 * (i + 1))} THEN printf('%.{0 if i == 0 else 2}f {u}', {v} / {10 ** (3 * i)}.0)" for i, u in enumerate(units[:-1]))
    return f"CASE {cases} ELSE printf('%.2f {units[-1]}', {v} / {10 ** (3 * (len(units) - 1))}.0) END"


@query("FUN-18_humanize", sql("li", f"SELECT dst_as, {_human('b', fmt.BYTE_UNITS)} AS total, {_human('p', fmt.BPS_UNITS)} AS rate FROM (SELECT dst_as, {big('sum(bytes)')} AS b, {big('sum(packets)')} AS p FROM f GROUP BY 1)"))
def _(c):
    sums = top.volumes(c.li["flows"]).groupBy("dst_as").agg(F.sum("bytes").alias("b"), F.sum("packets").alias("p"))
    return sums.select("dst_as", fmt.humanize("b").alias("total"), fmt.humanize("p", fmt.BPS_UNITS).alias("rate"))


@query("FUN-19_rates", sql("li", f"SELECT dst_as, {big('sum(bytes)')} * 8 / 300 AS bps, {big('sum(packets)')} / 300 AS pps FROM f GROUP BY 1"))
def _(c):
    sums = top.volumes(c.li["flows"]).groupBy("dst_as").agg(F.sum("bytes").alias("b"), F.sum("packets").alias("p"))
    return sums.select("dst_as", fmt.bits_per_second("b", 300).alias("bps"), fmt.per_second("p", 300).alias("pps"))


_CODES = "SELECT DISTINCT CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE concat(chr(CAST(65 + c_custkey % 26 AS INT)), chr(CAST(97 + c_nationkey AS INT))) END AS code FROM customer"


@query("FUN-20_country_flag", f"""SELECT code, CASE WHEN regexp_matches(upper(code), '^[A-Z]{{2}}$') THEN chr(CAST(127462 + ascii(upper(code)) - 65 AS INT)) || chr(CAST(127462 + ascii(substring(upper(code), 2, 1)) - 65 AS INT)) ELSE chr(127760) END AS flag FROM ({_CODES})""")
def _(c):
    return c.sql(_CODES, "customer").select("code", fmt.country_flag("code").alias("flag"))


@query("FUN-21_arrays", sql("ev", "SELECT dst_ip, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols, count(DISTINCT protocol) AS n FROM f GROUP BY 1"))
def _(c):
    lists = c.ev["flows"].groupBy("dst_ip").agg(F.array_sort(F.collect_set("protocol")).alias("p"))
    again = lists.select("dst_ip", "p", F.explode("p").alias("one")).groupBy("dst_ip", "p").agg(F.count("one").alias("n"))
    return again.select("dst_ip", F.array_join(F.col("p").cast("array<string>"), ",").alias("protocols"), "n")


@query("FUN-22_as_labels", sql("li", f"SELECT grp, CASE WHEN grp = 4294967295 THEN 'Private / Internal' ELSE 'AS' || CAST(grp AS VARCHAR) END AS label, CASE WHEN grp != 4294967295 THEN CAST(grp AS VARCHAR) END AS key FROM (SELECT DISTINCT {grouped('src_as')} AS grp FROM f)"))
def _(c):
    groups = c.li["flows"].select(asn.grouped_as("src_as").alias("grp")).distinct()
    return groups.select("grp", asn.as_label("grp").alias("label"), asn.as_key("grp").alias("key"))


# ---- streams -------------------------------------------------------------------------------

_STREAMED = ("traffic_by_as_hourly", "traffic_by_link_hourly")


def _stream_rollups(c, runs: int = 1, source: DataFrame | None = None) -> str:
    root, ckpt = scratch_dir(c.spark, "rollups"), scratch_dir(c.spark, "rollups-ckpt")
    for _ in range(runs):
        flows = c.enriched("ev", source if source is not None else stream_of(c))
        jobs.rollup_stream(flows, [ro.ROLLUPS[n] for n in _STREAMED], root, ckpt).awaitTermination()
    return root


_AS_HOURLY = f"SELECT ts, link_tag, direction, as_number, ip_version, {SUMS} FROM r_ash GROUP BY 1, 2, 3, 4, 5"
_LINK_HOURLY = "SELECT ts, link_tag, ip_version, " + ", ".join(f"{big(f'sum({x})')} AS {x}" for x in ("bytes_in", "bytes_out", "packets_in", "packets_out", "flow_count")) + " FROM r_linkh GROUP BY 1, 2, 3"


@query("STR-01_rollup_stream", sql("ev", _AS_HOURLY, "r_ash"))
def _(c):
    return jobs.read_rollup(c.spark, _stream_rollups(c), ro.ROLLUPS["traffic_by_as_hourly"])


@query("STR-03_late_data", sql("ev", _LINK_HOURLY, "r_linkh"))
def _(c):
    """Day files read newest first, five per batch: everything but the first batch is late, nothing is lost."""
    path = scratch_dir(c.spark, "days")
    days = c.table("events").withColumn("dt", F.to_date("ts"))
    days.repartition("dt").write.partitionBy("dt").parquet(path)
    late = jobs.read_stream(c.spark, path, days.schema, max_files=5, newest_first=True).drop("dt")
    return jobs.read_rollup(c.spark, _stream_rollups(c, source=late), ro.ROLLUPS["traffic_by_link_hourly"])


_ENDED = _ISLANDS + """ SELECT target, triggered_at, last_seen_at, metric_value, heartbeats,
 CASE WHEN last_seen_at + INTERVAL '300' SECOND < TIMESTAMP '2024-02-01 00:00:00' THEN 'resolved' ELSE 'active' END AS status,
 CASE WHEN last_seen_at + INTERVAL '300' SECOND < TIMESTAMP '2024-02-01 00:00:00' THEN last_seen_at + INTERVAL '330' SECOND END AS resolved_at FROM alerts"""


def _drained(rows: DataFrame, out: str, ckpt: str) -> DataFrame:
    """Runs a stream over all its input into a folder and reads it back."""
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


@query("STR-02_sliding_stream", sql("ev", _ENDED, "r_dst"))
def _(c):
    """Minute rows in the order of time, ten days a batch, through sliding windows and the alert state in one query; a last empty minute closes the windows."""
    path, out, ckpt = (scratch_dir(c.spark, n) for n in ("minutes", "sliding-events", "sliding-ckpt"))
    minutes = c.ev["traffic_by_dst_1min"].select("ts", "dst_ip", "dst_ip16", "bytes", "packets")
    end = minutes.limit(1).withColumns({"ts": F.lit(datetime(2024, 3, 1)), "bytes": F.lit(0).cast("long"), "packets": F.lit(0).cast("long")})
    cuts = [EV_START + timedelta(days=10 * i) for i in range(4)]
    for a, b in zip(cuts, cuts[1:]):
        minutes.filter((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) | F.lit(b == cuts[-1]))).write.mode("append").parquet(path)
    end.write.mode("append").parquet(path)
    events = state.sliding_alerts(jobs.read_stream(c.spark, path, minutes.schema, max_files=1_000_000), TICKER)
    return al.alerts_of_events(_drained(events, out, ckpt), datetime(2024, 2, 1)).drop("rule_id")


@query("STR-04_alert_state", sql("ev", _ISLANDS + """, ended AS (SELECT *, lead(triggered_at) OVER (PARTITION BY target ORDER BY triggered_at) AS next FROM alerts),
 late AS (SELECT max(tick) - INTERVAL '24' HOUR AS mark FROM ticks)
 SELECT 'opened' AS event, count(*) AS n, count(DISTINCT target) AS targets FROM alerts
 UNION ALL SELECT 'heartbeat', CAST(sum(heartbeats) AS BIGINT), count(DISTINCT target) FILTER (heartbeats > 0) FROM alerts
 UNION ALL SELECT 'resolved', count(*), count(DISTINCT target) FROM ended, late WHERE next IS NOT NULL OR last_seen_at + INTERVAL '300' SECOND < mark""", "r_dst"))
def _(c):
    """Violations written as a table, then replayed through the keyed alert state; alerts silent at the watermark are resolved."""
    path, out, ckpt = (scratch_dir(c.spark, n) for n in ("ticks", "alert-events", "alert-ckpt"))
    ticks = de.sliding_ticks(c.ev["traffic_by_dst_1min"], TICKER)
    ticks.write.parquet(path)
    rows = _drained(state.alert_events(jobs.read_stream(c.spark, path, ticks.schema)), out, ckpt)
    return rows.groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


_LEFT = f"""SELECT router_ip, count(*) AS templates_left FROM (SELECT DISTINCT router_ip, {tb(encode.V9_SLOT)} AS sent_at FROM flows), range(2) v(t)
 WHERE sent_at + INTERVAL '{netflow.TEMPLATE_TTL}' SECOND >= (SELECT max(timestamp) - INTERVAL '1' HOUR FROM flows) GROUP BY 1"""


@query("STR-05_template_state", sql("ev", f"""SELECT router_ip, n, total_bytes, sources, coalesce(templates_left, 0) AS templates_left FROM (SELECT router_ip, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT src_ip) AS sources FROM flows GROUP BY 1)
 LEFT JOIN ({_LEFT}) USING (router_ip)"""))
def _(c):
    """Datagrams decoded through the template state, and the templates it still holds at the end: those of the hour behind the watermark only."""
    path, out, ckpt = (scratch_dir(c.spark, n) for n in ("datagrams", "matched", "matched-ckpt"))
    datagrams = encode.templated_datagrams(c.raw_flows("ev"))
    datagrams.write.parquet(path)
    sets = netflow.export_sets(jobs.read_stream(c.spark, path, datagrams.schema))
    rows = netflow.read_records(_drained(state.match_templates_stream(sets), out, ckpt), "netflow9")
    held = c.spark.read.format("statestore").option("stateVarName", state.TEMPLATES).load(ckpt)
    held = held.groupBy(F.col("key.router_ip").alias("router_ip")).agg(F.count("*").alias("templates_left"))
    sums = rows.groupBy("router_ip").agg(F.count("*").alias("n"), F.sum("bytes").alias("total_bytes"), F.count_distinct("src_ip").alias("sources"))
    return sums.join(held, "router_ip", "left").withColumn("templates_left", F.coalesce("templates_left", F.lit(0).cast("long")))


_SECOND = "CAST(epoch(date_trunc('second', timestamp)) AS BIGINT)"


@query("STR-06_ingest_counters", sql("ev", f"""SELECT CAST(sum(grams) AS BIGINT) AS received, coalesce(CAST(sum(grams) FILTER (s % 7 = 0) AS BIGINT), 0) AS decode_errors, CAST(sum(n) FILTER (s % 7 <> 0) AS BIGINT) AS written,
 CAST(sum(n) FILTER (s % 7 <> 0 AND s % 3 <> 0) AS BIGINT) AS clamped, coalesce(CAST(sum(grams) FILTER (s % 7 = 0) AS BIGINT), 0) AS dead_letters, CAST(sum(n) FILTER (s % 7 <> 0) AS BIGINT) AS flows
 FROM (SELECT {_SECOND} AS s, count(*) AS n, CAST(ceil(count(*) / 30.0) AS BIGINT) AS grams FROM flows WHERE ip_version = 4 AND src_as < 65536 AND dst_as < 65536 GROUP BY router_ip, timestamp, sampling_rate)"""))
def _(c):
    """Datagrams of every seventh second are cut short; two thirds are received too early or too late. Three files a batch."""
    path, root, ckpt = (scratch_dir(c.spark, n) for n in ("v5", "ingest", "ingest-ckpt"))
    second = F.unix_timestamp("received_at")
    skew = F.when(second % 3 == 1, F.expr("INTERVAL '-30' MINUTE")).when(second % 3 == 2, F.expr("INTERVAL '48' HOUR")).otherwise(F.expr("INTERVAL '10' SECOND"))
    cut = F.when(second % 7 == 0, F.substring("payload", F.lit(1), F.octet_length("payload") - 5)).otherwise(F.col("payload"))
    datagrams = encode.v5_datagrams(raw_v4(c, True)).withColumns({"payload": cut, "received_at": F.col("received_at") + skew})
    datagrams.repartition(6).write.parquet(path)
    jobs.ingest_v5(jobs.read_stream(c.spark, path, datagrams.schema, max_files=3), root, ckpt).awaitTermination()
    tables = [c.spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias(name)) for name in ("dead_letters", "flows")]
    return jobs.read_counters(c.spark, root).crossJoin(tables[0]).crossJoin(tables[1])  # one row each


@query("STR-07_back_pressure", sql("ev", "SELECT link_tag, count(*) AS n FROM f GROUP BY 1"))
def _(c):
    path, out, ckpt = (scratch_dir(c.spark, n) for n in ("paced", "paced-out", "paced-ckpt"))
    c.table("events").repartition(6).write.parquet(path)
    paced = jobs.read_stream(c.spark, path, c.table("events").schema, max_files=2)
    jobs.write_flow_stream(c.enriched("ev", paced), out, ckpt).awaitTermination()
    return c.spark.read.parquet(out).groupBy("link_tag").agg(F.count("*").alias("n"))


@query("STR-08_restart", sql("ev", _LINK_HOURLY, "r_linkh"))
def _(c):
    """The job is stopped after draining its input and started again on the same checkpoint."""
    return jobs.read_rollup(c.spark, _stream_rollups(c, runs=2), ro.ROLLUPS["traffic_by_link_hourly"])
