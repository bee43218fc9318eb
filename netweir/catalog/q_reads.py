"""Top-N, series, percentiles, capacity, change detection and flow search (TOP, SER, PCT, CAP, HEA, CHG, FLW)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..operators import capacity as cap, changes, search, series, top
from ..params import FlowFilters, QueryParams, auto_step, prior_window, route_source
from ..plans.filters import in_range
from . import fixtures as fx
from .q_flows import EV, EV_END, EV_START, LI, LI_END, LI_START, cut
from .registry import query
from .sql import AVG, TOTALS, gname, grouped, ip16, local, proto, service, sql, tb

ASN, IP, TAG = 1004, "192.0.2.7", "transit-1"
RATIO = "CASE WHEN bytes_in = 0 AND bytes_out = 0 THEN 0.0 ELSE bytes_out / greatest(bytes_in, 1) END"
CLASS = f"CASE WHEN bytes_in = 0 AND bytes_out = 0 THEN 'balanced' WHEN {RATIO} > 4 THEN 'content' WHEN {RATIO} < 0.25 THEN 'eyeball' ELSE 'balanced' END"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def iff(cond: str, col: str = "bytes") -> str:
    return big(f"coalesce(sum(CASE WHEN {cond} THEN {col} ELSE 0 END), 0)")


_IN, _OUT = iff("direction = 'in'"), iff("direction = 'out'")

# ---- top-N -----------------------------------------------------------------------


def _top_as(p: QueryParams, where: str = "", metric: str = "total_bytes") -> str:
    return f"""SELECT as_num, {gname('as_num', 'as_name')} AS as_name, coalesce(country, '') AS country, total_bytes, total_packets, total_flows, avg_pkt_size,
 bytes_in, bytes_out, {RATIO} AS ratio, {CLASS} AS class,
 total_bytes / (SELECT sum(bytes) FROM r_as WHERE {cut(p)} {where}) * 100 AS percent FROM (
 SELECT {grouped('as_number')} AS as_num, {TOTALS}, {AVG}, {iff("direction = 'in'")} AS bytes_in, {iff("direction = 'out'")} AS bytes_out
 FROM r_as WHERE {cut(p)} {where} GROUP BY 1 ORDER BY {metric} DESC, as_num LIMIT {p.limit} OFFSET {p.offset}) LEFT JOIN an ON as_num = as_number"""


@query("TOP-01_top_as", sql("li", _top_as(LI), "an", "r_as"))
def _(c):
    return top.top_as(c.li["traffic_by_as"], c.as_dim, LI)


@query("TOP-01_top_as_filtered", sql("ev", _top_as(EV.with_(offset=2), "AND direction = 'in' AND link_tag IN ('transit-2', 'core-1') AND as_number != 64500", "total_packets"), "an", "r_as"))
def _(c):
    p = EV.with_(direction="in", link_tags=("transit-2", "core-1"), exclude_as=64500, metric="packets", offset=2)
    return top.top_as(c.ev["traffic_by_as"], c.as_dim, p)


def _top_ip(where: str, p: QueryParams = LI, limit: int = 20) -> str:
    return f"""SELECT ip, t.as_number, coalesce(as_name, '') AS as_name, total_bytes, total_packets, total_flows, avg_pkt_size FROM (
 SELECT ip, as_number, {TOTALS}, {AVG} FROM r_ip WHERE {cut(p)} {where} GROUP BY 1, 2 ORDER BY total_bytes DESC, ip, as_number LIMIT {limit}) t
 LEFT JOIN an ON t.as_number = an.as_number"""


@query("TOP-02_top_ip", sql("li", _top_ip(""), "an", "r_ip"))
def _(c):
    return top.top_ip(c.li["traffic_by_ip"], c.as_dim, LI)


@query("TOP-02_top_ip_external", sql("ev", _top_ip(f"AND NOT {local('ip')}", EV), "an", "r_ip"))
def _(c):
    return top.top_ip(c.ev["traffic_by_ip"], c.as_dim, EV.with_(scope="external", local_prefixes=fx.LOCAL_PREFIXES))


_FOLD = "CASE WHEN prefix LIKE '192.0.2.%' THEN '192.0.2.0/24' WHEN prefix LIKE '198.51.100.%' THEN '198.51.100.0/24' ELSE '2001:db8:1::/48' END"


@query("TOP-03_top_prefix", sql("li", f"""SELECT grouped_prefix, t.as_number, coalesce(as_name, '') AS as_name, total_bytes, total_packets, total_flows, avg_pkt_size FROM (
 SELECT {_FOLD} AS grouped_prefix, as_number, {TOTALS}, {AVG} FROM r_px WHERE {cut(LI)} AND {local('prefix')} GROUP BY 1, 2
 ORDER BY total_bytes DESC, grouped_prefix, as_number LIMIT 20) t LEFT JOIN an ON t.as_number = an.as_number""", "an", "r_px"))
def _(c):
    return top.top_prefix(c.li["traffic_by_prefix"], c.as_dim, LI.with_(scope="internal", local_prefixes=fx.LOCAL_PREFIXES))


@query("TOP-04_top_country", sql("li", f"""SELECT country_code, total_bytes, total_packets, total_flows, total_bytes / (SELECT sum(bytes) FROM r_as WHERE {cut(LI)}) * 100 AS percent FROM (
 SELECT CASE WHEN coalesce(country, '') = '' THEN 'Unknown' ELSE country END AS country_code, {TOTALS} FROM r_as r LEFT JOIN an ON r.as_number = an.as_number
 WHERE {cut(LI)} GROUP BY 1 ORDER BY total_bytes DESC, country_code LIMIT 20)""", "an", "r_as"))
def _(c):
    return top.top_country(c.li["traffic_by_as"], c.as_dim, LI)


_PROTO = f"SELECT protocol, direction, {TOTALS} FROM r_port WHERE {cut(LI)} GROUP BY 1, 2"
_PROTO_NAMED = f"SELECT *, total_bytes / sum(total_bytes) OVER () * 100 AS percent, {proto('protocol')} AS protocol_name FROM ({_PROTO})"


@query("TOP-05_top_protocol", sql("li", _PROTO_NAMED, "r_port"))
def _(c):
    return top.top_protocol(c.li["traffic_by_port"], LI)


@query("TOP-06_top_port", sql("li", f"""SELECT *, total_bytes / sum(total_bytes) OVER () * 100 AS percent, {proto('protocol')} AS protocol_name, {service('protocol', 'port')} AS service
 FROM (SELECT protocol, port, direction, {TOTALS} FROM r_port WHERE {cut(LI)} AND port > 0 AND protocol = 6 GROUP BY 1, 2, 3
 ORDER BY total_bytes DESC, protocol, port, direction LIMIT 50)""", "r_port", "svc"))
def _(c):
    return top.top_port(c.li["traffic_by_port"], LI, protocol=6)


def _link_top_as(where: str = "") -> str:
    return f"""SELECT as_num, {gname('as_num', 'as_name')} AS as_name, total_bytes, total_packets, total_flows FROM (
 SELECT {grouped('as_number')} AS as_num, {TOTALS} FROM r_as WHERE {cut(EV)} AND link_tag = '{TAG}' {where} GROUP BY 1
 ORDER BY total_bytes DESC, as_num LIMIT 20) LEFT JOIN an ON as_num = as_number"""


@query("TOP-07_link_top_as", sql("ev", _link_top_as("AND direction = 'out'"), "an", "r_as"))
def _(c):
    return top.link_top_as(c.ev["traffic_by_as"], c.as_dim, TAG, EV.with_(direction="out"))


def _named(inner: str) -> str:
    return f"SELECT t.as_number, coalesce(as_name, '') AS as_name, total_bytes, total_packets, total_flows FROM ({inner}) t LEFT JOIN an ON t.as_number = an.as_number"


@query("TOP-08_as_peers", sql("ev", _named(f"""SELECT dst_as AS as_number, {TOTALS} FROM f WHERE {cut(EV, 'timestamp')} AND src_as = 64500 AND dst_as > 0 AND dst_as != 64500
 GROUP BY 1 ORDER BY total_bytes DESC, as_number LIMIT 20"""), "an"))
def _(c):
    return top.as_peers(c.ev["flows"], c.as_dim, 64500, EV)


@query("TOP-09_as_top_ips", sql("ev", f"""SELECT ip, {TOTALS} FROM r_ipas WHERE {cut(EV)} AND as_number = {ASN} AND {local('ip')} GROUP BY 1 ORDER BY total_bytes DESC, ip LIMIT 20""", "r_ipas"))
def _(c):
    return top.as_top_ips(c.ev["traffic_by_ip_as"], ASN, EV.with_(scope="internal", local_prefixes=fx.LOCAL_PREFIXES))


@query("TOP-10_as_remote_ips", sql("ev", f"""SELECT src_ip AS ip, {TOTALS} FROM f WHERE {cut(EV, 'timestamp')} AND src_as = {ASN} GROUP BY 1 ORDER BY total_bytes DESC, ip LIMIT 20"""))
def _(c):
    return top.as_remote_ips(c.ev["flows"], ASN, EV)


@query("TOP-11_ip_top_as", sql("ev", _named(f"""SELECT as_number, {TOTALS} FROM r_ipas WHERE {cut(EV)} AND ip = '{IP}' GROUP BY 1 ORDER BY total_bytes DESC, as_number LIMIT 20"""), "an", "r_ipas"))
def _(c):
    return top.ip_top_as(c.ev["traffic_by_ip_as"], c.as_dim, IP, EV)


@query("TOP-12_ip_peers", sql("ev", f"""SELECT ip, {TOTALS} FROM (SELECT dst_ip AS ip, bytes, packets, flow_count FROM f WHERE src_ip = '{IP}' UNION ALL
 SELECT src_ip, bytes, packets, flow_count FROM f WHERE dst_ip = '{IP}') GROUP BY 1 ORDER BY total_bytes DESC, ip LIMIT 20"""))
def _(c):
    return top.ip_peers(c.ev["flows"], IP, EV)


def _ip_info(ip: str) -> str:
    return f"""SELECT t.as_number, coalesce(as_name, '') AS as_name, prefix FROM (SELECT rk, as_number, prefix, count(*) AS seen FROM (
 SELECT 0 AS rk, src_as AS as_number, src_prefix AS prefix, timestamp FROM f WHERE src_ip = '{ip}' AND src_as > 0 UNION ALL
 SELECT 1, dst_as, dst_prefix, timestamp FROM f WHERE dst_ip = '{ip}' AND dst_as > 0) WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00'
 GROUP BY 1, 2, 3 ORDER BY rk, seen DESC, as_number, prefix LIMIT 1) t LEFT JOIN an ON t.as_number = an.as_number"""


@query("TOP-13_ip_info", sql("ev", _ip_info("2001:db8:ff::3"), "an"))
def _(c):
    return top.ip_info(c.ev["flows"], c.as_dim, "2001:db8:ff::3", EV_END)


def _link_list(p: QueryParams) -> str:
    return f"""SELECT link_tag, coalesce(description, '') AS description, coalesce(capacity_mbps, 0) AS capacity_mbps, bytes_in, bytes_out FROM (
 SELECT link_tag, {big('sum(bytes_in)')} AS bytes_in, {big('sum(bytes_out)')} AS bytes_out FROM r_link WHERE {cut(p)} GROUP BY 1) LEFT JOIN lk ON link_tag = tag"""


@query("TOP-14_link_list", sql("li", _link_list(LI), "r_link"))
def _(c):
    return top.link_list(c.li["traffic_by_link"], c.links, LI)


def _conversations(a: str, b: str, fwd: str) -> str:
    return f"""SELECT {a} AS endpoint_a, {b} AS endpoint_b, {big('sum(bytes)')} AS total_bytes, {big('sum(packets)')} AS total_packets,
 {iff(fwd)} AS fwd_bytes, {iff(fwd, 'packets')} AS fwd_packets, {iff(f'NOT ({fwd})')} AS rev_bytes, {iff(f'NOT ({fwd})', 'packets')} AS rev_packets,
 count(*) AS total_flows FROM g GROUP BY 1, 2 ORDER BY total_bytes DESC, endpoint_a, endpoint_b LIMIT 50"""


def _conv(kind: str, p: QueryParams, cols: str, a: str, b: str, fwd: str) -> str:
    return sql(kind, f", g AS (SELECT *, {cols} FROM f WHERE {cut(p, 'timestamp')}) " + _conversations(a, b, fwd))


@query("TOP-16_conversations_ip", _conv("li", LI, f"{ip16('src_ip')} AS s, {ip16('dst_ip')} AS d",
                                        "CASE WHEN s <= d THEN src_ip ELSE dst_ip END", "CASE WHEN s <= d THEN dst_ip ELSE src_ip END", "s <= d"))
def _(c):
    return top.conversations(c.li["flows_log"], "src_dst_ip", LI)


@query("TOP-17_conversations_as", _conv("li", LI, f"{grouped('src_as')} AS s, {grouped('dst_as')} AS d", "CAST(least(s, d) AS VARCHAR)", "CAST(greatest(s, d) AS VARCHAR)", "s <= d"))
def _(c):
    return top.conversations(c.li["flows_log"], "src_dst_as", LI)


@query("TOP-18_conversations_port", _conv("li", LI, "1 AS one", "CAST(protocol AS VARCHAR)", "CAST(dst_port AS VARCHAR)", "one = 1"))
def _(c):
    return top.conversations(c.li["flows_log"], "dst_port_proto", LI)


@query("TOP-19_top_sources", sql("ev", f"""SELECT target, src_ip, total_bytes, rank FROM (SELECT dst_ip AS target, src_ip, {big('sum(bytes)')} AS total_bytes,
 row_number() OVER (PARTITION BY dst_ip ORDER BY sum(bytes) DESC, src_ip) AS rank FROM f WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2) WHERE rank <= 5"""))
def _(c):
    flows = c.ev["flows"]
    targets = flows.select(F.col("dst_ip").alias("target")).distinct().withColumn("since", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return top.top_sources(flows, targets, 5).drop("since")


@query("TOP-20_display_share", sql("li", f"""SELECT as_num, total_packets, total_packets / sum(total_packets) OVER () * 100 AS share FROM (
 SELECT {grouped('as_number')} AS as_num, {TOTALS} FROM r_as WHERE {cut(LI)} GROUP BY 1 ORDER BY total_packets DESC, as_num LIMIT 20)""", "r_as"))
def _(c):
    page = top.top_as(c.li["traffic_by_as"], c.as_dim, LI.with_(metric="packets"))
    return top.display_share(page, "packets").select("as_num", "total_packets", "share")


@query("TOP-21_protocols_by_direction", sql("li", f"SELECT protocol, direction, total_bytes, row_number() OVER (PARTITION BY direction ORDER BY total_bytes DESC, protocol) AS rank FROM ({_PROTO})", "r_port"))
def _(c):
    ranked = top.protocols_by_direction(top.top_protocol(c.li["traffic_by_port"], LI))
    return ranked.select("protocol", "direction", "total_bytes", "rank")


# ---- series ------------------------------------------------------------------------

_H = tb(3600, "ts")
_SPANS = (1, 3, 5, 6, 30, 36, 48, 72, 100, 168, 500)


@query("SER-01_auto_step", sql("ev", " UNION ALL ".join(
    f"SELECT {h} AS hours, {auto_step(EV_END - timedelta(hours=h), EV_END)} AS step, count(DISTINCT {tb({1: 60, 3: 60, 5: 120, 6: 120, 30: 300, 36: 300, 48: 900, 72: 900, 100: 1800, 168: 1800, 500: 3600}[h])}) AS buckets FROM f WHERE {cut(QueryParams(EV_END - timedelta(hours=h), EV_END), 'timestamp')}"
    for h in _SPANS)))
def _(c):
    out = None
    for h in _SPANS:
        p = QueryParams(EV_END - timedelta(hours=h), EV_END)
        rows = in_range(c.ev["flows"], p.start, p.end, "timestamp").select(F.window("timestamp", f"{p.step} seconds").alias("w"))
        n = rows.agg(F.lit(h).alias("hours"), F.lit(p.step).alias("step"), F.count_distinct("w").alias("buckets"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SER-02_route_source", sql("li", f"""SELECT 'traffic_by_link' AS source, {big('sum(bytes_in + bytes_out)')} AS total_bytes FROM r_link WHERE {cut(QueryParams(LI_END - timedelta(days=60), LI_END))}
 UNION ALL SELECT 'traffic_by_link_hourly', {big('sum(bytes_in + bytes_out)')} FROM r_linkh WHERE {cut(QueryParams(LI_END - timedelta(days=400), LI_END))}
 UNION ALL SELECT 'traffic_by_link_daily', {big('sum(bytes_in + bytes_out)')} FROM r_linkd WHERE {cut(QueryParams(LI_END - timedelta(days=2400), LI_END))}""", "r_link", "r_linkh", "r_linkd"))
def _(c):
    out = None
    for days in (60, 400, 2400):
        p = QueryParams(LI_END - timedelta(days=days), LI_END)
        rows = series.source(c.li, "link", p)
        n = rows.agg(F.lit(route_source("link", p.start, p.end)).alias("source"), F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("total_bytes"))
        out = n if out is None else out.unionByName(n)
    return out


_ROLE = f"""{iff("direction = 'out'")} AS bytes_in, {iff("direction = 'in'")} AS bytes_out, {iff("direction = 'out'", 'packets')} AS packets_in, {iff("direction = 'in'", 'packets')} AS packets_out"""
_PLAIN_ROLE = f"""{iff("direction = 'in'")} AS bytes_in, {iff("direction = 'out'")} AS bytes_out, {iff("direction = 'in'", 'packets')} AS packets_in, {iff("direction = 'out'", 'packets')} AS packets_out"""
_LINK_POINT = ", ".join(f"{big(f'sum({x})')} AS {x}" for x in ("bytes_in", "bytes_out", "packets_in", "packets_out"))
RAW = QueryParams(datetime(2024, 1, 15, 10, 0, 30), datetime(2024, 1, 15, 12, 59))


@query("SER-03_as_series", sql("ev", f"SELECT {_H} AS period, {_ROLE} FROM r_as WHERE as_number = 64500 AND {cut(EV)} GROUP BY 1", "r_as"))
def _(c):
    return series.as_series(c.ev, 64500, EV)


@query("SER-03_as_series_raw", sql("ev", f"""SELECT {tb(60)} AS period, {iff('src_as = 64500')} AS bytes_in, {iff('dst_as = 64500')} AS bytes_out, {iff('src_as = 64500', 'packets')} AS packets_in,
 {iff('dst_as = 64500', 'packets')} AS packets_out FROM f WHERE (src_as = 64500 OR dst_as = 64500) AND {cut(RAW, 'timestamp')} GROUP BY 1"""))
def _(c):
    return series.as_series(c.ev, 64500, RAW)


@query("SER-04_as_link_series", sql("ev", f"SELECT {_H} AS period, link_tag, {_ROLE} FROM r_as WHERE as_number = 64500 AND ip_version = 4 AND link_tag != '' AND {cut(EV)} GROUP BY 1, 2", "r_as"))
def _(c):
    return series.as_link_series(c.ev, 64500, EV.with_(ip_version=4))


@query("SER-05_as_totals", sql("li", "SELECT " + ", ".join(
    f"""{iff(f"direction = '{d}' AND ip_version = {v}")} AS v{v}_{e}""" for v in (4, 6) for d, e in (("out", "in"), ("in", "out"))) + f" FROM r_asd WHERE as_number = {ASN} AND {cut(LI)}", "r_asd"))
def _(c):
    return series.as_totals(c.li, ASN, LI)


@query("SER-06_as_asymmetry", sql("li", f"SELECT bytes_in, bytes_out, {RATIO} AS ratio, {CLASS} AS class FROM (SELECT {_IN} AS bytes_in, {_OUT} AS bytes_out FROM r_asd WHERE as_number = {ASN} AND {cut(LI)})", "r_asd"))
def _(c):
    return series.as_asymmetry(c.li, ASN, LI)


@query("SER-07_ip_series", sql("ev", f"SELECT {_H} AS period, {_PLAIN_ROLE} FROM r_ip WHERE ip = '{IP}' AND {cut(EV)} GROUP BY 1", "r_ip"))
def _(c):
    return series.ip_series(c.ev, IP, EV)


_LINK_SERIES = f"SELECT {_H} AS period, {_LINK_POINT} FROM r_link WHERE link_tag = '{TAG}' AND {cut(EV)} GROUP BY 1"
_LINKS_SERIES = f"SELECT {_H} AS period, link_tag, {_LINK_POINT} FROM r_link WHERE {cut(EV)} GROUP BY 1, 2"


@query("SER-08_link_series", sql("ev", _LINK_SERIES, "r_link"))
def _(c):
    return series.link_series(c.ev, TAG, EV)


@query("SER-09_links_series", sql("ev", f"SELECT period, link_tag, coalesce(description, '') AS description, bytes_in, bytes_out, packets_in, packets_out FROM ({_LINKS_SERIES}) LEFT JOIN lk ON link_tag = tag", "r_link"))
def _(c):
    return series.links_series(c.ev, c.links, EV)


_LINK_AS_SERIES = f"""SELECT as_num, {gname('as_num', 'as_name')} AS as_name, total_bytes, period, bytes_in, bytes_out FROM (
 SELECT {grouped('as_number')} AS as_num, {_H} AS period, {iff("direction = 'out'")} AS bytes_in, {iff("direction = 'in'")} AS bytes_out FROM r_as WHERE link_tag = '{TAG}' AND {cut(EV)} GROUP BY 1, 2)
 JOIN (SELECT {grouped('as_number')} AS top_num, {big('sum(bytes)')} AS total_bytes FROM r_as WHERE link_tag = '{TAG}' AND {cut(EV)} GROUP BY 1 ORDER BY total_bytes DESC, top_num LIMIT 10) ON as_num = top_num
 LEFT JOIN an ON as_num = as_number"""


@query("SER-10_link_as_series", sql("ev", _LINK_AS_SERIES, "an", "r_as"))
def _(c):
    return series.link_as_series(c.ev, c.as_dim, TAG, EV)


def _top_series(top_sql: str, points_sql: str) -> str:
    nearest = lambda col: f"list_sort(list({col}))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1]"
    return f""", tops AS ({top_sql}), pts AS ({points_sql}),
 per AS (SELECT as_num, period, {big('sum(bytes_in)')} AS i, {big('sum(bytes_out)')} AS o FROM pts GROUP BY 1, 2),
 p95 AS (SELECT as_num, {nearest('i')} AS p95_in, {nearest('o')} AS p95_out FROM per GROUP BY 1)
 SELECT t.as_num, {gname('t.as_num', 'as_name')} AS as_name, total_bytes, coalesce(p95_in, 0) AS p95_in, coalesce(p95_out, 0) AS p95_out, period, link_tag, bytes_in, bytes_out, packets_in, packets_out
 FROM tops t LEFT JOIN pts ON pts.as_num = t.as_num LEFT JOIN p95 ON p95.as_num = t.as_num LEFT JOIN an ON t.as_num = an.as_number"""


@query("SER-11_top_as_series", sql("ev", _top_series(
    f"SELECT {grouped('as_number')} AS as_num, {big('sum(bytes)')} AS total_bytes FROM r_as WHERE {cut(EV)} AND as_number != 64500 GROUP BY 1 ORDER BY total_bytes DESC, as_num LIMIT 5",
    f"SELECT {grouped('as_number')} AS as_num, {_H} AS period, link_tag, {_ROLE} FROM r_as WHERE {cut(EV)} AND {grouped('as_number')} IN (SELECT as_num FROM tops) GROUP BY 1, 2, 3"), "an", "r_as"))
def _(c):
    return series.top_as_series(c.ev, c.as_dim, EV.with_(limit=5, exclude_as=64500))


_S, _D = grouped("src_as"), grouped("dst_as")


@query("SER-11_top_as_series_raw", sql("ev", _top_series(
    f"""SELECT as_num, {big('sum(bytes)')} AS total_bytes FROM (SELECT {_S} AS as_num, bytes FROM f WHERE src_as > 0 AND {cut(RAW, 'timestamp')} UNION ALL
 SELECT {_D}, bytes FROM f WHERE dst_as > 0 AND {cut(RAW, 'timestamp')}) GROUP BY 1 ORDER BY total_bytes DESC, as_num LIMIT 6""",
    f"""SELECT CASE WHEN s IN (SELECT as_num FROM tops) THEN s ELSE d END AS as_num, {tb(60)} AS period, link_tag, {iff('s IN (SELECT as_num FROM tops)')} AS bytes_in,
 {iff('d IN (SELECT as_num FROM tops)')} AS bytes_out, {iff('s IN (SELECT as_num FROM tops)', 'packets')} AS packets_in, {iff('d IN (SELECT as_num FROM tops)', 'packets')} AS packets_out
 FROM (SELECT *, {_S} AS s, {_D} AS d FROM f WHERE {cut(RAW, 'timestamp')} AND link_tag != '') WHERE s IN (SELECT as_num FROM tops) OR d IN (SELECT as_num FROM tops) GROUP BY 1, 2, 3"""), "an"))
def _(c):
    return series.top_as_series(c.ev, c.as_dim, RAW.with_(limit=6))


@query("SER-12_flow_series", sql("ev", f"SELECT ts, {big('sum(bytes)')} AS bytes, {big('sum(packets)')} AS packets FROM r_log WHERE {cut(EV)} AND dst_ip = '{IP}' AND protocol = 6 AND dst_port = 443 GROUP BY 1", "r_log"))
def _(c):
    return series.flow_series(c.ev["flows_log"], FlowFilters(EV_START, EV_END, dst_ip=IP, protocol=6, dst_port=443))


@query("SER-13_sum_link_series", sql("ev", f"SELECT {_H} AS period, {_LINK_POINT} FROM r_link WHERE {cut(EV)} GROUP BY 1", "r_link"))
def _(c):
    return series.sum_link_series(series.links_series(c.ev, c.links, EV))


_HALF = QueryParams(datetime(2024, 1, 16), EV_END)


@query("SER-14_compare_previous", sql("ev", f"""SELECT a.*, b.bytes_in AS prev_bytes_in, b.bytes_out AS prev_bytes_out, b.packets_in AS prev_packets_in, b.packets_out AS prev_packets_out FROM (
 SELECT {_H} AS period, {_LINK_POINT} FROM r_link WHERE link_tag = '{TAG}' AND {cut(_HALF)} GROUP BY 1) a LEFT JOIN (
 SELECT {_H} + INTERVAL '15' DAY AS period, {_LINK_POINT} FROM r_link WHERE link_tag = '{TAG}' AND {cut(QueryParams(*prior_window(_HALF.start, _HALF.end)))} GROUP BY 1) b ON a.period = b.period""", "r_link"))
def _(c):
    before = QueryParams(*prior_window(_HALF.start, _HALF.end))
    return series.compare_previous(series.link_series(c.ev, TAG, _HALF), series.link_series(c.ev, TAG, before), _HALF)


_DENSE = f""", s AS ({_LINKS_SERIES}), grid AS (SELECT DISTINCT period FROM s), tags AS (SELECT DISTINCT link_tag FROM s)
 SELECT grid.period, tags.link_tag, coalesce(bytes_in, 0) AS bytes_in, coalesce(bytes_out, 0) AS bytes_out, coalesce(packets_in, 0) AS packets_in, coalesce(packets_out, 0) AS packets_out
 FROM grid CROSS JOIN tags LEFT JOIN s ON s.period = grid.period AND s.link_tag = tags.link_tag"""


@query("SER-15_densify", sql("ev", _DENSE, "r_link"))
def _(c):
    return series.densify(series.links_series(c.ev, c.links, EV).drop("description"))


_AS_HOURS = f"SELECT {_H} AS period, 'all' AS link_tag, {_ROLE} FROM r_as WHERE as_number = {ASN} AND {cut(EV)} GROUP BY 1"


@query("SER-16_gap_fill", sql("ev", f""", s AS ({_AS_HOURS}), m AS (SELECT *, lag(period) OVER (ORDER BY period) AS pv, lead(period) OVER (ORDER BY period) AS nx FROM s)
 SELECT period, link_tag, bytes_in, bytes_out, packets_in, packets_out, false AS inserted FROM s
 UNION ALL SELECT period - INTERVAL '1' HOUR, link_tag, 0, 0, 0, 0, true FROM m WHERE period - pv > INTERVAL '4' HOUR OR (pv IS NULL AND period > TIMESTAMP '2024-01-01 04:00:00')
 UNION ALL SELECT period + INTERVAL '1' HOUR, link_tag, 0, 0, 0, 0, true FROM m WHERE nx - period > INTERVAL '4' HOUR OR (nx IS NULL AND period < TIMESTAMP '2024-01-30 20:00:00')""", "r_as"))
def _(c):
    points = series.as_series(c.ev, ASN, EV).withColumn("link_tag", F.lit("all"))
    return series.gap_fill(points, EV.step, EV)


@query("SER-17_infer_interval", sql("ev", f"""SELECT coalesce(min(CASE WHEN gap > 0 THEN gap END), 300) AS interval_seconds FROM (
 SELECT date_diff('second', lag(period) OVER (PARTITION BY link_tag ORDER BY period), period) AS gap FROM ({_LINKS_SERIES}))""", "r_link"))
def _(c):
    return series.infer_interval(series.links_series(c.ev, c.links, EV))


# ---- percentiles and capacity ------------------------------------------------------


def q95(col: str, q: float = 0.95) -> str:
    return big(f"floor(quantile_cont({col}, {q}))")


_BY_HOUR = f"SELECT {_H} AS period, sum(bytes_in) AS bi, sum(bytes_out) AS bo FROM r_link WHERE {{}} {cut(EV)} GROUP BY 1"
_ONE = _BY_HOUR.format(f"link_tag = '{TAG}' AND")
_BI, _BO = "CAST(bi AS DOUBLE)", "CAST(bo AS DOUBLE)"


@query("PCT-01_links_p95", sql("ev", f"SELECT {q95(_BI)} AS p95_in, {q95(_BO)} AS p95_out FROM ({_BY_HOUR.format('')})", "r_link"))
def _(c):
    return cap.links_p95(c.ev, EV)


@query("PCT-02_link_p95", sql("ev", f"SELECT {q95(_BI)} AS p95_in, {q95(_BO)} AS p95_out FROM ({_ONE})", "r_link"))
def _(c):
    return cap.link_p95(c.ev, TAG, EV)


@query("PCT-03_as_p95", sql("ev", "SELECT " + ", ".join(f"{q95(f'CAST(v{v}_{e} AS DOUBLE)')} AS p95_v{v}_{e}" for v in (4, 6) for e in ("in", "out")) + f" FROM (SELECT {_H}, " + ", ".join(
    f"""{iff(f"direction = '{d}' AND ip_version = {v}")} AS v{v}_{e}""" for v in (4, 6) for d, e in (("out", "in"), ("in", "out"))) + f" FROM r_as WHERE as_number = 64500 AND {cut(EV)} GROUP BY 1)", "r_as"))
def _(c):
    return cap.as_p95(c.ev, 64500, EV)


@query("PCT-04_link_percentiles", sql("ev", "SELECT " + ", ".join(f"{q95(x, q / 100)} AS p{q}_{e}" for x, e in ((_BI, "in"), (_BO, "out")) for q in (50, 95, 99)) + f" FROM ({_ONE})", "r_link"))
def _(c):
    return cap.link_percentiles(c.ev, TAG, EV)


_BPS = f"SELECT '{TAG}' AS link_tag, CAST(bi + bo AS BIGINT) * 8 / 3600 AS bps FROM ({_ONE})"


@query("PCT-05_link_p95_total", sql("ev", f"SELECT {q95('bps')} AS p95_bps FROM ({_BPS})", "r_link"))
def _(c):
    return cap.link_p95_total(c.ev, TAG, EV)


@query("PCT-06_nearest_rank", sql("li", f"""SELECT link_tag, list_sort(list(v))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS p95 FROM (
 SELECT link_tag, ts, {big('sum(bytes_in)')} AS v FROM r_linkd GROUP BY 1, 2) GROUP BY 1""", "r_linkd"))
def _(c):
    days = c.li["traffic_by_link_daily"].groupBy("link_tag", "ts").agg(F.sum("bytes_in").alias("v"))
    return days.groupBy("link_tag").agg(series.nearest_rank("v").alias("p95"))


YEARS = QueryParams(LI_START, LI_END)
_P95 = f"SELECT link_tag, {q95('bps')} AS p95_bps FROM (SELECT link_tag, ts, CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600 AS bps FROM r_linkd WHERE {cut(YEARS)} GROUP BY 1, 2) GROUP BY 1"
_CUR = f"SELECT link_tag, {big('floor(CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600)')} AS current_bps FROM r_linkd WHERE {cut(QueryParams(YEARS.end - timedelta(hours=1), YEARS.end))} GROUP BY 1"
_DAYS = f"SELECT link_tag, CAST(ts AS DATE) AS day, CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 86400 AS bps FROM r_linkd WHERE {cut(QueryParams(YEARS.end - timedelta(days=90), YEARS.end))} GROUP BY 1, 2"
_FIT = f"SELECT link_tag, count(*) AS n, regr_slope(bps, x) AS slope, regr_intercept(bps, x) AS intercept FROM (SELECT *, row_number() OVER (PARTITION BY link_tag ORDER BY day) - 1 AS x FROM ({_DAYS})) GROUP BY 1 HAVING count(*) >= 2"


def _level(pct: float, m: str = "slope") -> str:
    level = f"capacity_mbps * 1e6 * {pct}"
    return f"CASE WHEN {m} > 0 THEN CASE WHEN intercept + {m} * (n - 1) >= {level} THEN 0.0 ELSE greatest(({level} - intercept) / {m} - (n - 1), 0.0) END END"


_CAPACITY = f"""SELECT tag AS link_tag, description, capacity_mbps, coalesce(current_bps, 0) AS current_bps, coalesce(p95_bps, 0) AS p95_bps,
 CASE WHEN capacity_mbps > 0 THEN coalesce(p95_bps, 0) / (capacity_mbps * 1e6) * 100 END AS utilization_pct, round(coalesce(s, 0.0), 6) AS trend_bps_per_day,
 round({_level(0.8, 's')}, 6) AS forecast_days_80, round({_level(0.95, 's')}, 6) AS forecast_days_95, round({_level(1.0, 's')}, 6) AS forecast_days_100
 FROM (SELECT lk.*, p.p95_bps, u.current_bps, fit.n, fit.intercept, CASE WHEN capacity_mbps > 0 THEN fit.slope END AS s
 FROM lk LEFT JOIN ({_P95}) p ON p.link_tag = tag LEFT JOIN ({_CUR}) u ON u.link_tag = tag LEFT JOIN ({_FIT}) fit ON fit.link_tag = tag)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in columns})


@query("CAP-01_links_capacity", sql("li", _CAPACITY, "r_linkd"))
def _(c):
    rows = cap.links_capacity(c.li, c.links, YEARS)
    return _rounded(rows, "trend_bps_per_day", "forecast_days_80", "forecast_days_95", "forecast_days_100")


@query("CAP-02_bucket_p95_by_link", sql("li", _P95, "r_linkd"))
def _(c):
    return cap.bucket_p95_by_link(c.li, YEARS)


_DAY = QueryParams(EV_START, datetime(2024, 1, 30, 12))


@query("CAP-03_current_by_link", sql("ev", f"SELECT link_tag, {big('floor(CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600)')} AS current_bps FROM r_link WHERE {cut(QueryParams(_DAY.end - timedelta(hours=1), _DAY.end))} GROUP BY 1", "r_link"))
def _(c):
    return cap.current_by_link(c.ev, _DAY)


@query("CAP-04_daily_by_link", sql("li", _DAYS, "r_linkd"))
def _(c):
    return cap.daily_by_link(c.li["traffic_by_link_daily"], YEARS)


@query("CAP-05_trend", sql("li", f"SELECT link_tag, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM ({_FIT})", "r_linkd"))
def _(c):
    return _rounded(cap.trend(cap.daily_by_link(c.li["traffic_by_link_daily"], YEARS)), "slope", "intercept")


@query("CAP-06_days_to_level", sql("li", f"""SELECT link_tag, round(CASE WHEN slope > 0 THEN CASE WHEN intercept + slope * (n - 1) >= 2e6 THEN 0.0 ELSE greatest((2e6 - intercept) / slope - (n - 1), 0.0) END END, 6) AS days FROM ({_FIT})""", "r_linkd"))
def _(c):
    fit = cap.trend(cap.daily_by_link(c.li["traffic_by_link_daily"], YEARS))
    return _rounded(fit.select("link_tag", cap.days_to_level("slope", "intercept", F.col("n") - 1, F.lit(2e6)).alias("days")), "days")


def _samples(c) -> DataFrame:
    return cap._samples(c.ev, TAG, EV)


_THIN = f""", s AS (SELECT bps, row_number() OVER (ORDER BY bps DESC) - 1 AS r, count(*) OVER () AS n FROM ({_BPS})),
 ix AS (SELECT DISTINCT i, i * (n - 1) // 99 AS r FROM (SELECT n FROM s LIMIT 1), range(100) t(i)),
 thin AS (SELECT i, bps, count(*) OVER () AS m FROM ix JOIN s USING (r))"""


@query("CAP-08_downsample", sql("ev", _THIN + f" SELECT '{TAG}' AS link_tag, i, bps FROM thin", "r_link"))
def _(c):
    return cap.downsample_desc(_samples(c), 100)


@query("CAP-09_histogram", sql("ev", f""", s AS ({_BPS}), e AS (SELECT min(bps) AS lo, max(bps) AS hi FROM s), hb AS (SELECT CAST(i AS INT) AS bin, lo, (hi - lo) / 20 AS w FROM e, range(20) t(i))
 SELECT '{TAG}' AS link_tag, bin, lo + bin * w AS lower_bps, lo + (bin + 1) * w AS upper_bps,
 (SELECT count(*) FROM s WHERE least(floor((bps - hb.lo) / hb.w), 19) = hb.bin) AS samples FROM hb""", "r_link"))
def _(c):
    return cap.histogram(_samples(c))


@query("CAP-10_duration_axis", sql("ev", _THIN + f" SELECT '{TAG}' AS link_tag, i, bps, i / (m - 1) * 100 AS pct FROM thin", "r_link"))
def _(c):
    return cap.duration_axis(cap.downsample_desc(_samples(c), 100))


@query("CAP-11_soonest_saturation", sql("li", f"SELECT link_tag, least(forecast_days_80, forecast_days_95, forecast_days_100) AS soonest_days FROM ({_CAPACITY})", "r_linkd"))
def _(c):
    return _rounded(cap.soonest_saturation(cap.links_capacity(c.li, c.links, YEARS)).select("link_tag", "soonest_days"), "soonest_days")


_UTILIZATION = f"SELECT '{TAG}' AS link_tag, p95_bps, p95_bps / (10000 * 1e6) * 100 AS utilization_pct FROM (SELECT {q95('bps')} AS p95_bps FROM ({_BPS}))"


@query("CAP-12_link_utilization", sql("ev", _UTILIZATION, "r_link"))
def _(c):
    return cap.link_utilization(c.ev, c.links, TAG, EV)


_HEAT = f"""SELECT isodow(ts) AS day, hour(ts) AS hour, avg(bps) AS mean_bps, max(bps) AS peak_bps FROM (
 SELECT ts, CAST(sum(bytes_in) AS BIGINT) * 8 / 3600 AS bps FROM r_linkh WHERE {cut(LI)} AND ip_version = 4 GROUP BY 1) GROUP BY 1, 2"""


@query("HEA-01_traffic_heatmap", sql("li", f"SELECT day, hour, round(mean_bps, 3) AS mean_bps, peak_bps FROM ({_HEAT})", "r_linkh"))
def _(c):
    cells = cap.traffic_heatmap(c.li["traffic_by_link_hourly"], LI.with_(direction="in", ip_version=4))
    return cells.withColumn("mean_bps", F.round("mean_bps", 3))


@query("HEA-02_dense_heatmap", sql("ev", """SELECT CAST(i // 24 + 1 AS INT) AS day, CAST(i % 24 AS INT) AS hour, coalesce(round(mean_bps, 3), 0.0) AS mean_bps, coalesce(peak_bps, 0.0) AS peak_bps FROM range(168) t(i) LEFT JOIN (
 SELECT isodow(ts) AS day, hour(ts) AS hour, avg(bps) AS mean_bps, max(bps) AS peak_bps FROM (SELECT ts, CAST(sum(bytes_in + bytes_out) AS BIGINT) * 8 / 3600 AS bps FROM r_linkh WHERE link_tag = 'core-1' GROUP BY 1) GROUP BY 1, 2) h
 ON h.day = i // 24 + 1 AND h.hour = i % 24""", "r_linkh"))
def _(c):
    cells = cap.traffic_heatmap(c.ev["traffic_by_link_hourly"], EV.with_(link_tags=("core-1",)))
    return cap.dense_heatmap(cells).withColumn("mean_bps", F.round("mean_bps", 3))


# ---- changes -----------------------------------------------------------------------

MOVE = QueryParams(datetime(1998, 6, 4), LI_END)
_PRIOR = QueryParams(prior_window(MOVE.start, MOVE.end)[0], MOVE.end)


def _cp(start: str) -> str:
    return f"{iff(f'ts >= {start}')} AS current, {iff(f'ts < {start}')} AS previous"


_M = "TIMESTAMP '1998-06-04 00:00:00'"


def _movers(dim: str, key: str, group: str, label: str, limit: int = 50) -> str:
    return f"""SELECT '{dim}' AS dimension, CAST({key} AS VARCHAR) AS key, {label} AS label, current, previous, current - previous AS delta,
 CASE WHEN previous > 0 THEN (current - previous) / previous * 100 ELSE 0.0 END AS pct FROM (
 SELECT * FROM ({group}) WHERE current > 0 OR previous > 0 ORDER BY abs(current - previous) DESC, {key} LIMIT {limit})"""


_AS_MOVE = f"SELECT {grouped('as_number')} AS entity, {_cp(_M)} FROM r_asd WHERE {cut(_PRIOR)} GROUP BY 1"


@query("CHG-01_prior_window", sql("ev", f"""SELECT {iff("timestamp >= TIMESTAMP '2024-01-16 00:00:00'")} AS current, {iff("timestamp < TIMESTAMP '2024-01-16 00:00:00'")} AS previous FROM f WHERE {cut(EV, 'timestamp')}"""))
def _(c):
    start, mid = prior_window(_HALF.start, _HALF.end)
    rows = in_range(top.volumes(c.ev["flows"]), start, _HALF.end, "timestamp")
    now = F.col("timestamp") >= F.lit(mid.isoformat(sep=" ")).cast("timestamp_ntz")
    return rows.agg(top.when_sum(now, "bytes").alias("current"), top.when_sum(~now, "bytes").alias("previous"))


_AS_MOVERS = _movers("as", "entity", _AS_MOVE, gname("entity", "(SELECT as_name FROM an WHERE as_number = entity)"))


@query("CHG-02_movers_as", sql("li", _AS_MOVERS, "an", "r_asd"))
def _(c):
    return changes.movers(c.li, c.as_dim, "as", MOVE)


@query("CHG-03_movers_country", sql("li", _movers("country", "entity", f"""SELECT CASE WHEN coalesce(country, '') = '' THEN 'Unknown' ELSE country END AS entity, {_cp(_M)}
 FROM r_asd r LEFT JOIN an ON r.as_number = an.as_number WHERE {cut(_PRIOR)} GROUP BY 1""", "''"), "an", "r_asd"))
def _(c):
    return changes.movers(c.li, c.as_dim, "country", MOVE)


@query("CHG-04_movers_prefix", sql("li", _movers("prefix", "entity", f"SELECT prefix AS entity, {_cp(_M)}, min(as_number) AS label_as FROM r_px WHERE {cut(_PRIOR)} GROUP BY 1",
                                                 "coalesce((SELECT as_name FROM an WHERE as_number = label_as), '')"), "an", "r_px"))
def _(c):
    return changes.movers(c.li, c.as_dim, "prefix", MOVE)


@query("CHG-05_movers_port", sql("li", _movers("port", "entity", f"SELECT CAST(protocol AS VARCHAR) || '/' || CAST(port AS VARCHAR) AS entity, {_cp(_M)} FROM r_port WHERE {cut(_PRIOR)} AND port > 0 GROUP BY 1", "''"), "r_port"))
def _(c):
    return changes.movers(c.li, c.as_dim, "port", MOVE)


@query("CHG-06_split_movers", sql("li", f"SELECT CASE WHEN delta > 0 THEN 'gainer' ELSE 'loser' END AS side, key, delta FROM ({_AS_MOVERS}) WHERE delta != 0", "an", "r_asd"))
def _(c):
    split = changes.split_movers(changes.movers(c.li, c.as_dim, "as", MOVE))
    side = lambda part, name: split[part].select(F.lit(name).alias("side"), "key", "delta")
    return side("gainers", "gainer").unionByName(side("losers", "loser"))


TALK = QueryParams(datetime(2024, 1, 30, 12), EV_END)
_T, _TP = "TIMESTAMP '2024-01-30 12:00:00'", QueryParams(datetime(2024, 1, 30), EV_END)


def _talkers(dim: str, group: str, label: str) -> str:
    return f"""SELECT '{dim}' AS dimension, CAST(entity AS VARCHAR) AS key, {label} AS label, CASE WHEN current > 0 THEN 'new' ELSE 'gone' END AS status, greatest(current, previous) AS bytes FROM (
 SELECT * FROM ({group}) WHERE (current = 0 AND previous > 0) OR (previous = 0 AND current > 0) ORDER BY greatest(current, previous) DESC, entity LIMIT 50)"""


_TALK_AS = _talkers("as", f"SELECT {grouped('as_number')} AS entity, {_cp(_T)} FROM r_as WHERE {cut(_TP)} GROUP BY 1", gname("entity", "(SELECT as_name FROM an WHERE as_number = entity)"))
_TALK_IP = _talkers("ip", f"SELECT ip AS entity, {_cp(_T)} FROM r_ip WHERE {cut(_TP)} GROUP BY 1", "''")


@query("CHG-07_talkers_as", sql("ev", _TALK_AS, "an", "r_as"))
def _(c):
    return changes.talkers(c.ev, c.as_dim, "as", TALK)


@query("CHG-08_talkers_ip", sql("ev", _TALK_IP, "r_ip"))
def _(c):
    return changes.talkers(c.ev, c.as_dim, "ip", TALK)


_TALK3 = QueryParams(datetime(2024, 1, 30, 23), EV_END)
_T3, _TP3 = "TIMESTAMP '2024-01-30 23:00:00'", QueryParams(datetime(2024, 1, 30, 22), EV_END)


@query("CHG-09_talkers_prefix", sql("ev", _talkers("prefix", f"SELECT prefix AS entity, {_cp(_T3)}, min(as_number) AS label_as FROM r_px WHERE {cut(_TP3)} GROUP BY 1",
                                                   "coalesce((SELECT as_name FROM an WHERE as_number = label_as), '')"), "an", "r_px"))
def _(c):
    return changes.talkers(c.ev, c.as_dim, "prefix", _TALK3)


@query("CHG-10_merged_rankings", sql("ev", f"SELECT * FROM ({_TALK_AS}) UNION ALL SELECT * FROM ({_TALK_IP})", "an", "r_as", "r_ip"))
def _(c):
    return changes.merged_talkers(changes.talkers(c.ev, c.as_dim, "as", TALK), changes.talkers(c.ev, c.as_dim, "ip", TALK))


@query("CHG-10_merged_movers", sql("li", f"SELECT * FROM ({_AS_MOVERS}) WHERE delta != 0", "an", "r_asd"))
def _(c):
    return changes.merged_movers(changes.split_movers(changes.movers(c.li, c.as_dim, "as", MOVE)))


# ---- flow search ---------------------------------------------------------------------

_TUPLE = "link_tag, src_ip, dst_ip, src_as, dst_as, protocol, src_port, dst_port, ip_version"
_FIND = f"""SELECT {_TUPLE}, min(ts) AS ts, min(tcp_flags) AS tcp_flags, {TOTALS} FROM r_log WHERE {cut(EV)} AND dst_ip LIKE '192.0.2.%' GROUP BY {_TUPLE}
 HAVING sum(bytes) >= 10000000 ORDER BY ts DESC, {_TUPLE} LIMIT 1000"""
FIND = FlowFilters(EV_START, EV_END, dst_ip="192.0.2.0/24", min_bytes=10_000_000, order_by="ts", limit=1000)


@query("FLW-01_search_flows", sql("ev", _FIND, "r_log"))
def _(c):
    return search.search_flows(c.ev["flows_log"], FIND)


@query("FLW-02_decorate", sql("ev", f"SELECT src_ip, dst_ip, src_port, dst_port, {proto('protocol')} AS protocol_name, {service('protocol', 'dst_port')} AS service, total_bytes FROM ({_FIND})", "r_log", "svc"))
def _(c):
    rows = search.decorate(search.search_flows(c.ev["flows_log"], FIND))
    return rows.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol_name", "service", "total_bytes")


# ---- bundles: every part with its values ---------------------------------------------

# part -> (columns that name a row, columns that hold its values, SQL of the part)
Part = tuple[tuple[str, ...], tuple[str, ...], str]
_POINT = ("bytes_in", "bytes_out", "packets_in", "packets_out")
_VOLUMES = ("total_bytes", "total_packets", "total_flows")


def values(bundle: dict[str, DataFrame], shape: dict[str, Part]) -> DataFrame:
    """All values of a bundle in long form: part, key of the row, name and value."""
    out = None
    for part, (keys, measures, _) in shape.items():
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in measures]))
        rows = bundle[part].select(F.lit(part).alias("part"), key.alias("key"), cells.alias("c")).select("part", "key", "c.name", "c.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def values_sql(shape: dict[str, Part], before: str = "") -> str:
    def text(keys: tuple[str, ...]) -> str:
        return " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) or "''"

    cells = [
        f"SELECT '{part}' AS part, {text(keys)} AS key, '{m}' AS name, CAST({m} AS DOUBLE) AS value FROM ({inner})"
        for part, (keys, measures, inner) in shape.items() for m in measures
    ]
    return f"{before} {' UNION ALL '.join(cells)}"


_VERSIONED = tuple((v, d, e) for v in (4, 6) for d, e in (("out", "in"), ("in", "out")))


def _as_links(version: int) -> str:
    return f"SELECT {_H} AS period, link_tag, {_ROLE} FROM r_as WHERE as_number = {ASN} AND ip_version = {version} AND link_tag != '' AND {cut(EV)} GROUP BY 1, 2"


def _split(v: int, d: str, e: str) -> str:
    return iff(f"direction = '{d}' AND ip_version = {v}") + f" AS v{v}_{e}"


_OF_AS = f"FROM r_as WHERE as_number = {ASN} AND {cut(EV)}"
_AS_DETAIL: dict[str, Part] = {
    "series": (("period",), _POINT, f"SELECT {_H} AS period, {_ROLE} {_OF_AS} GROUP BY 1"),
    "links_v4": (("period", "link_tag"), _POINT, _as_links(4)),
    "links_v6": (("period", "link_tag"), _POINT, _as_links(6)),
    "totals": ((), tuple(f"v{v}_{e}" for v, _, e in _VERSIONED), f"SELECT {', '.join(_split(*x) for x in _VERSIONED)} {_OF_AS}"),
    "p95": ((), tuple(f"p95_v{v}_{e}" for v, _, e in _VERSIONED), "SELECT " + ", ".join(f"coalesce({q95(f'CAST(v{v}_{e} AS DOUBLE)')}, 0) AS p95_v{v}_{e}" for v, _, e in _VERSIONED)
            + f" FROM (SELECT {_H}, {', '.join(_split(*x) for x in _VERSIONED)} {_OF_AS} GROUP BY 1)"),
    "asymmetry": (("class",), ("bytes_in", "bytes_out", "ratio"), f"SELECT bytes_in, bytes_out, {RATIO} AS ratio, {CLASS} AS class FROM (SELECT {_IN} AS bytes_in, {_OUT} AS bytes_out {_OF_AS})"),
    "info": (("as_name", "country"), ("as_number",), f"SELECT * FROM an WHERE as_number = {ASN}"),
}


@query("TOP-22_as_detail", sql("ev", values_sql(_AS_DETAIL), "an", "r_as"))
def _(c):
    return values({
        "series": series.as_series(c.ev, ASN, EV),
        "links_v4": series.as_link_series(c.ev, ASN, EV.with_(ip_version=4)),
        "links_v6": series.as_link_series(c.ev, ASN, EV.with_(ip_version=6)),
        "totals": series.as_totals(c.ev, ASN, EV),
        "p95": cap.as_p95(c.ev, ASN, EV),
        "asymmetry": series.as_asymmetry(c.ev, ASN, EV),
        "info": c.as_dim.filter(F.col("as_number") == ASN),
    }, _AS_DETAIL)


_IP_DETAIL: dict[str, Part] = {
    "series": (("period",), _POINT, f"SELECT {_H} AS period, {_PLAIN_ROLE} FROM r_ip WHERE ip = '{IP}' AND {cut(EV)} GROUP BY 1"),
    "top_as": (("as_number", "as_name"), _VOLUMES, _named(f"SELECT as_number, {TOTALS} FROM r_ipas WHERE {cut(EV)} AND ip = '{IP}' GROUP BY 1 ORDER BY total_bytes DESC, as_number LIMIT 20")),
    "peers": (("ip",), _VOLUMES, f"""SELECT ip, {TOTALS} FROM (SELECT dst_ip AS ip, bytes, packets, flow_count FROM f WHERE src_ip = '{IP}' AND {cut(EV, 'timestamp')} UNION ALL
 SELECT src_ip, bytes, packets, flow_count FROM f WHERE dst_ip = '{IP}' AND {cut(EV, 'timestamp')}) GROUP BY 1 ORDER BY total_bytes DESC, ip LIMIT 20"""),
    "info": (("as_name", "prefix"), ("as_number",), _ip_info(IP)),
}


@query("TOP-23_ip_detail", sql("ev", values_sql(_IP_DETAIL), "an", "r_ip", "r_ipas"))
def _(c):
    return values({
        "series": series.ip_series(c.ev, IP, EV),
        "top_as": top.ip_top_as(c.ev["traffic_by_ip_as"], c.as_dim, IP, EV),
        "peers": top.ip_peers(c.ev["flows"], IP, EV.with_(limit=20)),
        "info": top.ip_info(c.ev["flows"], c.as_dim, IP, EV_END),
    }, _IP_DETAIL)


_LINK_DETAIL: dict[str, Part] = {
    "series": (("period",), _POINT, _LINK_SERIES),
    "top_as": (("as_num", "as_name"), _VOLUMES, _link_top_as()),
    "p95": ((), ("p95_in", "p95_out"), f"SELECT {q95(_BI)} AS p95_in, {q95(_BO)} AS p95_out FROM ({_ONE})"),
    "percentiles": ((), tuple(f"p{q}_{e}" for q in (50, 95, 99) for e in ("in", "out")), "SELECT " + ", ".join(f"{q95(x, q / 100)} AS p{q}_{e}" for x, e in ((_BI, "in"), (_BO, "out")) for q in (50, 95, 99)) + f" FROM ({_ONE})"),
    "as_series": (("as_num", "as_name", "period"), ("total_bytes", "bytes_in", "bytes_out"), _LINK_AS_SERIES),
    "utilization": (("link_tag",), ("p95_bps", "utilization_pct"), _UTILIZATION),
}


@query("TOP-24_link_detail", sql("ev", values_sql(_LINK_DETAIL), "an", "r_link", "r_as"))
def _(c):
    return values({
        "series": series.link_series(c.ev, TAG, EV),
        "top_as": top.link_top_as(c.ev["traffic_by_as"], c.as_dim, TAG, EV),
        "p95": cap.link_p95(c.ev, TAG, EV),
        "percentiles": cap.link_percentiles(c.ev, TAG, EV),
        "as_series": series.link_as_series(c.ev, c.as_dim, TAG, EV),
        "utilization": cap.link_utilization(c.ev, c.links, TAG, EV),
    }, _LINK_DETAIL)


_OVERVIEW: dict[str, Part] = {
    "totals": ((), ("total_bytes_in", "total_bytes_out", "total_flows", "active_as_count"), f"""SELECT {big('sum(bytes_in)')} AS total_bytes_in, {big('sum(bytes_out)')} AS total_bytes_out, {big('sum(flow_count)')} AS total_flows,
 (SELECT count(DISTINCT as_number) FROM r_as WHERE {cut(EV)}) AS active_as_count FROM r_link WHERE {cut(EV)}"""),
    "top_as": (("as_num", "as_name", "country", "class"), (*_VOLUMES, "avg_pkt_size", "bytes_in", "bytes_out", "ratio", "percent"), _top_as(EV.with_(limit=10))),
    "top_ip": (("ip", "as_number", "as_name"), (*_VOLUMES, "avg_pkt_size"), _top_ip("", EV, 10)),
    "links": (("link_tag", "description"), ("capacity_mbps", "bytes_in", "bytes_out"), _link_list(EV)),
}


@query("TOP-15_overview", sql("ev", values_sql(_OVERVIEW), "an", "r_link", "r_as", "r_ip"))
def _(c):
    return values(top.overview(c.ev["traffic_by_link"], c.ev["traffic_by_as"], c.ev["traffic_by_ip"], c.links, c.as_dim, EV), _OVERVIEW)


_CURVE = f""", s AS (SELECT bps, row_number() OVER (ORDER BY bps DESC) - 1 AS r, count(*) OVER () AS n FROM ({_BPS})),
 ix AS (SELECT DISTINCT i * (n - 1) // 499 AS r FROM (SELECT n FROM s LIMIT 1), range(500) t(i)),
 pts AS (SELECT row_number() OVER (ORDER BY r) - 1 AS i, bps, count(*) OVER () AS m FROM ix JOIN s USING (r)),
 e AS (SELECT min(bps) AS lo, max(bps) AS hi FROM s), hb AS (SELECT CAST(i AS INT) AS bin, lo, (hi - lo) / 20 AS w FROM e, range(20) t(i))"""
_LOAD_CURVE: dict[str, Part] = {
    "quantiles": (("link_tag",), ("sample_count", "p50", "p90", "p95", "p99", "p100"), f"SELECT '{TAG}' AS link_tag, count(*) AS sample_count, " + ", ".join(f"quantile_cont(bps, {q / 100}) AS p{q}" for q in (50, 90, 95, 99, 100)) + " FROM s"),
    "points": (("link_tag", "i"), ("bps", "pct"), f"SELECT '{TAG}' AS link_tag, i, bps, CASE WHEN m > 1 THEN i / (m - 1) * 100 ELSE 0.0 END AS pct FROM pts"),
    "histogram": (("link_tag", "bin"), ("lower_bps", "upper_bps", "samples"), f"""SELECT '{TAG}' AS link_tag, bin, lo + bin * w AS lower_bps, lo + (bin + 1) * w AS upper_bps,
 (SELECT count(*) FROM s WHERE least(floor((bps - hb.lo) / hb.w), 19) = hb.bin) AS samples FROM hb"""),
}


@query("CAP-07_load_curve", sql("ev", values_sql(_LOAD_CURVE, _CURVE), "r_link"))
def _(c):
    return values(cap.load_curve(c.ev, TAG, EV), _LOAD_CURVE)
