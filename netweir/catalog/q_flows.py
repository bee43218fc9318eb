"""Sources, enrichment, rollups, filters, joins (SRC, ENR, ROL, FLT, JON, SET)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import addr, asn, names
from ..functions.timeb import instant
from ..operators import alerts as al, dims, enrich, search, series, top
from ..operators.detect import resolve_scopes
from ..operators.scopes import within
from ..operators.retention import catalogue, storage_stats
from ..params import FlowFilters, QueryParams, order_column, resolve_window
from ..plans import filters, rollup as ro
from ..plans.sizing import scratch_dir
from ..sources import netflow, sflow, tables
from ..streaming import jobs
from . import encode, fixtures as fx
from .registry import query
from .sql import LINK_SUMS, SERVICES, SUMS, TOTALS, grouped, ip16, local, net24, plain, proto, sql, tb

EV_START, EV_END = datetime(2024, 1, 1), datetime(2024, 1, 31)
LI_START, LI_END = datetime(1995, 1, 1), datetime(2001, 11, 5)
EV = QueryParams(EV_START, EV_END)
LI = QueryParams(LI_START, LI_END)


def cut(p: QueryParams, ts: str = "ts") -> str:
    return f"{ts} >= TIMESTAMP '{p.start:%Y-%m-%d %H:%M:%S}' AND {ts} < TIMESTAMP '{p.end:%Y-%m-%d %H:%M:%S}'"


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# ---- sources ---------------------------------------------------------------------

_TEN = QueryParams(datetime(2024, 1, 10), datetime(2024, 1, 20))


@query("SRC-01_read_flows", sql("ev", f"""SELECT CAST(timestamp AS DATE) AS dt, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM f WHERE {cut(_TEN, 'timestamp')} GROUP BY 1"""))
def _(c):
    path = scratch_dir(c.spark, "flows")
    tables.write_flows(c.ev["flows"], path)
    rows = tables.read_flows(c.spark, path, _TEN.start, _TEN.end)
    return rows.groupBy("dt").agg(F.count("*").alias("n"), F.sum(F.col("bytes") * F.col("sampling_rate")).alias("total_bytes"))


@query("SRC-02_flow_sink", sql("ev", """SELECT CAST(timestamp AS DATE) AS dt, link_tag, count(*) AS n FROM f GROUP BY 1, 2"""))
def _(c):
    path, ckpt = scratch_dir(c.spark, "sink"), scratch_dir(c.spark, "sink-ckpt")
    jobs.write_flow_stream(c.enriched("ev", stream_of(c)), path, ckpt).awaitTermination()
    return c.spark.read.parquet(path).groupBy("dt", "link_tag").agg(F.count("*").alias("n"))


def stream_of(c, name: str = "events") -> DataFrame:
    return jobs.read_stream(c.spark, c.dir, c.table(name).schema, files=f"{name}.parquet")


_V4 = "ip_version = 4 AND src_as < 65536 AND dst_as < 65536"
_DECODED = ["router_ip", "timestamp", "src_ip", "dst_ip", "src_as", "dst_as", "src_prefix", "dst_prefix", "protocol", "src_port",
            "dst_port", "tcp_flags", "bytes", "packets", "sampling_rate", "in_interface", "out_interface"]
_DECODED_SQL = f"""SELECT router_ip, {{ts}} AS timestamp, src_ip, dst_ip, src_as, dst_as, {net24('src_ip')} || '/24' AS src_prefix,
 {net24('dst_ip')} || '/24' AS dst_prefix, protocol, src_port, dst_port, tcp_flags, bytes, packets, sampling_rate, in_interface, out_interface
 FROM flows WHERE {{cond}}"""


_TEMPLATED = [*_DECODED, "ip_version", "direction"]
_MASKED = lambda ip: f"CASE WHEN ip_version = 6 THEN regexp_extract({ip}, '^([0-9a-f]+:[0-9a-f]+:[0-9a-f]+)::', 1) || '::/48' ELSE {net24(ip)} || '/24' END"
_SENT = f"""(SELECT *, max(timestamp) OVER (PARTITION BY router_ip, slot, ip_version, chunk) AS sent FROM (
 SELECT *, (row_number() OVER (PARTITION BY router_ip, slot, ip_version ORDER BY flow_id) - 1) // {encode.RECORDS} AS chunk FROM (SELECT *, {tb(encode.V9_SLOT)} AS slot FROM flows)))"""
_DATA_SETS = f"(SELECT DISTINCT router_ip, slot, ip_version, chunk, sent FROM {_SENT})"
_TEMPLATED_SQL = f"""SELECT router_ip, date_trunc('second', sent) AS timestamp, src_ip, dst_ip, src_as, dst_as, {_MASKED('src_ip')} AS src_prefix,
 {_MASKED('dst_ip')} AS dst_prefix, protocol, src_port, dst_port, tcp_flags, bytes, packets, sampling_rate, in_interface, out_interface, ip_version,
 CASE WHEN flow_id % 2 = 1 THEN 'out' ELSE 'in' END AS direction FROM {_SENT}"""


def raw_v4(c, small_as: bool = False) -> DataFrame:
    rows = c.raw_flows("ev").filter("ip_version = 4")
    return rows.filter("src_as < 65536 AND dst_as < 65536") if small_as else rows


@query("SRC-03_decode_netflow_v5", sql("ev", _DECODED_SQL.format(ts="timestamp", cond=_V4)))
def _(c):
    return ntz(netflow.decode_netflow_v5(encode.v5_datagrams(raw_v4(c, True))).select(*_DECODED), "timestamp")


_SLOTS = f"SELECT DISTINCT router_ip, {tb(encode.V9_SLOT)} AS received_at FROM flows"


@query("SRC-04_extract_templates", sql("ev", f"SELECT router_ip, received_at, t AS template_id, CASE t WHEN 256 THEN 49 ELSE 74 END AS record_length FROM ({_SLOTS}), (VALUES (256), (257)) v(t)"))
def _(c):
    sets = netflow.export_sets(encode.templated_datagrams(c.raw_flows("ev")))
    return ntz(netflow.extract_templates(sets).select("router_ip", "received_at", "template_id", "record_length"), "received_at")


@query("SRC-05_decode_netflow_v9", sql("ev", _TEMPLATED_SQL))
def _(c):
    return ntz(netflow.decode_netflow_v9(encode.templated_datagrams(c.raw_flows("ev"))).select(*_TEMPLATED), "timestamp")


@query("SRC-06_decode_ipfix", sql("ev", _TEMPLATED_SQL))
def _(c):
    return ntz(netflow.decode_ipfix(encode.templated_datagrams(c.raw_flows("ev"), True)).select(*_TEMPLATED), "timestamp")


@query("SRC-07_decode_sflow_v5", sql("ev", """SELECT router_ip, timestamp, src_ip, dst_ip, protocol,
 CASE WHEN protocol IN (6, 17) THEN src_port ELSE 0 END AS src_port, CASE WHEN protocol IN (6, 17) THEN dst_port ELSE 0 END AS dst_port,
 CASE WHEN protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, bytes, 1 AS packets, sampling_rate, in_interface, out_interface, ip_version
 FROM flows"""))
def _(c):
    rows = sflow.decode_sflow_v5(encode.sflow_datagrams(c.raw_flows("ev")))
    return ntz(rows.select("router_ip", "timestamp", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "tcp_flags", "bytes",
                           F.col("packets").cast("int").alias("packets"), "sampling_rate", "in_interface", "out_interface", "ip_version"), "timestamp")


@query("SRC-08_route_datagrams", sql("ev", f"""SELECT 'netflow5' AS kind, count(DISTINCT (router_ip, timestamp, sampling_rate)) AS n FROM flows WHERE {_V4}
UNION ALL SELECT 'netflow9', (SELECT count(*) FROM {_DATA_SETS}) + (SELECT count(*) FROM ({_SLOTS}))
UNION ALL SELECT 'ipfix', (SELECT count(*) FROM {_DATA_SETS}) + (SELECT count(*) FROM ({_SLOTS}))
UNION ALL SELECT 'unknown', count(*) FROM flows"""))
def _(c):
    flows = c.raw_flows("ev")
    mixed = encode.v5_datagrams(raw_v4(c, True))
    for part in (encode.templated_datagrams(flows), encode.templated_datagrams(flows, True), encode.sflow_datagrams(flows)):
        mixed = mixed.unionByName(part)
    return mixed.groupBy(netflow.export_kind().alias("kind")).agg(F.count("*").alias("n"))


@query("SRC-09_load_as_names", sql("ev", "SELECT as_number, as_name, country FROM an"))
def _(c):
    path = scratch_dir(c.spark, "as-names")
    tables.load_as_names(c.as_versions.withColumn("as_org", F.lit("")), path)
    return dims.latest_versions(c.spark.read.parquet(path), "as_number").select("as_number", "as_name", "country")


_LOG_TUPLE = "link_tag, src_ip, dst_ip, src_as, dst_as, protocol, src_port, dst_port, ip_version"
_SEARCH = f"""SELECT min(ts) AS ts, {_LOG_TUPLE}, min(tcp_flags) AS tcp_flags, {TOTALS} FROM r_log WHERE {cut(EV)} GROUP BY {_LOG_TUPLE}"""


@query("SRC-10_export_flows_csv", sql("ev", f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, link_tag, src_ip, dst_ip, CAST(src_as AS VARCHAR) AS src_as,
 CAST(dst_as AS VARCHAR) AS dst_as, CAST(protocol AS VARCHAR) AS protocol, {proto('protocol')} AS protocol_name, CAST(src_port AS VARCHAR) AS src_port,
 CAST(dst_port AS VARCHAR) AS dst_port, coalesce(sname, '') AS service, CAST(tcp_flags AS VARCHAR) AS tcp_flags,
 CAST(ip_version AS VARCHAR) AS ip_version, CAST(total_bytes AS VARCHAR) AS bytes, CAST(total_packets AS VARCHAR) AS packets,
 CAST(total_flows AS VARCHAR) AS flow_count
 FROM ({_SEARCH} ) LEFT JOIN svc ON sp = protocol AND sport = dst_port""", "r_log", "svc"))
def _(c):
    path = scratch_dir(c.spark, "export")
    tables.export_flows_csv(search.search_flows(c.ev["flows_log"], FlowFilters(EV_START, EV_END, limit=None)), path)
    back = c.spark.read.option("header", True).csv(path)
    return back.select(*[F.coalesce(n, F.lit("")).alias(n) for n in search.EXPORT_COLUMNS])


_PROTO = f"SELECT protocol, direction, {TOTALS} FROM r_port WHERE {cut(EV)} GROUP BY 1, 2"


@query("SRC-11_export_table", sql("ev", f"SELECT protocol, direction, total_bytes FROM ({_PROTO})", "r_port"))
def _(c):
    path = scratch_dir(c.spark, "table")
    tables.export_table(top.top_protocol(c.ev["traffic_by_port"], EV), path, "json")
    return c.spark.read.schema("protocol int, direction string, total_bytes long").json(path)


_AUDIT = f"({fx.AUDIT})"


@query("SRC-13_append_audit", f"SELECT CAST(date_trunc('month', ts) AS DATE) AS month, action, count(*) AS n FROM {_AUDIT} GROUP BY 1, 2")
def _(c):
    path = scratch_dir(c.spark, "audit")
    blank = {n: F.lit("") for n in ("user_sub", "user_role", "params", "client_ip", "user_agent", "error_message")}
    tables.append_audit(c.audit.withColumns(blank), path)
    return c.spark.read.parquet(path).groupBy("month", "action").agg(F.count("*").alias("n"))


@query("SRC-14_list_audit", f"""SELECT ts, user_email, action, resource FROM {_AUDIT}
WHERE {cut(LI)} AND action = 'flow_search' ORDER BY ts DESC, resource LIMIT 500""")
def _(c):
    rows = tables.list_audit(c.audit, LI_START, LI_END, action="flow_search")
    return rows.select("ts", "user_email", "action", "resource")


def _policies(c) -> DataFrame:
    return catalogue(c.spark).select("table_name", F.col("default_days").alias("ttl_days"), F.lit(1).alias("enabled"))


@query("SRC-15_storage_stats", """SELECT 'flows_raw' AS table_name, 1 AS files, count(*) AS row_count, min(ts) AS oldest, max(ts) AS newest, 3 AS ttl_days FROM events
UNION ALL SELECT 'flows_log', 1, count(*), min(l_shipdate), max(l_shipdate), 180 FROM lineitem
UNION ALL SELECT 'audit_log', 1, count(*), min(o_orderdate), max(o_orderdate), 365 FROM orders""")
def _(c):
    scans = {"flows_raw": (c.table("events"), "ts"), "flows_log": (c.table("lineitem"), "l_shipdate"), "audit_log": (c.table("orders"), "o_orderdate")}
    return storage_stats(scans, _policies(c)).select("table_name", F.col("files").cast("int").alias("files"), "row_count", "oldest", "newest", "ttl_days")


@query("SRC-16_ingest_status", sql("ev", f"""SELECT router_ip, max(timestamp) AS last_seen, count(*) AS flow_count,
 (SELECT count(*) FROM f WHERE {cut(EV, 'timestamp')}) AS total_rows FROM f WHERE {cut(EV, 'timestamp')} GROUP BY 1"""))
def _(c):
    return tables.ingest_status(c.ev["flows"], EV_START, EV_END)


# ---- enrichment ------------------------------------------------------------------


@query("ENR-01_attribute_links", sql("ev", "SELECT flow_id, link_tag, direction FROM f"))
def _(c):
    return enrich.attribute_links(c.raw_flows("ev"), c.interfaces).select("flow_id", "link_tag", "direction")


_RECEIVED = """CASE flow_id % 4 WHEN 0 THEN timestamp + INTERVAL '10' SECOND WHEN 1 THEN timestamp - INTERVAL '30' MINUTE
 WHEN 2 THEN timestamp + INTERVAL '48' HOUR ELSE timestamp + INTERVAL '2' HOUR END"""


@query("ENR-02_clamp_timestamps", sql("ev", f"""SELECT flow_id, CASE WHEN bad THEN received_at ELSE timestamp END AS timestamp, bad AS clamped FROM (
 SELECT flow_id, received_at, timestamp, timestamp IS NULL OR timestamp > received_at + INTERVAL '5' MINUTE OR timestamp < received_at - INTERVAL '24' HOUR AS bad
 FROM (SELECT flow_id, {_RECEIVED} AS received_at, CASE WHEN flow_id % 11 = 0 THEN NULL ELSE timestamp END AS timestamp FROM flows))"""))
def _(c):
    return enrich.clamp_timestamps(_received(c)).select("flow_id", "timestamp", "clamped")


def _received(c) -> DataFrame:
    rows = c.raw_flows("ev").withColumn("received_at", F.expr(_RECEIVED))
    return rows.withColumn("timestamp", F.expr("CASE WHEN flow_id % 11 = 0 THEN NULL ELSE timestamp END"))


@query("ENR-03_override_local_as", sql("ev", "SELECT flow_id, src_as, dst_as FROM f"))
def _(c):
    rows = enrich.normalize_addresses(c.raw_flows("ev"))
    return enrich.override_local_as(rows, fx.LOCAL_AS, fx.LOCAL_PREFIXES).select("flow_id", "src_as", "dst_as")


_IPS = "SELECT src_ip AS ip FROM f UNION SELECT dst_ip FROM f"


def _ips(c) -> DataFrame:
    rows = c.ev["flows"]
    return rows.select(F.col("src_ip").alias("ip")).union(rows.select("dst_ip")).distinct()


@query("ENR-04_to_ip16", sql("ev", f"SELECT ip, {ip16('ip')} AS ip16, ip AS text FROM ({_IPS})"))
def _(c):
    packed = _ips(c).withColumn("b", addr.to_ip16("ip"))
    return packed.select("ip", F.lower(F.hex("b")).alias("ip16"), addr.ip_text("b").alias("text"))


@query("ENR-05_direction_text", """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'in' WHEN 2 THEN 'out' ELSE '' END AS stored,
 CASE event_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'out' ELSE '' END AS exported FROM events""")
def _(c):
    code = F.col("event_id") % 4
    return c.table("events").select("event_id", enrich.direction_text(code).alias("stored"), enrich.exported_direction(code).alias("exported"))


@query("ENR-06_with_as_info", sql("li", """SELECT src_as AS as_number, coalesce(as_name, '') AS as_name, coalesce(country, '') AS country, n FROM (
 SELECT src_as, count(*) AS n FROM f GROUP BY 1) LEFT JOIN an ON src_as = as_number"""))
def _(c):
    return dims.with_as_info(c.li["flows"].groupBy(F.col("src_as").alias("as_number")).agg(F.count("*").alias("n")), c.as_dim)


@query("ENR-07_protocol_name", f"""SELECT number, {proto('number')} AS name, n FROM (SELECT l_partkey % 256 AS number, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(c):
    counts = c.table("lineitem").groupBy((F.col("l_partkey") % 256).alias("number")).agg(F.count("*").alias("n"))
    return counts.select("number", names.protocol_name("number").alias("name"), "n")


_PORTS = "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 6 ELSE 17 END AS protocol, CAST(l_partkey * 7 % 12000 AS INT) AS port, count(*) AS n FROM lineitem GROUP BY 1, 2"


@query("ENR-08_service_name", plain("SELECT protocol, port, coalesce(sname, '') AS service, n FROM p LEFT JOIN svc ON sp = protocol AND sport = port",
                                    p=_PORTS, svc=SERVICES))
def _(c):
    counts = c.sql(_PORTS, "lineitem")
    return counts.select("protocol", "port", names.service_name("protocol", "port").alias("service"), "n")


@query("ENR-09_prefix_of", sql("ev", f"""SELECT ip, CASE WHEN ip LIKE '2001:db8:ff::%' THEN '2001:db8:ff::/48' WHEN ip LIKE '2001:db8:1::%' THEN '2001:db8:1::/48'
 ELSE {net24('ip')} || '/24' END AS prefix FROM ({_IPS})"""))
def _(c):
    length = F.when(F.col("ip").contains(":"), 48).otherwise(24)
    return _ips(c).select("ip", addr.prefix_of(addr.to_ip16("ip"), length).alias("prefix"))


@query("ENR-10_refreshing_dimension", sql("ev", "SELECT link_tag, direction, count(*) AS n FROM f GROUP BY 1, 2"))
def _(c):
    path, ckpt = scratch_dir(c.spark, "dim"), scratch_dir(c.spark, "dim-ckpt")
    sink = lambda df, i: df.withColumn("batch_id", F.lit(i)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    jobs.enrich_batches(c.raw_flows("ev", stream_of(c)), lambda: c.spark.sql(fx.LINKS), sink, ckpt).awaitTermination()
    return c.spark.read.parquet(path).groupBy("link_tag", "direction").agg(F.count("*").alias("n"))


# ---- rollups ---------------------------------------------------------------------

_ROLLS = {
    "ROL-01_traffic_by_as": ("li", "traffic_by_as", "r_as", "ts, link_tag, direction, as_number, ip_version"),
    "ROL-02_traffic_by_as_hourly": ("ev", "traffic_by_as_hourly", "r_ash", "ts, link_tag, direction, as_number, ip_version"),
    "ROL-03_traffic_by_as_daily": ("li", "traffic_by_as_daily", "r_asd", "ts, link_tag, direction, as_number, ip_version"),
    "ROL-04_traffic_by_ip": ("ev", "traffic_by_ip", "r_ip", "ts, link_tag, direction, ip, as_number"),
    "ROL-05_traffic_by_prefix": ("ev", "traffic_by_prefix", "r_px", "ts, link_tag, direction, prefix, as_number"),
    "ROL-06_traffic_by_link": ("ev", "traffic_by_link", "r_link", "ts, link_tag, ip_version"),
    "ROL-07_traffic_by_link_hourly": ("ev", "traffic_by_link_hourly", "r_linkh", "ts, link_tag, ip_version"),
    "ROL-08_traffic_by_link_daily": ("li", "traffic_by_link_daily", "r_linkd", "ts, link_tag, ip_version"),
    "ROL-09_traffic_by_ip_as": ("ev", "traffic_by_ip_as", "r_ipas", "ts, link_tag, direction, ip, as_number"),
    "ROL-10_flows_log": ("ev", "flows_log", "r_log", "ts, router_ip, " + _LOG_TUPLE + ", tcp_flags"),
    "ROL-11_traffic_by_port": ("li", "traffic_by_port", "r_port", "ts, link_tag, direction, protocol, port, ip_version"),
}


def _rollup_query(name: str, kind: str, table: str, cte: str, keys: str) -> None:
    sums = f"{LINK_SUMS}, CAST(sum(flow_count) AS BIGINT) AS flow_count" if "link" in table else SUMS
    body = f"SELECT {keys}, {sums} FROM {cte} GROUP BY {keys}"

    @query(name, sql(kind, body, cte))
    def _(c):
        return ro.build(getattr(c, kind)["flows"], ro.ROLLUPS[table]).drop("ip16", "src_ip16", "dst_ip16")


for _name, _args in _ROLLS.items():
    _rollup_query(_name, *_args)


@query("ROL-12_traffic_by_dst_1min", sql("ev", f"""SELECT ts, dst_ip, protocol, {SUMS}, CAST(sum(syn_count) AS BIGINT) AS syn_count,
 count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT src_port) AS unique_src_ports FROM r_dst GROUP BY 1, 2, 3""", "r_dst"))
def _(c):
    return ro.build(c.ev["flows"], ro.ROLLUPS["traffic_by_dst_1min"], exact=True).drop("dst_ip16")


@query("ROL-13_traffic_by_src_1min", sql("ev", f"""SELECT ts, src_ip, protocol, {SUMS}, count(DISTINCT dst_ip) AS unique_dst_ips,
 count(DISTINCT dst_port) AS unique_dst_ports FROM r_src GROUP BY 1, 2, 3""", "r_src"))
def _(c):
    return ro.build(c.ev["flows"], ro.ROLLUPS["traffic_by_src_1min"], exact=True).drop("src_ip16")


_AS_KEYS = "ts, link_tag, direction, as_number, ip_version"


@query("ROL-14_merge_partials", sql("ev", f"SELECT {_AS_KEYS}, {SUMS} FROM r_asd GROUP BY {_AS_KEYS}", "r_asd"))
def _(c):
    spec, daily = ro.ROLLUPS["traffic_by_as_hourly"], ro.ROLLUPS["traffic_by_as_daily"]
    flows = c.ev["flows"]
    # Two batches (by exporter) appended apart, compacted by day, read back and coarsened from hours to days.
    path, merged = scratch_dir(c.spark, "partials"), scratch_dir(c.spark, "compacted")
    for batch, router in enumerate(("10.255.0.1", "10.255.0.2")):
        ro.write_partials(ro.build(flows.filter(F.col("router_ip") == router), spec), spec, path, batch)
    ro.compact(c.spark, spec, path, merged)
    return ro.coarsen(c.spark.read.parquet(merged).drop("dt"), daily)


@query("ROL-14_merge_sketches", sql("ev", "SELECT dst_ip, protocol, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT src_port) < 40 AS small FROM r_dst GROUP BY 1, 2", "r_dst"))
def _(c):
    # Small distinct counts are exact in an HLL sketch's coupon list, so only size classes are compared.
    spec = ro.ROLLUPS["traffic_by_dst_1min"]
    merged = ro.merge(ro.build(c.ev["flows"], spec), spec)
    by_host = merged.groupBy("dst_ip", "protocol").agg(F.sum("bytes").alias("bytes"), F.hll_union_agg("unique_src_ports").alias("s"))
    return by_host.select("dst_ip", "protocol", "bytes", (F.hll_sketch_estimate("s") < 40).alias("small"))


@query("ROL-15_legacy_backfill", sql("li", f"""SELECT {_AS_KEYS}, {SUMS} FROM (SELECT ts, link_tag, direction, as_number,
 CASE WHEN ts < TIMESTAMP '1998-01-01 00:00:00' THEN 0 ELSE ip_version END AS ip_version, {'bytes, packets, flow_count'} FROM r_asd) GROUP BY {_AS_KEYS}""", "r_asd"))
def _(c):
    spec = ro.ROLLUPS["traffic_by_as_daily"]
    built, split = ro.build(c.li["flows"], spec), instant(datetime(1998, 1, 1))
    old = ro.drop_dimension(built.filter(F.col("ts") < split), spec, "ip_version")
    return ro.legacy_backfill(old, {"ip_version": F.lit(0)}, built.filter(F.col("ts") >= split))


@query("ROL-16_drop_dimension", sql("ev", f"SELECT ts, link_tag, {LINK_SUMS}, CAST(sum(flow_count) AS BIGINT) AS flow_count FROM r_link GROUP BY 1, 2", "r_link"))
def _(c):
    spec = ro.ROLLUPS["traffic_by_link"]
    return ro.drop_dimension(c.ev["traffic_by_link"], spec, "ip_version")


# ---- filters ---------------------------------------------------------------------


@query("FLT-01_time_range", sql("ev", f"SELECT flow_id, timestamp FROM f WHERE {cut(_TEN, 'timestamp')}"))
def _(c):
    return filters.in_range(c.ev["flows"], _TEN.start, _TEN.end, "timestamp").select("flow_id", "timestamp")


def _as_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("direction", "as_number").agg(*top.totals())


_AS_TOTALS = f"SELECT direction, as_number, {TOTALS} FROM r_as WHERE {{}} GROUP BY 1, 2"


@query("FLT-02_direction", sql("ev", _AS_TOTALS.format("direction = 'in'"), "r_as"))
def _(c):
    return _as_totals(filters.by_direction(c.ev["traffic_by_as"], "in"))


@query("FLT-03_links", sql("ev", _AS_TOTALS.format("link_tag IN ('transit-1', 'core-1')"), "r_as"))
def _(c):
    return _as_totals(filters.by_links(c.ev["traffic_by_as"], ["transit-1", "core-1"]))


@query("FLT-04_ip_version", sql("ev", _AS_TOTALS.format("ip_version = 6"), "r_as"))
def _(c):
    return _as_totals(filters.by_ip_version(c.ev["traffic_by_as"], 6))


@query("FLT-05_exclude_as", sql("ev", _AS_TOTALS.format("as_number != 64500"), "r_as"))
def _(c):
    return _as_totals(filters.without_as(c.ev["traffic_by_as"], 64500))


@query("FLT-06_ip_equality", sql("ev", "SELECT flow_id, src_ip FROM f WHERE src_ip = '192.0.2.7' OR src_ip = '2001:db8:1::4'"))
def _(c):
    hit = addr.same_address("src_ip16", "::ffff:192.0.2.7") | addr.same_address("src_ip16", "2001:DB8:1:0::4")
    return c.ev["flows"].filter(hit).select("flow_id", "src_ip")


_LIST = ["192.0.2.0/24", "not-a-network", "203.0.3.7", "2001:db8:1::/48"]


@query("FLT-07_cidr_list", sql("ev", """SELECT flow_id, dst_ip FROM f WHERE dst_ip LIKE '192.0.2.%' OR dst_ip = '203.0.3.7' OR dst_ip LIKE '2001:db8:1::%'"""))
def _(c):
    return c.ev["flows"].filter(addr.in_cidrs("dst_ip16", _LIST)).select("flow_id", "dst_ip")


# Every order names an address or a /24 of the flows' outer range and a /24 that no flow has: a list that grows with the table.
_CIDR_ROWS = """SELECT concat('203.0.', CAST(o_custkey % 16 AS VARCHAR(20)), '.', CAST(o_orderkey % 24 AS VARCHAR(20))) AS cidr FROM orders
 UNION ALL SELECT concat('10.', CAST(o_orderkey % 251 AS VARCHAR(20)), '.', CAST(o_custkey % 256 AS VARCHAR(20)), '.9/24') FROM orders
 UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN '198.51.100.77/25' ELSE '198.51.100.8' END FROM orders
 UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN '2001:db8:1::/48' ELSE concat('bad/', CAST(o_orderkey AS VARCHAR(20))) END FROM orders"""
_CIDR_HIT = """(dst_ip IN (SELECT cidr FROM cidrs) OR (dst_ip LIKE '198.51.100.%' AND TRY_CAST(split_part(dst_ip, '.', 4) AS INT) < 128) OR dst_ip LIKE '2001:db8:1::%')"""


@query("FLT-07_cidr_table", sql("ev", f", cidrs AS ({_CIDR_ROWS}) SELECT flow_id, dst_ip FROM f WHERE {_CIDR_HIT}"))
def _(c):
    cidrs = c.sql(_CIDR_ROWS, "orders")
    return within(c.ev["flows"], "dst_ip16", cidrs).select("flow_id", "dst_ip")


@query("FLT-08_scope", sql("ev", f"""SELECT ip, CASE WHEN {local('ip')} THEN 'internal' ELSE 'external' END AS scope, CAST(sum(bytes) AS BIGINT) AS total_bytes
 FROM r_ip GROUP BY 1, 2""", "r_ip"))
def _(c):
    rows = c.ev["traffic_by_ip"]
    side = lambda s: rows.filter(addr.in_scope("ip16", s, fx.LOCAL_PREFIXES)).groupBy("ip").agg(
        F.lit(s).alias("scope"), F.sum("bytes").alias("total_bytes"))
    return side("internal").unionByName(side("external"))


_FOLD = "CASE WHEN prefix LIKE '192.0.2.%' THEN '192.0.2.0/24' WHEN prefix LIKE '198.51.100.%' THEN '198.51.100.0/24' ELSE '2001:db8:1::/48' END"


@query("FLT-09_prefix_scope", sql("ev", f"""SELECT {_FOLD} AS grouped_prefix, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM r_px WHERE {local('prefix')} GROUP BY 1""", "r_px"))
def _(c):
    key, keep = top.prefix_group("prefix", EV.with_(scope="internal", local_prefixes=fx.LOCAL_PREFIXES))
    return c.ev["traffic_by_prefix"].filter(keep).groupBy(key.alias("grouped_prefix")).agg(F.sum("bytes").alias("total_bytes"))


@query("FLT-10_syn_only", sql("ev", "SELECT flow_id, tcp_flags FROM f WHERE (tcp_flags & 2) != 0 AND (tcp_flags & 16) = 0"))
def _(c):
    return c.ev["flows"].filter(filters.syn_only()).select("flow_id", "tcp_flags")


@query("FLT-11_forensic_filters", sql("ev", f"""SELECT link_tag, src_ip, dst_ip, dst_port, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM r_log
 WHERE {cut(EV)} AND dst_ip LIKE '198.51.100.%' AND protocol = 6 AND dst_port = 443 AND ip_version = 4
 GROUP BY 1, 2, 3, 4""", "r_log"))
def _(c):
    f = FlowFilters(EV_START, EV_END, dst_ip="198.51.100.0/24", protocol=6, dst_port=443, ip_version=4)
    return filters.forensic(c.ev["flows_log"], f).groupBy("link_tag", "src_ip", "dst_ip", "dst_port").agg(F.sum("bytes").alias("total_bytes"))


_PERIODS = ("15m", "1h", "3h", "4h", "6h", "12h", "24h", "7d", "30d", "90m", "48h", "yesterday", "week", "nonsense")


@query("FLT-12_window_presets", sql("ev", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS period, count(*) AS n FROM f WHERE {cut(QueryParams(*resolve_window(n, datetime(2024, 1, 24, 15, 30))), 'timestamp')}" for n in _PERIODS) + ") WHERE n > 0"))
def _(c):
    inside = [
        F.when(filters.between("timestamp", *resolve_window(n, datetime(2024, 1, 24, 15, 30))), F.lit(n)) for n in _PERIODS
    ]
    hits = c.ev["flows"].select(F.explode(F.array(*inside)).alias("period"))
    return hits.filter("period IS NOT NULL").groupBy("period").agg(F.count("*").alias("n"))


@query("FLT-13_search_as", sql("ev", "SELECT as_number, as_name, country FROM an WHERE CAST(as_number AS VARCHAR) LIKE '%00%' OR lower(as_name) LIKE '%00%' ORDER BY as_number LIMIT 50"))
def _(c):
    return dims.search_as(c.as_dim, "00", 50)


_STRINGS = """SELECT concat('AS', CAST(s_suppkey AS VARCHAR(20))) AS q FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR(20)) FROM supplier
 UNION ALL SELECT s_name FROM supplier UNION ALL SELECT concat('10.1.', CAST(s_suppkey % 200 AS VARCHAR(20)), '.0/24') FROM supplier
 UNION ALL SELECT concat(' 2001:db8::', CAST(s_suppkey AS VARCHAR(20)), ' ') FROM supplier UNION ALL SELECT concat('a b:', s_name) FROM supplier"""


@query("FLT-14_classify_query", f"""SELECT q, kind, CASE kind WHEN 'as' THEN regexp_replace(trim(q), '^[A-Za-z]+', '') WHEN 'ip' THEN split_part(trim(q), '/', 1) ELSE trim(q) END AS key FROM (
 SELECT q, CASE WHEN regexp_matches(trim(q), '^[Aa][Ss]?[0-9]+$') OR regexp_matches(trim(q), '^[0-9]+$') THEN 'as'
 WHEN regexp_matches(trim(q), '^[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') OR (contains(trim(q), ':') AND NOT contains(trim(q), ' ')) THEN 'ip'
 ELSE 'text' END AS kind FROM ({_STRINGS}))""")
def _(c):
    strings = c.sql(_STRINGS, "supplier")
    return strings.withColumn("c", enrich.classify_query("q")).select("q", "c.kind", "c.key")


def _top_ports(metric: str, offset: int = 0) -> str:
    return f"""SELECT protocol, port, {TOTALS} FROM r_port GROUP BY 1, 2 ORDER BY {order_column(metric)} DESC, protocol, port LIMIT 15 OFFSET {offset}"""


@query("FLT-15_order_metric", sql("li", _top_ports("packets"), "r_port"))
def _(c):
    sums = c.li["traffic_by_port"].groupBy("protocol", "port").agg(*top.totals())
    return filters.top_k(sums, order_column("packets"), ["protocol", "port"], 15)


@query("FLT-16_top_k_offset", sql("li", _top_ports("no such metric", 30), "r_port"))
def _(c):
    sums = c.li["traffic_by_port"].groupBy("protocol", "port").agg(*top.totals())
    return filters.top_k(sums, order_column("no such metric"), ["protocol", "port"], 15, 30)


# ---- joins and set operations ----------------------------------------------------


@query("JON-01_join_as_dimension", sql("li", f"SELECT r.as_number, coalesce(as_name, '') AS as_name, {TOTALS} FROM r_as r LEFT JOIN an ON r.as_number = an.as_number GROUP BY 1, 2", "r_as"))
def _(c):
    sums = c.li["traffic_by_as"].groupBy("as_number").agg(*top.totals())
    return dims.with_as_info(sums, c.as_dim).drop("country")


@query("JON-02_join_links", sql("ev", f"""SELECT link_tag, coalesce(description, '') AS description, coalesce(capacity_mbps, 0) AS capacity_mbps, n FROM (
 SELECT link_tag, count(*) AS n FROM f GROUP BY 1) LEFT JOIN lk ON link_tag = tag"""))
def _(c):
    return dims.with_link_info(c.ev["flows"].groupBy("link_tag").agg(F.count("*").alias("n")), c.links)


@query("JON-03_longest_prefix", sql("ev", f"""SELECT dst_ip, CASE WHEN dst_ip LIKE '198.51.100.%' THEN CASE WHEN CAST(split_part(dst_ip, '.', 4) AS INT) < 128
 THEN '198.51.100.0/25' ELSE '198.51.100.0/24' END WHEN dst_ip LIKE '%:%' THEN CASE WHEN dst_ip LIKE '2001:db8:1::%' THEN '2001:db8:1::/48' ELSE '2001:db8:ff::/48' END
 ELSE {net24('dst_ip')} || '/24' END AS matched_prefix, count(*) AS n FROM f GROUP BY 1, 2"""))
def _(c):
    flows = c.ev["flows"]
    table = enrich.prefix_table(flows.select(F.explode(F.array("src_prefix", "dst_prefix")).alias("px")).distinct(), "px")
    matched = enrich.match_prefixes(flows.select("dst_ip", "dst_ip16"), "dst_ip16", table)
    return matched.groupBy("dst_ip", "matched_prefix").agg(F.count("*").alias("n"))


@query("JON-04_as_of_template", sql("ev", f"SELECT router_ip, count(*) AS data_sets, CAST(sum(secs) AS BIGINT) AS age_seconds FROM (SELECT router_ip, date_diff('second', {tb(encode.V9_SLOT)}, date_trunc('second', timestamp)) AS secs FROM flows) GROUP BY 1"))
def _(c):
    # a data set for every flow, each matched on its own
    sets = netflow.export_sets(encode.templated_datagrams(c.raw_flows("ev"), records=1))
    matched = netflow.match_templates(sets)
    age = F.unix_timestamp("received_at") - F.unix_timestamp("t_at")
    return matched.groupBy("router_ip").agg(F.count("*").alias("data_sets"), F.sum(age).alias("age_seconds"))


_ALERTS, _BLOCKS = f"({fx.ALERTS})", f"({fx.BLOCKS})"


@query("JON-05_anti_active_blocks", f"""SELECT id, target FROM {_ALERTS} a WHERE status = 'active' AND target NOT IN (SELECT ip FROM {_BLOCKS} WHERE status = 'active')""")
def _(c):
    blocked = al.active_blocks(c.blocks).select(F.col("ip").alias("target"))
    return c.alerts.filter("status = 'active'").join(blocked, "target", "left_anti").select("id", "target")


@query("JON-06_semi_top_keys", sql("ev", f"""SELECT {tb(3600, 'ts')} AS period, as_number, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM r_as WHERE as_number IN (
 SELECT as_number FROM r_as GROUP BY 1 ORDER BY sum(bytes) DESC, as_number LIMIT 5) GROUP BY 1, 2""", "r_as"))
def _(c):
    rows = c.ev["traffic_by_as"]
    best = filters.top_k(rows.groupBy("as_number").agg(F.sum("bytes").alias("b")), "b", ["as_number"], 5).select("as_number")
    listed = rows.join(F.broadcast(best), "as_number", "left_semi")  # five rows
    return series._points(listed, 3600, ["as_number"], [F.sum("bytes").alias("total_bytes")])


_HG = f"""SELECT id, name, cidr, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM ({fx.HOSTGROUPS})) WHERE rn = 1 AND deleted = 0"""
_RULE_ROWS = """SELECT concat('r-', CAST(c_custkey AS VARCHAR(20))) AS rule_id, CASE WHEN c_custkey % 3 = 0 THEN concat('hg-', CAST(c_custkey AS VARCHAR(20))) ELSE '' END AS hostgroup_id,
 CASE WHEN c_custkey % 3 = 1 THEN '203.0.113.0/24' ELSE '' END AS target_filter FROM customer"""


@query("JON-07_resolve_scopes", f"""SELECT rule_id, CASE WHEN g.id IS NOT NULL THEN g.cidr WHEN hostgroup_id = '' AND target_filter != '' THEN target_filter ELSE x.cidr END AS cidr
 FROM ({_RULE_ROWS}) r LEFT JOIN ({_HG}) g ON g.id = r.hostgroup_id
 LEFT JOIN (VALUES ('192.0.2.0/24'), ('198.51.100.0/24')) AS x(cidr) ON g.id IS NULL AND NOT (hostgroup_id = '' AND target_filter != '')""")
def _(c):
    groups = dims.latest_versions(c.hostgroups, "id").select("id", F.array("cidr").alias("cidrs"))
    return resolve_scopes(c.sql(_RULE_ROWS, "customer"), groups, ["192.0.2.0/24", "198.51.100.0/24"])


@query("JON-10_policy_join", """SELECT 'flows_raw' AS table_name, count(*) AS row_count, 3 AS ttl_days FROM events
UNION ALL SELECT 'alerts', count(*), 365 FROM events UNION ALL SELECT 'unmanaged', count(*), NULL FROM orders""")
def _(c):
    scans = {"flows_raw": (c.table("events"), "ts"), "alerts": (c.table("events"), "ts"), "unmanaged": (c.table("orders"), "o_orderdate")}
    return storage_stats(scans, _policies(c)).select("table_name", "row_count", "ttl_days")


_BOTH = f"SELECT ip, {TOTALS} FROM (SELECT dst_ip AS ip, bytes, packets, flow_count FROM f WHERE src_ip = '{{0}}' UNION ALL SELECT src_ip, bytes, packets, flow_count FROM f WHERE dst_ip = '{{0}}') GROUP BY 1 ORDER BY total_bytes DESC, ip LIMIT 20"


@query("SET-01_both_roles", sql("ev", """SELECT ip, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS n FROM (SELECT dst_ip AS ip, bytes FROM f UNION ALL SELECT src_ip, bytes FROM f) GROUP BY 1"""))
def _(c):
    rows = top.volumes(c.ev["flows"])
    both = rows.select(F.col("dst_ip").alias("ip"), "bytes").unionByName(rows.select(F.col("src_ip").alias("ip"), "bytes"))
    return both.groupBy("ip").agg(F.sum("bytes").alias("total_bytes"), F.count("*").alias("n"))


@query("SET-02_union_of_partial_tops", sql("li", f"""SELECT as_num, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM (SELECT {grouped('src_as')} AS as_num, bytes FROM f WHERE src_as > 0
 UNION ALL SELECT {grouped('dst_as')}, bytes FROM f WHERE dst_as > 0) GROUP BY 1 ORDER BY total_bytes DESC, as_num LIMIT 10"""))
def _(c):
    rows = top.volumes(c.li["flows"])
    side = lambda col: rows.filter(F.col(col) > 0).groupBy(asn.grouped_as(col).alias("as_num")).agg(F.sum("bytes").alias("bytes"))
    sums = side("src_as").unionByName(side("dst_as")).groupBy("as_num").agg(F.sum("bytes").alias("total_bytes"))
    return filters.top_k(sums, "total_bytes", ["as_num"], 10)
