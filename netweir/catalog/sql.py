"""Reference SQL pieces: the same flows, enrichment and rollups in plain SQL."""

from __future__ import annotations

from ..functions.asn import PRIVATE_GROUP, PRIVATE_NAME
from ..functions.names import PROTOCOLS, TCP_SERVICES, UDP_SERVICES
from . import fixtures as fx


def private(col: str) -> str:
    return f"({col} BETWEEN 64512 AND 65534 OR {col} BETWEEN 4200000000 AND 4294967294)"


def local(col: str) -> str:
    return f"({col} LIKE '192.0.2.%' OR {col} LIKE '198.51.100.%' OR {col} LIKE '2001:db8:1::%')"


def grouped(col: str) -> str:
    return f"CASE WHEN {private(col)} THEN {PRIVATE_GROUP} ELSE {col} END"


def gname(group: str, name: str) -> str:
    return f"CASE WHEN {group} = {PRIVATE_GROUP} THEN '{PRIVATE_NAME}' ELSE coalesce({name}, '') END"


def ip16(col: str) -> str:
    """Hex of the 16-byte form for the addresses that occur in the derived flows."""
    return (
        f"CASE WHEN {col} LIKE '2001:db8:ff::%' THEN '20010db800ff0000000000000000000' || split_part({col}, '::', 2) "
        f"WHEN {col} LIKE '2001:db8:1::%' THEN '20010db800010000000000000000000' || split_part({col}, '::', 2) "
        f"ELSE '00000000000000000000ffff' || printf('%02x%02x%02x%02x', CAST(split_part({col}, '.', 1) AS INT), "
        f"CAST(split_part({col}, '.', 2) AS INT), CAST(split_part({col}, '.', 3) AS INT), CAST(split_part({col}, '.', 4) AS INT)) END"
    )


def net24(col: str) -> str:
    return f"split_part({col}, '.', 1) || '.' || split_part({col}, '.', 2) || '.' || split_part({col}, '.', 3) || '.0'"


def proto(col: str) -> str:
    whens = " ".join(f"WHEN {n} THEN '{name}'" for n, name in PROTOCOLS.items())
    return f"CASE {col} {whens} ELSE concat('proto:', CAST({col} AS VARCHAR)) END"


SERVICES = "SELECT * FROM (VALUES " + ", ".join(
    f"({p}, {port}, '{name}')" for p, names in ((6, TCP_SERVICES), (17, UDP_SERVICES)) for port, name in names.items()
) + ") AS t(sp, sport, sname)"


def service(p: str, port: str) -> str:
    return f"coalesce((SELECT max(sname) FROM svc WHERE sp = {p} AND sport = {port}), '')"


def tb(seconds: int, col: str = "timestamp") -> str:
    return f"time_bucket(INTERVAL '{seconds} seconds', {col})"


SUMS = "CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(flow_count) AS BIGINT) AS flow_count"
TOTALS = (
    "CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(packets) AS BIGINT) AS total_packets, "
    "CAST(sum(flow_count) AS BIGINT) AS total_flows"
)
AVG = "CAST(sum(bytes) AS BIGINT) / greatest(CAST(sum(packets) AS BIGINT), 1) AS avg_pkt_size"
LINK_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("bytes_in", "bytes_out", "packets_in", "packets_out"))

LK = f"""lk AS (SELECT tag, router_ip, snmp_index, description, capacity_mbps, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY updated_at DESC) AS rn FROM ({fx.LINKS})) WHERE rn = 1)"""

AN = f"""an AS (SELECT as_number, as_name, country FROM (
  SELECT *, row_number() OVER (PARTITION BY as_number ORDER BY updated_at DESC) AS rn FROM ({fx.AS_NAMES})) WHERE rn = 1)"""

F_CTE = f"""f AS (SELECT flow_id, timestamp, w.router_ip, src_ip, dst_ip, ip_version,
  CASE WHEN {local('src_ip')} AND (src_as = 0 OR {private('src_as')}) THEN 64500 ELSE src_as END AS src_as,
  CASE WHEN {local('dst_ip')} AND (dst_as = 0 OR {private('dst_as')}) THEN 64500 ELSE dst_as END AS dst_as,
  src_prefix, dst_prefix, protocol, src_port, dst_port, tcp_flags, sampling_rate, in_interface, out_interface, flow_type,
  bytes * sampling_rate AS bytes, packets * sampling_rate AS packets, 1 AS flow_count,
  coalesce(li.tag, lo.tag, '') AS link_tag,
  CASE WHEN li.tag IS NOT NULL THEN 'in' WHEN lo.tag IS NOT NULL THEN 'out' ELSE '' END AS direction
  FROM flows w LEFT JOIN lk li ON w.router_ip = li.router_ip AND w.in_interface = li.snmp_index
  LEFT JOIN lk lo ON w.router_ip = lo.router_ip AND w.out_interface = lo.snmp_index)"""

_VOL = "bytes, packets, flow_count"


def _as_rows(seconds: int) -> str:
    ts = f"{tb(seconds)} AS ts"
    return (
        f"SELECT {ts}, link_tag, 'out' AS direction, src_as AS as_number, ip_version, {_VOL} FROM f WHERE src_as > 0 "
        f"UNION ALL SELECT {ts}, link_tag, 'in', dst_as, ip_version, {_VOL} FROM f WHERE dst_as > 0"
    )


def _link_rows(seconds: int) -> str:
    return (
        f"SELECT {tb(seconds)} AS ts, link_tag, ip_version, CASE WHEN direction = 'in' THEN bytes ELSE 0 END AS bytes_in, "
        f"CASE WHEN direction = 'out' THEN bytes ELSE 0 END AS bytes_out, CASE WHEN direction = 'in' THEN packets ELSE 0 END AS packets_in, "
        f"CASE WHEN direction = 'out' THEN packets ELSE 0 END AS packets_out, flow_count FROM f WHERE link_tag != ''"
    )


def _two(cols_in: str, cols_out: str, if_in: str = "", if_out: str = "") -> str:
    ts = f"{tb(300)} AS ts"
    return (
        f"SELECT {ts}, link_tag, 'in' AS direction, {cols_in}, {_VOL} FROM f {if_in} "
        f"UNION ALL SELECT {ts}, link_tag, 'out', {cols_out}, {_VOL} FROM f {if_out}"
    )


CTES = {
    "lk": LK,
    "an": AN,
    "f": F_CTE,
    "svc": f"svc AS ({SERVICES})",
    "r_as": f"r_as AS ({_as_rows(300)})",
    "r_ash": f"r_ash AS ({_as_rows(3600)})",
    "r_asd": f"r_asd AS ({_as_rows(86400)})",
    "r_link": f"r_link AS ({_link_rows(300)})",
    "r_linkh": f"r_linkh AS ({_link_rows(3600)})",
    "r_linkd": f"r_linkd AS ({_link_rows(86400)})",
    "r_ip": "r_ip AS (" + _two("dst_ip AS ip, dst_as AS as_number", "src_ip, src_as") + ")",
    "r_px": "r_px AS (" + _two("dst_prefix AS prefix, dst_as AS as_number", "src_prefix, src_as", "WHERE dst_prefix != ''", "WHERE src_prefix != ''") + ")",
    "r_ipas": "r_ipas AS (" + _two("dst_ip AS ip, src_as AS as_number", "src_ip, dst_as", "WHERE src_as > 0", "WHERE dst_as > 0") + ")",
    "r_port": "r_port AS (" + _two("protocol, dst_port AS port, ip_version", "protocol, src_port, ip_version", "WHERE dst_port > 0 OR protocol = 1", "WHERE src_port > 0 OR protocol = 1") + ")",
    "r_log": f"r_log AS (SELECT {tb(60)} AS ts, router_ip, link_tag, src_ip, dst_ip, src_as, dst_as, protocol, src_port, dst_port, tcp_flags, ip_version, {_VOL} FROM f)",
    "r_dst": f"r_dst AS (SELECT {tb(60)} AS ts, dst_ip, protocol, src_ip, src_port, {_VOL}, CASE WHEN (tcp_flags & 2) != 0 AND (tcp_flags & 16) = 0 THEN packets ELSE 0 END AS syn_count FROM f)",
    "r_src": f"r_src AS (SELECT {tb(60)} AS ts, src_ip, protocol, dst_ip, dst_port, {_VOL} FROM f)",
}


def sql(kind: str, body: str, *ctes: str) -> str:
    """Full statement: derived flows of a kind, enrichment and the named pieces, then the body."""
    parts = [fx.FLOW_CTES[kind]] + [CTES[n] for n in ("lk", "an", "f")] + [CTES[n] for n in ctes if n != "an"]
    return "WITH " + "\n, ".join(parts) + "\n" + body


def plain(body: str, **ctes: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in ctes.items()) + "\n" + body
