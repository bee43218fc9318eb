"""Table schemas (fixed; nothing is inferred at read time)."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType(
        [T.StructField(n, t) for n, t in ((p.split(" ")[0], _TYPES[p.split(" ")[1]]) for p in text.split(", "))]
    )


_TYPES = {
    "ts": T.TimestampType(),
    "str": T.StringType(),
    "bin": T.BinaryType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "strs": T.ArrayType(T.StringType()),
}

# Flow fact table.  Addresses are kept twice: canonical text for output and the
# 16-byte form (IPv4 as ::ffff:a.b.c.d) whose unsigned byte order is numeric order.
FLOW = _struct(
    "timestamp ts, router_ip str, link_tag str, direction str, src_ip str, dst_ip str, "
    "src_ip16 bin, dst_ip16 bin, ip_version int, src_as long, dst_as long, src_prefix str, dst_prefix str, "
    "protocol int, src_port int, dst_port int, tcp_flags int, bytes long, packets long, sampling_rate int, "
    "in_interface long, out_interface long, flow_type str"
)

DATAGRAM = _struct("router_ip str, received_at ts, payload bin")
LINK = _struct(
    "tag str, router_ip str, snmp_index long, description str, capacity_mbps long, color str, updated_at ts"
)
AS_NAME = _struct("as_number long, as_name str, as_org str, country str, updated_at ts")
ALERT_RULE = _struct(
    "id str, name str, rule_type str, enabled int, threshold_bps long, threshold_pps long, threshold_count long, "
    "window_seconds int, cooldown_seconds int, severity str, target_filter str, hostgroup_id str, "
    "subnet_prefix_len int, action str, webhook_ids strs, updated_at ts, deleted int"
)
AUDIT = _struct(
    "ts ts, user_sub str, user_email str, user_role str, action str, resource str, params str, client_ip str, "
    "user_agent str, result str, error_message str"
)
RETENTION_POLICY = _struct("table_name str, ttl_column str, ttl_days int, enabled int, updated_at ts")
