"""SQL that derives flows, links, AS names and config tables from the given tables.

The text is portable: Spark and DuckDB run the same statements and get the same rows.
"""

LOCAL_AS = 64500
LOCAL_PREFIXES = ("192.0.2.0/24", "198.51.100.0/24", "2001:db8:1::/48")

_EVENTS = """b AS (
  SELECT event_id AS id, ts, user_id AS u,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         (event_id * 2654435761) % 4294967296 AS h,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS vol
  FROM events
)"""

_LINEITEM = """b0 AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_shipdate, l_suppkey AS u, l_partkey % 100 AS k,
         (l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber * 97) % 4294967296 AS h,
         CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS vol
  FROM lineitem
), b AS (
  SELECT id, l_shipdate + (h % 86400) * INTERVAL '1' SECOND AS ts, u, k, h, vol FROM b0
)"""

_FLOWS = """p AS (
  SELECT b.*,
    id % 2 AS outb,
    CASE WHEN id % 5 = 4 THEN 6 ELSE 4 END AS ipv,
    CASE WHEN k % 20 = 0 THEN 0
         WHEN k % 20 IN (1, 2) THEN 64512 + k
         WHEN k % 20 = 3 THEN 4200000000 + k
         ELSE 1000 + u % 120 END AS ext_as,
    CASE WHEN id % 3 = 0 THEN 64512 ELSE 0 END AS loc_as
  FROM b
), q AS (
  SELECT p.*,
    CASE WHEN ipv = 4 THEN concat('203.0.', CAST(u % 16 AS VARCHAR(20)), '.', CAST(1 + h % 32 AS VARCHAR(20)))
         ELSE concat('2001:db8:ff::', CAST(1 + h % 9 AS VARCHAR(20))) END AS ext_ip,
    CASE WHEN ipv = 4 THEN concat(CASE WHEN k % 3 = 0 THEN '192.0.2.' ELSE '198.51.100.' END, CAST(1 + k % 30 AS VARCHAR(20)))
         ELSE concat('2001:db8:1::', CAST(1 + k % 9 AS VARCHAR(20))) END AS loc_ip,
    CASE WHEN id % 11 = 0 THEN '' WHEN ipv = 4 THEN concat('203.0.', CAST(u % 16 AS VARCHAR(20)), '.0/24')
         ELSE '2001:db8:ff::/48' END AS ext_px,
    CASE WHEN ipv = 6 THEN '2001:db8:1::/48' WHEN k % 3 = 0 THEN '192.0.2.0/24'
         WHEN k % 2 = 0 THEN '198.51.100.0/24' ELSE '198.51.100.0/25' END AS loc_px
  FROM p
), flows AS (
SELECT id AS flow_id, ts AS timestamp,
  concat('10.255.0.', CAST(1 + h % 2 AS VARCHAR(20))) AS router_ip,
  CASE WHEN outb = 1 THEN loc_ip ELSE ext_ip END AS src_ip,
  CASE WHEN outb = 1 THEN ext_ip ELSE loc_ip END AS dst_ip,
  ipv AS ip_version,
  CAST(CASE WHEN outb = 1 THEN loc_as ELSE ext_as END AS BIGINT) AS src_as,
  CAST(CASE WHEN outb = 1 THEN ext_as ELSE loc_as END AS BIGINT) AS dst_as,
  CASE WHEN outb = 1 THEN loc_px ELSE ext_px END AS src_prefix,
  CASE WHEN outb = 1 THEN ext_px ELSE loc_px END AS dst_prefix,
  CASE WHEN h % 10 = 0 THEN 1 WHEN h % 10 < 7 THEN 6 ELSE 17 END AS protocol,
  CAST(CASE WHEN h % 10 = 0 THEN 0 ELSE 1024 + h % 4000 END AS INT) AS src_port,
  CAST(CASE WHEN h % 10 = 0 THEN 0 WHEN k % 4 = 0 THEN 443 WHEN k % 4 = 1 THEN 53
       WHEN k % 4 = 2 THEN 25 ELSE 1 + k * 97 END AS INT) AS dst_port,
  CASE WHEN h % 10 BETWEEN 1 AND 6 THEN CASE WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 18 ELSE 16 END ELSE 0 END AS tcp_flags,
  vol * 64 AS bytes,
  1 + k AS packets,
  CASE WHEN h % 4 = 0 THEN 1 ELSE 100 END AS sampling_rate,
  1 + CAST(floor(h / 16) AS BIGINT) % 3 AS in_interface,
  1 + (CAST(floor(h / 64) AS BIGINT) + k) % 3 AS out_interface,
  CASE WHEN h % 7 = 0 THEN 'sflow' ELSE 'netflow9' END AS flow_type
FROM q
)"""

FLOW_CTES = {"ev": f"{_EVENTS}\n, {_FLOWS}", "li": f"{_LINEITEM}\n, {_FLOWS}"}
FLOW_TABLE = {"ev": "events", "li": "lineitem"}

LINKS = """SELECT tag, router_ip, CAST(snmp_index AS BIGINT) AS snmp_index, description,
       CAST(capacity_mbps AS BIGINT) AS capacity_mbps, updated_at
FROM (VALUES
 ('transit-1','10.255.0.1',1,'Transit one',10000,TIMESTAMP '2024-01-01 00:00:00'),
 ('transit-1','10.255.0.1',1,'Transit one (old)',1000,TIMESTAMP '2023-01-01 00:00:00'),
 ('transit-2','10.255.0.2',1,'Transit two',10,TIMESTAMP '2024-01-01 00:00:00'),
 ('peering-1','10.255.0.1',2,'Peering IX',100,TIMESTAMP '2024-01-01 00:00:00'),
 ('core-1','10.255.0.2',3,'Core uplink',0,TIMESTAMP '2024-01-01 00:00:00')
) AS t(tag, router_ip, snmp_index, description, capacity_mbps, updated_at)"""

AS_NAMES = """SELECT 1000 + s_suppkey AS as_number, s_name AS as_name,
       CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE substring(n_name, 1, 2) END AS country,
       TIMESTAMP '2024-01-01 00:00:00' AS updated_at
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 1000 + s_suppkey, concat(s_name, ' (old)'), '', TIMESTAMP '2023-01-01 00:00:00'
FROM supplier WHERE s_suppkey % 3 = 0"""

# Versioned host groups: every order is one version of its customer's group, every seventh a tombstone.
HOSTGROUPS = """SELECT concat('hg-', CAST(o_custkey AS VARCHAR(20))) AS id,
       concat('group ', CAST(o_custkey AS VARCHAR(20)), ' v', CAST(o_orderkey AS VARCHAR(20))) AS name,
       concat('203.0.', CAST(o_custkey % 16 AS VARCHAR(20)), '.0/24') AS cidr,
       o_orderdate + o_orderkey * INTERVAL '1' SECOND AS updated_at,
       CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS deleted
FROM orders"""

# Alerts: one per event, with a deterministic severity, status and target.
ALERTS = """SELECT concat('a-', CAST(event_id AS VARCHAR(20))) AS id,
       concat('r-', CAST(event_id % 15 AS VARCHAR(20))) AS rule_id,
       concat('rule ', CAST(event_id % 15 AS VARCHAR(20))) AS rule_name,
       CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
       ts AS triggered_at,
       ts + (event_id % 900) * INTERVAL '1' SECOND AS last_seen_at,
       concat('203.0.', CAST(user_id % 16 AS VARCHAR(20)), '.', CAST(1 + event_id % 32 AS VARCHAR(20))) AS target,
       CASE WHEN event_id % 9 = 0 THEN 'label' ELSE 'ip' END AS target_kind,
       CAST(floor(value * 100 + 0.5) AS BIGINT) AS metric_value, CAST(event_id % 7 * 100 AS DOUBLE) AS threshold,
       CASE event_id % 2 WHEN 0 THEN 'bps' ELSE 'pps' END AS metric_type,
       CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' ELSE 'active' END AS status,
       CASE WHEN event_id % 5 = 1 THEN 'night@example.net' END AS acknowledged_by,
       CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL '1' MINUTE END AS acknowledged_at,
       CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL '20' MINUTE END AS resolved_at
FROM events"""

# Audit trail: one entry per order.
AUDIT = """SELECT o_orderdate + o_orderkey * INTERVAL '1' SECOND AS ts,
       concat('user', CAST(o_custkey % 20 AS VARCHAR(20)), '@example.net') AS user_email,
       CASE o_orderstatus WHEN 'F' THEN 'flow_search' WHEN 'O' THEN 'rule_update' ELSE 'alert_ack' END AS action,
       concat('orders/', CAST(o_orderkey AS VARCHAR(20))) AS resource, 'success' AS result
FROM orders"""

# Blocks: one per alert of rule 3, an hour long, every fourth withdrawn after ten minutes.
BLOCKS = """SELECT concat('b-', CAST(event_id AS VARCHAR(20))) AS id,
       concat('203.0.', CAST(user_id % 16 AS VARCHAR(20)), '.', CAST(1 + event_id % 32 AS VARCHAR(20))) AS ip,
       CASE WHEN event_id % 4 = 0 THEN 'withdrawn' ELSE 'active' END AS status,
       ts AS blocked_at, ts + INTERVAL '1' HOUR AS expires_at,
       CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL '10' MINUTE END AS unblocked_at,
       CASE WHEN event_id % 4 = 0 THEN 'alice' END AS unblocked_by, CASE WHEN event_id % 4 = 0 THEN 'false alarm' END AS unblock_reason
FROM events WHERE event_type = 'error'"""
