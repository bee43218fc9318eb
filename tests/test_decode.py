import struct
from datetime import datetime, timedelta, timezone

import pytest

from netweir import schema
from netweir.sources import netflow, sflow

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def datagrams(spark, *payloads, gap=1, router="10.255.0.1"):
    rows = [(router, AT + timedelta(seconds=gap * i), bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, schema.DATAGRAM)


def v5(count, sampling=100, version=5, cut=0):
    head = struct.pack(">HHIIIIBBH", version, count, 123456, 1700000000, 0, 1, 1, 0, sampling)
    recs = b"".join(
        bytes([10, 0, 0, i + 1, 192, 168, 1, i + 1]) + bytes(4) + struct.pack(">HHIIIIHHBBBBHHBBH", 1, 2, 100, 15000, 0, 0, 12345, 80, 0, 2, 6, 0, 64496, 13335, 24, 24, 0)
        for i in range(count))
    data = head + recs
    return data[: len(data) - cut]


def test_v5(spark):
    rows = netflow.decode_netflow_v5(datagrams(spark, v5(5))).orderBy("src_ip").collect()
    assert len(rows) == 5
    r = rows[0]
    assert (r.src_ip, r.dst_ip, r.src_as, r.dst_as, r.bytes, r.packets, r.protocol, r.src_port, r.dst_port) == (
        "10.0.0.1", "192.168.1.1", 64496, 13335, 15000, 100, 6, 12345, 80)
    assert (r.src_prefix, r.dst_prefix, r.sampling_rate, r.tcp_flags, r.in_interface, r.out_interface) == ("10.0.0.0/24", "192.168.1.0/24", 100, 2, 1, 2)


@pytest.mark.parametrize("payload, error", [(b"\0\5" + bytes(8), "short header"), (v5(1, version=9), "wrong version"), (v5(2, cut=5), "truncated"),
                                            (v5(0), "invalid record count"), (v5(31), "invalid record count")])
def test_v5_errors_are_quarantined(spark, payload, error):
    df = datagrams(spark, payload)
    assert [r.error for r in netflow.quarantined_v5(df).collect()] == [error]
    assert netflow.decode_netflow_v5(df).count() == 0


def test_v5_zero_sampling_counts_as_one(spark):
    assert netflow.decode_netflow_v5(datagrams(spark, v5(1, sampling=0))).first().sampling_rate == 1


def v9(*sets, seq=1, secs=1700000000, source=7):
    return struct.pack(">HHIIII", 9, len(sets), 0, secs, seq, source) + b"".join(sets)


def flowset(set_id, body):
    return struct.pack(">HH", set_id, len(body) + 4) + body


def template(template_id, fields):
    return struct.pack(">HH", template_id, len(fields)) + b"".join(struct.pack(">HH", k, n) for k, n in fields)


FIELDS = [(8, 4), (12, 4), (1, 4), (4, 1), (9, 1), (999, 3)]
RECORD = bytes([10, 0, 0, 1, 192, 0, 2, 9]) + struct.pack(">I", 1234) + b"\x11" + b"\x18" + b"zzz"


def test_v9_uses_newest_template_not_older_than_ttl(spark):
    first = v9(flowset(0, template(256, FIELDS)), seq=1)
    data = v9(flowset(256, RECORD * 2), seq=2)
    other = v9(flowset(0, template(256, [FIELDS[1], FIELDS[0], *FIELDS[2:]])), seq=3)
    rows = netflow.decode_netflow_v9(datagrams(spark, first, data, other, data)).collect()
    assert sorted(r.src_ip for r in rows) == ["10.0.0.1", "10.0.0.1", "192.0.2.9", "192.0.2.9"]
    assert {(r.bytes, r.protocol, r.sampling_rate, r.ip_version) for r in rows} == {(1234, 17, 1, 4)}
    assert {r.src_prefix for r in rows} == {"10.0.0.0/24", "192.0.2.0/24"}
    assert netflow.decode_netflow_v9(datagrams(spark, first, data, gap=1801)).count() == 0
    assert netflow.decode_netflow_v9(datagrams(spark, first, data, gap=1800)).count() == 2
    assert netflow.decode_netflow_v9(datagrams(spark, data, first)).count() == 0


def test_v9_template_in_the_same_datagram_counts_by_set_order(spark):
    t, d = flowset(0, template(256, FIELDS)), flowset(256, RECORD)
    assert netflow.decode_netflow_v9(datagrams(spark, v9(t, d))).count() == 1
    assert netflow.decode_netflow_v9(datagrams(spark, v9(d, t))).count() == 0


def test_zero_length_template_is_refused(spark):
    sets = netflow.export_sets(datagrams(spark, v9(flowset(0, template(256, [(8, 0), (12, 0)])), flowset(256, bytes(8)))))
    assert netflow.extract_templates(sets).count() == 0


def test_ipfix_enterprise_fields_and_options(spark):
    body = struct.pack(">HH", 300, 2) + struct.pack(">HHI", 0x8000 | 8, 4, 4242) + struct.pack(">HH", 12, 4)
    options = struct.pack(">HHH", 301, 1, 1) + struct.pack(">HH", 34, 4)
    msg = flowset(2, body) + flowset(3, options) + flowset(300, bytes([1, 1, 1, 1, 2, 2, 2, 2])) + flowset(301, struct.pack(">I", 512))
    head = struct.pack(">HHIII", 10, 16 + len(msg), 1700000000, 1, 5)
    rows = sorted(netflow.decode_ipfix(datagrams(spark, head + msg)).collect(), key=lambda r: r.sampling_rate)
    assert [(r.src_ip, r.dst_ip, r.sampling_rate, r.flow_type) for r in rows] == [("1.1.1.1", "2.2.2.2", 1, "ipfix"), ("::", "::", 512, "ipfix")]


def test_template_layout_order_rules():
    layout, length, version = netflow.template_layout([(9, 1), (8, 4), (27, 16), (1, 8), (23, 4), (7, 1), (16, 3)])
    assert layout["src_mask"] is None  # the mask came before its address
    assert layout["src_ip"] == {"o": 5, "n": 16} and version == 6
    assert layout["bytes"] == {"o": 29, "n": 4}  # the later element of the field wins
    assert layout["src_port"] is None and layout["src_as"] is None and length == 37


def test_wide_counters_saturate(spark):
    fields = [(8, 4), (1, 8)]
    record = bytes([1, 2, 3, 4]) + b"\xff" * 8
    rows = netflow.decode_netflow_v9(datagrams(spark, v9(flowset(0, template(256, fields)), flowset(256, record)))).collect()
    assert rows[0].bytes == netflow.LONG_MAX


def test_routing(spark):
    by = netflow.route_datagrams(datagrams(spark, v5(1), v9(), struct.pack(">HHIII", 10, 16, 0, 0, 0), b"\0", b"\0\7zz"))
    assert {k: d.count() for k, d in by.items()} == {"netflow5": 1, "netflow9": 1, "ipfix": 1, "unknown": 2}


def sample(expanded=False, vlan=0, v6=False):
    tcp = struct.pack(">HHIIBBHHH", 54321, 443, 0, 0, 0x50, 0x12, 0, 0, 0)
    if v6:
        l3 = struct.pack(">IHBB", 6 << 28, len(tcp), 6, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + tcp
    else:
        l3 = struct.pack(">BBHHHBBH", 0x45, 0, 40, 0, 0, 64, 6, 0) + bytes([10, 1, 2, 3, 172, 16, 0, 1]) + tcp
    frame = bytes(12) + b"\x81\x00\x00\x05" * vlan + (b"\x86\xdd" if v6 else b"\x08\x00") + l3
    raw = struct.pack(">IIII", 1, 1500, 4, len(frame)) + frame
    raw += bytes(-len(raw) % 4)
    record = struct.pack(">II", 1, len(raw)) + raw
    if expanded:
        body = struct.pack(">IIIIIIIII", 1, 0, 3, 512, 0, 0, 5, 6, 1) + record
        kind = 3
    else:
        body = struct.pack(">IIIIIIII", 1, 0, 512, 0, 0, 5, 6, 1) + record
        kind = 1
    return struct.pack(">II", kind, len(body)) + body


def sflow5(*samples):
    return struct.pack(">II", 5, 1) + bytes([10, 9, 9, 9]) + struct.pack(">IIII", 0, 1, 1, len(samples)) + b"".join(samples)


def test_sflow(spark):
    counter = struct.pack(">II", 2, 4) + bytes(4)
    df = datagrams(spark, sflow5(sample(), counter, sample(vlan=2)), b"\0\0\0\5short", sflow5(sample(v6=True)))
    rows = sflow.decode_sflow_v5(df).collect()
    v4 = [r for r in rows if r.ip_version == 4]
    assert len(v4) == 2 and len(rows) == 3
    for r in v4:
        assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, r.tcp_flags) == ("10.1.2.3", "172.16.0.1", 54321, 443, 6, 0x12)
        assert (r.sampling_rate, r.in_interface, r.out_interface, r.bytes, r.packets) == (512, 5, 6, 1500, 1)
    assert [(r.src_ip, r.dst_ip, r.dst_port) for r in rows if r.ip_version == 6] == [("::1", "::2", 443)]


def test_sflow_expanded_sample_and_agent_address(spark):
    rows = sflow.decode_sflow_v5(datagrams(spark, sflow5(sample(expanded=True)), router=None)).collect()
    assert [(r.router_ip, r.sampling_rate, r.in_interface, r.out_interface, r.dst_port) for r in rows] == [("10.9.9.9", 512, 5, 6, 443)]


def test_long_sflow_datagrams_are_walked_to_their_end():
    from netweir.sources import sflow

    frame = bytes(12) + b"\x08\x00" + bytes([0x45]) + bytes(8) + bytes([17]) + bytes(2) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + bytes(8)
    be = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    body = be(1, len(frame), 4, len(frame)) + frame + bytes(-len(frame) % 4)
    record = be(1, 16 + len(frame)) + body
    sample = be(1, 0, 100, 0, 0, 1, 2, 1) + record
    payload = be(5, 1, 0x0A000001, 0, 0, 0, 1500) + 1500 * (be(1, len(sample)) + sample)
    assert sum(1 for _ in sflow._packets(payload)) == 1500


def test_every_flow_is_a_data_set_of_the_as_of_match(spark):
    """JON-04 matches each flow on its own; packed datagrams would match a data set of up to 24 flows once."""
    from pyspark.sql import functions as F

    from netweir.catalog import encode, load
    from netweir.catalog.registry import QUERIES
    from netweir.functions.timeb import bucket

    from .test_lake import make_flows

    flows = make_flows(spark, 1, 1440).select("flow_id", *[n for n in schema.FLOW.names if n not in ("link_tag", "direction", "src_ip16", "dst_ip16")])

    load()

    class C:
        def raw_flows(self, kind):
            return flows

    got = {r.router_ip: (r.data_sets, r.age_seconds) for r in QUERIES["JON-04_as_of_template"](C()).collect()}
    age = F.unix_timestamp(F.col("timestamp").cast("timestamp")) - F.unix_timestamp(bucket("timestamp", encode.V9_SLOT).cast("timestamp"))
    want = {r.router_ip: (r.n, r.a) for r in flows.groupBy("router_ip").agg(F.count("*").alias("n"), F.sum(age).alias("a")).collect()}
    assert got == want and sum(n for n, _ in got.values()) == 1440
    packed = netflow.match_templates(netflow.export_sets(encode.templated_datagrams(flows)))
    assert packed.count() < 1440
