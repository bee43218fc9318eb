"""Datagrams encoded from derived flows with column expressions: input of the decode queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.addr import to_ip16
from ..functions.timeb import bucket

V9_SLOT = 600  # a template is sent at the start of every slot that has flows
RECORDS = 24  # records at most in a data set


def be(value, width: int) -> Column:
    """Big-endian bytes of a non-negative integer."""
    c = F.lit(value) if isinstance(value, int) else (F.col(value) if isinstance(value, str) else value)
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * width, "0"))


def v4(column: str) -> Column:
    return F.substring(to_ip16(column), 13, 4)


def v5_datagrams(flows: DataFrame) -> DataFrame:
    """At most 30 IPv4 flows of one router and instant per datagram (AS numbers must fit 16 bits)."""
    w = Window.partitionBy("router_ip", "timestamp", "sampling_rate").orderBy("flow_id")
    chunked = flows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / 30))
    record = F.concat(
        v4("src_ip"), v4("dst_ip"), be(0, 4), be("in_interface", 2), be("out_interface", 2), be("packets", 4), be("bytes", 4),
        be(0, 8), be("src_port", 2), be("dst_port", 2), be(0, 1), be("tcp_flags", 1), be("protocol", 1), be(0, 1),
        be("src_as", 2), be("dst_as", 2), be(24, 1), be(24, 1), be(0, 2),
    )
    grouped = chunked.withColumn("rec", F.hex(record)).groupBy("router_ip", "timestamp", "sampling_rate", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("flow_id", "rec"))).alias("recs")
    )
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    head = F.concat(
        be(5, 2), be(F.size("recs"), 2), be(0, 4), be(F.floor(micros / 1_000_000), 4), be(micros % 1_000_000 * 1000, 4),
        be(0, 4), be(0, 2), be("sampling_rate", 2),
    )
    body = F.unhex(F.array_join(F.transform("recs", lambda r: r["rec"]), ""))
    return grouped.select("router_ip", F.col("timestamp").cast("timestamp").alias("received_at"), F.concat(head, body).alias("payload"))


V4_TEMPLATE, V6_TEMPLATE = 256, 257


# (element, width, value) of the exported record; the second order is used in every other slot.
def _elements(version: int) -> list[tuple[int, int, Column]]:
    if version == 4:
        ends = [(8, 4, v4("src_ip")), (12, 4, v4("dst_ip")), (9, 1, be(24, 1)), (13, 1, be(24, 1))]
    else:
        ends = [(27, 16, to_ip16("src_ip")), (28, 16, to_ip16("dst_ip")), (29, 1, be(48, 1)), (30, 1, be(48, 1)), (60, 1, be(6, 1))]
    return ends + [
        (1, 8, be("bytes", 8)), (2, 4, be("packets", 4)), (4, 1, be("protocol", 1)), (6, 1, be("tcp_flags", 1)), (7, 2, be("src_port", 2)),
        (11, 2, be("dst_port", 2)), (10, 4, be("in_interface", 4)), (14, 4, be("out_interface", 4)),
        (16, 4, be("src_as", 4)), (17, 4, be("dst_as", 4)), (34, 4, be("sampling_rate", 4)), (61, 1, be(F.col("flow_id") % 2, 1)),
    ]


def _other_order(items: list) -> list:
    return items[:2] + items[:1:-1]


def templated_datagrams(flows: DataFrame, ipfix: bool = False, records: int = RECORDS) -> DataFrame:
    """Per router and slot one datagram with a template for each IP version and an options template, then data datagrams of up to ``records`` flows.

    A data datagram holds one set of flows of one IP version and is sent with the latest of them. IPFIX records end with an enterprise element, which readers skip.
    """
    template_set, options_set = (2, 3) if ipfix else (0, 1)
    enterprise = [(0x8000 + 999, 4, be(7, 4))] if ipfix else []
    seconds = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000)
    base = flows.withColumns({"slot": bucket("timestamp", V9_SLOT), "secs": seconds})
    odd = F.floor(F.unix_timestamp("slot") / V9_SLOT) % 2 == 1

    def message(body: Column, secs: Column, seq: Column) -> Column:
        if ipfix:
            return F.concat(be(10, 2), be(F.lit(16) + F.octet_length(body), 2), be(secs, 4), be(seq, 4), be(7, 4), body)
        return F.concat(be(9, 2), be(1, 2), be(0, 4), be(secs, 4), be(seq, 4), be(7, 4), body)

    def template(number: int, items) -> Column:
        fields = [x for kind, width, _ in items for x in (be(kind, 2), be(width, 2), *([be(32473, 4)] if kind > 0x8000 else []))]
        return F.concat(be(number, 2), be(len(items), 2), *fields)

    def framed(set_id: int, body: Column) -> Column:
        """A set with its header; v9 pads it to four bytes."""
        size = F.octet_length(body)
        pad = F.lit(0) if ipfix else F.pmod(-size, F.lit(4))
        return F.concat(be(set_id, 2), be(F.lit(4) + size + pad, 2), body, F.unhex(F.repeat(F.lit("00"), pad)))

    def ordered(version: int, other: bool) -> list:
        items = _elements(version)
        return (_other_order(items) if other else items) + enterprise

    def templates(other: bool) -> Column:
        both = F.concat(template(V4_TEMPLATE, ordered(4, other)), template(V6_TEMPLATE, ordered(6, other)))
        options = F.concat(be(300, 2), be(1, 2), be(1, 2), be(1, 2), be(4, 2))
        return F.concat(framed(options_set, options), framed(template_set, both))

    def record(version: int, other: bool) -> Column:
        return F.hex(F.concat(*[v for _, _, v in ordered(version, other)]))

    at = F.unix_timestamp("slot")
    known = base.select("router_ip", "slot").distinct().select(
        "router_ip", F.col("slot").cast("timestamp").alias("received_at"),
        message(F.when(odd, templates(True)).otherwise(templates(False)), at, F.lit(0)).alias("payload"),
    )
    six = F.col("ip_version") == 6
    rec = F.when(six & odd, record(6, True)).when(six, record(6, False)).when(odd, record(4, True)).otherwise(record(4, False))
    if records == 1:
        sent = base.select("router_ip", "slot", "ip_version", F.array(F.struct("flow_id", rec.alias("rec"))).alias("recs"), F.col("timestamp").alias("sent"), "secs")
    else:
        group = ["router_ip", "slot", "ip_version"]
        place = F.row_number().over(Window.partitionBy(*group).orderBy("flow_id"))
        sent = base.withColumns({"rec": rec, "chunk": F.floor((place - 1) / records)}).groupBy(*group, "chunk").agg(
            F.array_sort(F.collect_list(F.struct("flow_id", "rec"))).alias("recs"), F.max("timestamp").alias("sent"), F.max("secs").alias("secs")
        )
    joined = F.unhex(F.array_join(F.transform("recs", lambda r: r["rec"]), ""))
    body = F.when(six, framed(V6_TEMPLATE, joined)).otherwise(framed(V4_TEMPLATE, joined))
    data = sent.select(
        "router_ip", F.col("sent").cast("timestamp").alias("received_at"),
        message(body, F.col("secs"), F.element_at("recs", 1)["flow_id"] % 4294967295 + 1).alias("payload"),
    )
    return known.unionByName(data)


def sflow_datagrams(flows: DataFrame) -> DataFrame:
    """One flow sample with an Ethernet and IPv4 or IPv6 header per flow; every other frame carries a VLAN tag."""
    tagged = F.col("flow_id") % 2 == 1
    six = F.col("ip_version") == 6
    kind = F.when(six, be(0x86DD, 2)).otherwise(be(0x0800, 2))
    ether = F.concat(be(0, 8), be(0, 4), F.when(tagged, F.concat(be(0x8100, 2), be(5, 2), kind)).otherwise(kind))
    ip = F.when(six, F.concat(be(0x60, 1), be(0, 5), be("protocol", 1), be(64, 1), to_ip16("src_ip"), to_ip16("dst_ip"))).otherwise(
        F.concat(be(0x45, 1), be(0, 8), be("protocol", 1), be(0, 2), v4("src_ip"), v4("dst_ip"))
    )
    l4 = F.concat(be("src_port", 2), be("dst_port", 2), be(0, 8), be(0x50, 1), be("tcp_flags", 1), be(0, 2))
    frame = F.concat(ether, ip, l4)
    rec_len = F.lit(16) + F.octet_length(frame)
    # 50 or 54 header bytes (70 or 74 with IPv6): two bytes reach the 4-byte boundary.
    record = F.concat(be(1, 4), be(rec_len, 4), be(1, 4), be("bytes", 4), be(4, 4), be(F.octet_length(frame), 4), frame, be(0, 2))
    sample = F.concat(
        be("flow_id", 4), be(0, 4), be("sampling_rate", 4), be(0, 8), be("in_interface", 4), be("out_interface", 4), be(1, 4), record
    )
    rows = flows.select("router_ip", F.col("timestamp").cast("timestamp").alias("received_at"), sample.alias("sample"))
    payload = F.concat(
        be(5, 4), be(1, 4), be(0x0A000001, 4), be(0, 4), be(0, 4), be(0, 4), be(1, 4), be(1, 4),
        be(F.octet_length("sample"), 4), F.col("sample"),
    )
    return rows.select("router_ip", "received_at", payload.alias("payload"))
