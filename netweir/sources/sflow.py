"""sFlow v5 decoding: a walker peels samples and records, headers are read by column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.addr import bytes_to_ip16, uint_at
from .netflow import _finish, _int

VLAN_TYPES = (0x8100, 0x88A8)
SAMPLES_SCHEMA = (
    "router_ip string, received_at timestamp, sampling_rate long, in_interface long, out_interface long, "
    "frame_length long, ether_type int, l3 binary"
)


def _layer3(frame: bytes) -> tuple[int, bytes]:
    """Ether type and network-layer bytes behind any VLAN tags (0 when the frame is cut short)."""
    if len(frame) < 14:
        return 0, b""
    kind, at = _int(frame, 12, 2), 14
    while kind in VLAN_TYPES:
        if at + 4 > len(frame):
            return 0, b""
        kind, at = _int(frame, at + 2, 2), at + 4
    return kind, frame[at:]


def _items(data: bytes, at: int, count: int, pad: bool) -> Iterator[tuple[int, bytes]]:
    """(format, body) of the standard-enterprise items of a tag-length-value list, up to the stated count or the end of the bytes."""
    for _ in range(count):
        if at + 8 > len(data):
            return
        tag, size = _int(data, at, 4), _int(data, at + 4, 4)
        at += 8
        if at + size > len(data):
            return
        if tag >> 12 == 0:
            yield tag & 0xFFF, data[at : at + size]
        at += size
        at += -at % 4 if pad else 0


def _packets(payload: bytes) -> Iterator[tuple]:
    """(agent, sampling, input, output, frame length, ether type, layer 3) of every sampled packet."""
    if len(payload) < 28 or _int(payload, 0, 4) != 5:
        return
    size = {1: 4, 2: 16}.get(_int(payload, 4, 4))
    if size is None or 8 + size + 16 > len(payload):
        return
    agent = str(ipaddress.ip_address(payload[8 : 8 + size]))
    for form, sample in _items(payload, 24 + size, _int(payload, 8 + size + 12, 4), False):
        if form not in (1, 3):
            continue
        # Fixed offsets of (sampling rate, input, output, record count, first record) per sample form.
        rate_at, in_at, out_at, count_at, first, least = (8, 20, 24, 28, 32, 32) if form == 1 else (12, 24, 28, 32, 36, 40)
        if len(sample) < least:
            continue
        rate = _int(sample, rate_at, 4) or 1
        for kind, record in _items(sample, first, _int(sample, count_at, 4), True):
            if kind != 1 or len(record) < 16:
                continue
            size_of_header = _int(record, 12, 4)
            if size_of_header > 65535 or 16 + size_of_header > len(record):
                continue
            ether, l3 = _layer3(record[16 : 16 + size_of_header])
            yield agent, rate, _int(sample, in_at, 4), _int(sample, out_at, 4), _int(record, 4, 4), ether, l3


def sampled_packets(datagrams: DataFrame) -> DataFrame:
    names = [c.split(" ")[0] for c in SAMPLES_SCHEMA.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (router or agent, received, *rest)
                for router, received, payload in zip(pdf.router_ip, pdf.received_at, pdf.payload)
                for agent, *rest in _packets(bytes(payload or b""))
            ]
            yield pd.DataFrame(rows, columns=names)

    return datagrams.select("router_ip", "received_at", "payload").mapInPandas(walk, SAMPLES_SCHEMA)


def decode_sflow_v5(datagrams: DataFrame) -> DataFrame:
    """One flow per sampled packet: bytes = frame length, packets = 1, time = receive time."""
    rows = sampled_packets(datagrams)
    size = F.octet_length("l3")
    v4 = (F.col("ether_type") == 0x0800) & (size >= 20)
    v6 = (F.col("ether_type") == 0x86DD) & (size >= 40)
    header = F.when(v4, (uint_at("l3", 0, 1) % 16 * 4).cast("int")).when(v6, F.lit(40))
    parsed = rows.withColumns(
        {
            "ip_version": F.when(v4, 4).when(v6, 6).otherwise(0),
            "protocol": F.when(v4, uint_at("l3", 9, 1)).when(v6, uint_at("l3", 6, 1)).otherwise(0),
            "src_ip16": bytes_to_ip16(F.when(v4, F.substring("l3", 13, 4)).when(v6, F.substring("l3", 9, 16))),
            "dst_ip16": bytes_to_ip16(F.when(v4, F.substring("l3", 17, 4)).when(v6, F.substring("l3", 25, 16))),
            "l4": F.when((header > 0) & (size >= header + 4), F.substring("l3", header + 1, size - header)),
        }
    )
    ported = F.col("protocol").isin(6, 17) & F.col("l4").isNotNull()
    flags = ported & (F.col("protocol") == 6) & (F.octet_length("l4") >= 14)
    return _finish(
        parsed.withColumns(
            {
                "src_port": F.when(ported, uint_at("l4", 0, 2)).otherwise(0),
                "dst_port": F.when(ported, uint_at("l4", 2, 2)).otherwise(0),
                "tcp_flags": F.when(flags, uint_at("l4", 13, 1)).otherwise(0),
                "timestamp": F.col("received_at"), "bytes": F.col("frame_length"), "packets": F.lit(1),
                "src_as": F.lit(0), "dst_as": F.lit(0), "src_prefix": F.lit(""), "dst_prefix": F.lit(""),
                "link_tag": F.lit(""), "direction": F.lit(""), "flow_type": F.lit("sflow"),
            }
        )
    )
