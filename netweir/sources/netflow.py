"""NetFlow v5/v9 and IPFIX decoding of captured datagrams ``(router_ip, received_at, payload)``.

v5 has fixed offsets and is decoded with column expressions only.  v9 and IPFIX are
template driven: a small Arrow-batched walker cuts a datagram into its sets and turns a
template into byte positions; the as-of template match, record split and field reads are
joins and column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema
from ..functions.addr import bytes_to_ip16, ip_text, prefix_of, uint_at
from ..operators.enrich import exported_direction

V5_HEADER, V5_RECORD, V5_MAX = 24, 48, 30
TEMPLATE_TTL = 1800
MAX_FIELDS = 256
LONG_MAX = (1 << 63) - 1


def version_of(payload="payload") -> Column:
    return F.when(F.octet_length(payload) >= 2, uint_at(payload, 0, 2)).otherwise(F.lit(-1))


VERSIONS = {5: "netflow5", 9: "netflow9", 10: "ipfix"}


def export_kind(payload="payload") -> Column:
    kind = F.lit("unknown")
    for number, name in VERSIONS.items():
        kind = F.when(version_of(payload) == number, name).otherwise(kind)
    return kind


def route_datagrams(datagrams: DataFrame) -> dict[str, DataFrame]:
    """Split by export version; anything else goes to ``unknown``."""
    kinds = (*VERSIONS.values(), "unknown")
    return {name: datagrams.filter(export_kind() == name) for name in kinds}


def _finish(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical FLOW columns from decoded addresses (``src_ip16``/``dst_ip16``) and fields, and the columns to keep."""
    return rows.withColumns({"src_ip": ip_text("src_ip16"), "dst_ip": ip_text("dst_ip16")}).select(
        *[F.col(f.name).cast(f.dataType) for f in schema.FLOW.fields], *keep
    )


# ---- v5 ----------------------------------------------------------------------------


def v5_error(payload="payload") -> Column:
    size, count = F.octet_length(payload), uint_at(payload, 2, 2)
    return (
        F.when(size < V5_HEADER, "short header")
        .when(uint_at(payload, 0, 2) != 5, "wrong version")
        .when((count == 0) | (count > V5_MAX), "invalid record count")
        .when(size < V5_HEADER + count * V5_RECORD, "truncated")
    )


def quarantined_v5(datagrams: DataFrame) -> DataFrame:
    return datagrams.withColumn("error", v5_error()).filter("error IS NOT NULL")


def decode_netflow_v5(datagrams: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flows of the datagrams without an error; ``keep`` names further columns of the datagrams to carry along."""
    good = datagrams.filter(v5_error().isNull())
    seconds, nanos = uint_at("payload", 8, 4), uint_at("payload", 12, 4)
    sampling = uint_at("payload", 22, 2).bitwiseAND(F.lit(0x3FFF))
    records = good.select(
        "router_ip", *keep,
        F.timestamp_micros(seconds * 1_000_000 + F.floor(nanos / 1000)).alias("timestamp"),
        F.greatest(sampling, F.lit(1)).alias("sampling_rate"),
        "payload",
        F.explode(F.sequence(F.lit(0), uint_at("payload", 2, 2).cast("int") - 1)).alias("i"),
    )
    rec = records.withColumn(
        "rec", F.substring("payload", F.lit(V5_HEADER + 1) + F.col("i") * V5_RECORD, F.lit(V5_RECORD))
    )
    u = lambda off, width: uint_at("rec", off, width)
    fields = rec.select(
        "router_ip", "timestamp", "sampling_rate", *keep,
        bytes_to_ip16(F.substring("rec", 1, 4)).alias("src_ip16"), bytes_to_ip16(F.substring("rec", 5, 4)).alias("dst_ip16"),
        u(12, 2).alias("in_interface"), u(14, 2).alias("out_interface"), u(16, 4).alias("packets"), u(20, 4).alias("bytes"),
        u(32, 2).alias("src_port"), u(34, 2).alias("dst_port"), u(37, 1).alias("tcp_flags"), u(38, 1).alias("protocol"),
        u(40, 2).alias("src_as"), u(42, 2).alias("dst_as"), u(44, 1).alias("_sm"), u(45, 1).alias("_dm"),
    )
    return _finish(
        fields.withColumns(
            {
                "src_prefix": prefix_of("src_ip16", "_sm"), "dst_prefix": prefix_of("dst_ip16", "_dm"),
                "ip_version": F.lit(4), "link_tag": F.lit(""), "direction": F.lit(""), "flow_type": F.lit("netflow5"),
            }
        ),
        keep,
    )


# ---- v9 / IPFIX ---------------------------------------------------------------------

# IANA information element -> (flow field, reader).  Readers: a4/a16 address,
# u1/u2 fixed width, u32/u64 variable width, mask.
ELEMENTS = {
    1: ("bytes", "u64"), 2: ("packets", "u64"), 4: ("protocol", "u1"), 6: ("tcp_flags", "u1"), 7: ("src_port", "u2"),
    8: ("src_ip", "a4"), 9: ("src_mask", "mask"), 10: ("in_interface", "u32"), 11: ("dst_port", "u2"),
    12: ("dst_ip", "a4"), 13: ("dst_mask", "mask"), 14: ("out_interface", "u32"), 16: ("src_as", "u32"),
    17: ("dst_as", "u32"), 23: ("bytes", "u64"), 24: ("packets", "u64"), 27: ("src_ip", "a16"), 28: ("dst_ip", "a16"),
    29: ("src_mask", "mask"), 30: ("dst_mask", "mask"), 34: ("sampling_rate", "u32"), 60: ("ip_version", "u1"),
    61: ("direction", "u1"),
}
FIELDS = sorted({name for name, _ in ELEMENTS.values()})
_POSITIONS = ", ".join(f"{f}: struct<o: int, n: int>" for f in FIELDS)
SETS_SCHEMA = (
    "router_ip string, received_at timestamp, export_seconds long, source_id long, sequence long, set_no int, "
    f"template_id int, body binary, record_length int, base_version int, layout struct<{_POSITIONS}>"
)

_FIXED_WIDTH = {"a4": 4, "a16": 16, "u1": 1, "u2": 2, "mask": 1}


def _width(reader: str, length: int) -> int:
    """Bytes a reader takes from an element of this length; 0 means the element is ignored."""
    if reader in _FIXED_WIDTH:
        return _FIXED_WIDTH[reader] if length >= _FIXED_WIDTH[reader] else 0
    most = 4 if reader == "u32" else 8
    return length if length in (1, 2, 4, 8) and length <= most else (most if length > most else 0)


def template_layout(elements: list[tuple[int, int]]) -> tuple[dict, int, int]:
    """(type, length) list -> byte position per flow field, record length, IP version when no field says.

    Elements apply in order: a later one of the same field wins, and a mask only counts
    after its address.
    """
    layout, at, version = dict.fromkeys(FIELDS), 0, 4
    for kind, length in elements:
        name, reader = ELEMENTS.get(kind, (None, ""))
        width = _width(reader, length) if name else 0
        if width and not (reader == "mask" and layout[name.replace("mask", "ip")] is None):
            layout[name] = {"o": at, "n": width}
            if reader == "a16":
                version, layout["ip_version"] = 6, None
        at += length
    return layout, at, version


def _int(data: bytes, at: int, width: int) -> int:
    return int.from_bytes(data[at : at + width], "big")


def _sets(payload: bytes, ipfix: bool) -> Iterator[tuple[int, bytes]]:
    at = 16 if ipfix else 20
    end = min(_int(payload, 2, 2), len(payload)) if ipfix else len(payload)
    while at + 4 <= end:
        set_id, size = _int(payload, at, 2), _int(payload, at + 2, 2)
        if size < 4 or at + size > end:
            return
        yield set_id, payload[at + 4 : at + size]
        at += size
        at += 0 if ipfix else -at % 4


def _templates(body: bytes, ipfix: bool, options: bool) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    at = 0
    while at + 4 <= len(body):
        template, count = _int(body, at, 2), _int(body, at + 2, 2)
        at += 6 if options else 4
        elements = []
        if not options and not 0 < count <= MAX_FIELDS:
            return
        for _ in range(count):
            if at + 4 > len(body):
                return
            kind, length = _int(body, at, 2), _int(body, at + 2, 2)
            at += 4
            if ipfix and kind & 0x8000:  # enterprise element: its number follows
                kind, at = kind & 0x7FFF, at + 4
                if at > len(body):
                    return
            elements.append((kind, length))
        yield template, elements
        if options:
            return


def export_sets(datagrams: DataFrame, ipfix: bool = False) -> DataFrame:
    """One row per data set (``body`` set) and per template (``layout`` set) of v9 or IPFIX datagrams."""
    version, header = (10, 16) if ipfix else (9, 20)
    secs_at, seq_at, src_at = (4, 8, 12) if ipfix else (8, 12, 16)
    template_set, options_set = (2, 3) if ipfix else (0, None)
    names = [c.split(" ")[0] for c in SETS_SCHEMA.split(", layout")[0].split(", ")] + ["layout"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for router, received, payload in zip(pdf.router_ip, pdf.received_at, pdf.payload):
                payload = bytes(payload or b"")
                if len(payload) < header or _int(payload, 0, 2) != version:
                    continue
                head = (router, received, _int(payload, secs_at, 4), _int(payload, src_at, 4), _int(payload, seq_at, 4))
                for no, (set_id, body) in enumerate(_sets(payload, ipfix)):
                    if set_id >= 256:
                        rows.append((*head, no, set_id, body, 0, 0, None))
                    elif set_id in (template_set, options_set):
                        for template, elements in _templates(body, ipfix, set_id == options_set):
                            layout, length, base = template_layout(elements)
                            if length > 0:  # a zero-length record could never be split
                                rows.append((*head, no, template, None, length, base, layout))
            yield pd.DataFrame(rows, columns=names)

    return datagrams.select("router_ip", "received_at", "payload").mapInPandas(walk, SETS_SCHEMA)


def extract_templates(sets: DataFrame) -> DataFrame:
    return sets.filter(F.col("layout").isNotNull()).drop("body")


TEMPLATE_KEY = ["router_ip", "source_id", "template_id"]
SLOT_SECONDS = 300


def slotted(sets: DataFrame, ttl: int = TEMPLATE_TTL, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Data in the time slot of its arrival, templates in every slot that they may be valid in."""
    slot = F.floor(F.unix_timestamp("received_at") / slot_seconds)
    slots = F.when(F.col("layout").isNotNull(), F.sequence(slot, slot + -(-ttl // slot_seconds))).otherwise(F.array(slot))
    return sets.withColumn("slot", F.explode(slots))


def match_templates(sets: DataFrame, ttl: int = TEMPLATE_TTL, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """As-of match: each data set gets the newest template of its key that is not older than ``ttl`` seconds.

    ``sets`` holds templates and data together, so the walker's output is read once. Rows are dealt by (key, time slot) and sorted by arrival, and the last
    template is carried forward over the data behind it. A template also leads every later slot that it may still be valid in, so slots need
    nothing of each other and a busy exporter spreads over them.
    """
    key = TEMPLATE_KEY
    is_template = F.col("layout").isNotNull()
    known = F.struct(F.col("received_at").alias("t_at"), "record_length", "base_version", "layout")
    w = Window.partitionBy(*key, "slot").orderBy("received_at", "sequence", "set_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = slotted(sets, ttl, slot_seconds).withColumn("known", F.last(F.when(is_template, known), ignorenulls=True).over(w))
    data = carried.filter(F.col("body").isNotNull() & F.col("known").isNotNull())
    fresh = F.col("received_at") <= F.col("known.t_at") + F.make_dt_interval(secs=F.lit(ttl))
    return data.filter(fresh).select(*key, "received_at", "export_seconds", "body", "known.*")


def _bytes_of(name: str) -> Column:
    at = F.col(f"layout.{name}")
    return F.substring(F.col("rec"), at["o"] + 1, at["n"])


def _uint_of(name: str, default: int = 0) -> Column:
    """Unsigned value of a field; absent fields take the default, 64-bit values saturate at LONG."""
    digits = F.conv(F.hex(_bytes_of(name)), 16, 10).cast("decimal(20,0)")
    value = F.least(digits, F.lit(LONG_MAX).cast("decimal(20,0)")).cast("long")
    # least() skips NULL, so absence has to be tested first.
    return F.when(digits.isNull(), F.lit(default).cast("long")).otherwise(value)


def read_records(matched: DataFrame, flow_type: str) -> DataFrame:
    """Split matched data sets into records and read their fields."""
    count = F.floor(F.octet_length("body") / F.col("record_length")).cast("int")
    split = matched.filter(count > 0).select(
        "router_ip", "export_seconds", "base_version", "layout", "record_length", "body",
        F.explode(F.sequence(F.lit(0), count - 1)).alias("i"),
    )
    rec = split.withColumn("rec", F.substring("body", F.col("i") * F.col("record_length") + 1, F.col("record_length")))
    numbers = {
        n: _uint_of(n)
        for n in ("bytes", "packets", "protocol", "tcp_flags", "src_port", "dst_port", "in_interface", "out_interface",
                  "src_as", "dst_as")
    }
    fields = rec.withColumns(
        {
            **numbers,
            "src_ip16": bytes_to_ip16(_bytes_of("src_ip")), "dst_ip16": bytes_to_ip16(_bytes_of("dst_ip")),
            "_sm": _uint_of("src_mask"), "_dm": _uint_of("dst_mask"), "sampling_rate": _uint_of("sampling_rate", 1),
            "ip_version": F.when(F.col("layout.ip_version").isNotNull(), _uint_of("ip_version")).otherwise(F.col("base_version")),
            "direction": exported_direction(F.when(F.col("layout.direction").isNotNull(), _uint_of("direction"))),
            "timestamp": F.timestamp_seconds("export_seconds"), "link_tag": F.lit(""), "flow_type": F.lit(flow_type),
        }
    )
    return _finish(
        fields.withColumns({"src_prefix": prefix_of("src_ip16", "_sm"), "dst_prefix": prefix_of("dst_ip16", "_dm")})
    )


def decode_templated(datagrams: DataFrame, ipfix: bool, templates: DataFrame | None = None) -> DataFrame:
    """Flows of v9 or IPFIX datagrams, by the templates among them or by the given ones alone."""
    sets = export_sets(datagrams, ipfix)
    if templates is not None:
        sets = sets.filter("body IS NOT NULL").unionByName(templates.withColumn("body", F.lit(None).cast("binary")))
    return read_records(match_templates(sets), "ipfix" if ipfix else "netflow9")


def decode_netflow_v9(datagrams: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    return decode_templated(datagrams, False, templates)


def decode_ipfix(datagrams: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    return decode_templated(datagrams, True, templates)


def decode_all(datagrams: DataFrame) -> DataFrame:
    """All NetFlow versions of a mixed capture."""
    by = route_datagrams(datagrams)
    out = decode_netflow_v5(by["netflow5"])
    return out.unionByName(decode_netflow_v9(by["netflow9"])).unionByName(decode_ipfix(by["ipfix"]))
