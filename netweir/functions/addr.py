"""IP addresses as native column expressions over a 16-byte form.

IPv4 is stored mapped (::ffff:a.b.c.d), so Spark's unsigned byte order on
BINARY is numeric order and a CIDR test is a range comparison that Parquet can
push down.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

UNSPECIFIED = bytes(16)
V4_PREFIX = bytes(10) + b"\xff\xff"

# Ranges that are never "external" hosts.
SPECIAL_RANGES = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "100.64.0.0/10",
    "169.254.0.0/16",
    "fe80::/10",
    "fc00::/7",
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binary(value: bytes) -> Column:
    return F.lit(bytearray(value))


_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DOTTED = f"^{_OCTET}([.]{_OCTET}){{3}}$"


def _v4_hex(ip: Column) -> Column:
    """Dotted quad (also after a ``::ffff:`` prefix) -> 32 hex digits, NULL when malformed."""
    dotted = F.substring_index(ip, ":", -1)
    number = F.aggregate(
        F.split(dotted, "[.]"), F.lit(0).cast("long"), lambda acc, octet: acc * 256 + octet.try_cast("long")
    )
    return F.when(dotted.rlike(_DOTTED), F.concat(F.lit(V4_PREFIX.hex()), F.lpad(F.hex(number), 8, "0")))


def _v6_hex(ip: Column) -> Column:
    """Colon text -> 32 hex digits ('' when malformed).

    '::' is widened to its zero groups and every group is zero-padded by one regex, so each
    intermediate text is referenced once and the generated method stays small enough to be JIT-compiled.
    """
    colons = F.length(ip) - F.length(F.replace(ip, F.lit(":"), F.lit("")))
    groups = colons - F.startswith(ip, F.lit("::")).cast("int") - F.endswith(ip, F.lit("::")).cast("int")
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - groups))
    wide = F.when(ip.contains("::"), F.btrim(F.replace(ip, F.lit("::"), zeros), F.lit(":"))).otherwise(ip)
    long_groups = F.replace(F.concat(F.lit(":"), wide), F.lit(":"), F.lit(":000"))
    digits = F.regexp_replace(long_groups, ":0{0,3}([0-9a-fA-F]{4})(?=:|$)", "$1")
    return F.regexp_extract(digits, "^([0-9a-fA-F]{32})$", 1)


def to_ip16(col) -> Column:
    """Address text -> 16 bytes.  NULL, empty and malformed text give ``::``."""
    ip = _c(col)
    hexed = F.when(ip.contains("."), _v4_hex(ip)).otherwise(_v6_hex(ip))
    raw = F.coalesce(F.unhex(hexed), binary(b""))
    return F.call_function("rpad", raw, F.lit(16), binary(b"\0"))


def bytes_to_ip16(col) -> Column:
    """4- or 16-byte wire form -> 16 bytes (anything else gives ``::``)."""
    raw = _c(col)
    return (
        F.when(F.octet_length(raw) == 4, F.concat(binary(V4_PREFIX), raw))
        .when(F.octet_length(raw) == 16, raw)
        .otherwise(binary(UNSPECIFIED))
    )


def is_v4(ip16) -> Column:
    return F.substring(_c(ip16), 1, 12) == binary(V4_PREFIX)


def uint_at(raw, offset: int, width: int) -> Column:
    """Big-endian unsigned integer at a 0-based byte offset (width up to 7)."""
    return F.conv(F.hex(F.substring(_c(raw), offset + 1, width)), 16, 10).cast("long")


def _dotted(number: Column) -> Column:
    octets = [F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def let(value: Column, body) -> Column:
    """Bind an expression to a variable: it is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _compressed(full: Column) -> Column:
    """Eight groups without leading zeros -> text with the first longest zero run as '::'."""
    out = full
    for run in range(2, 9):  # the outermost test is the longest run
        pattern = f"^((?:[0-9a-f]+:)*?)0(?::0){{{run - 1}}}((?::[0-9a-f]+)*)$"
        short = F.regexp_replace(F.regexp_replace(full, pattern, "$1X$2"), ":?X:?", "::")
        out = F.when(full.rlike(pattern), short).otherwise(out)
    return out


def ip_text(col) -> Column:
    """16 bytes -> canonical text (dotted quad for mapped IPv4, longest zero run compressed)."""

    ip = _c(col)
    digits = F.regexp_replace(F.lower(F.hex(ip)), "(.{4})(?!$)", "$1:")
    groups = F.regexp_replace(digits, "(^|:)0{1,3}(?=[0-9a-f])", "$1")
    return F.when(is_v4(ip), _dotted(uint_at(ip, 12, 4))).otherwise(let(groups, _compressed))


def _word(ip: Column, i: int) -> Column:
    return uint_at(ip, 4 * i, 4)


def network_of(ip16, length) -> Column:
    """Network address (16 bytes) for a prefix length counted on 128 bits.

    A literal length is a byte slice; a column length masks four 32-bit words.
    """
    ip = _c(ip16)
    if isinstance(length, int):
        keep, part = divmod(max(0, min(length, 128)), 8)
        pieces = [F.substring(ip, 1, keep)] if keep else []
        if part:
            mask = (0xFF << (8 - part)) & 0xFF
            octet = uint_at(ip, keep, 1).bitwiseAND(F.lit(mask))
            pieces.append(F.unhex(F.lpad(F.hex(octet), 2, "0")))
        tail = 16 - keep - bool(part)
        if tail:
            pieces.append(binary(bytes(tail)))
        return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


    def masked(i: int, bits: Column) -> Column:
        drop = F.lit(32) - F.least(F.greatest(bits - 32 * i, F.lit(0)), F.lit(32)).cast("int")
        cut = F.call_function("shiftright", _word(ip, i), drop)
        return F.lpad(F.hex(F.call_function("shiftleft", cut, drop)), 8, "0")

    return let(length, lambda bits: F.unhex(F.concat(*[masked(i, bits) for i in range(4)])))


def prefix_of(ip16, length) -> Column:
    """CIDR text from an address and its family's own mask length; 0 gives ''."""
    ip, n = _c(ip16), _c(length).cast("int")
    drop = F.lit(32) - n
    v4 = _dotted(F.call_function("shiftleft", F.call_function("shiftright", uint_at(ip, 12, 4), drop), drop))
    network = F.when(is_v4(ip), v4).otherwise(let(network_of(ip, n), ip_text))
    return F.when(n > 0, F.concat(network, F.lit("/"), n.cast("string"))).otherwise("")


def parse_networks(cidrs: Iterable[str]) -> list[tuple[bytes, int]]:
    """CIDR / bare-address texts -> (network bytes, length on 128 bits); bad entries are skipped."""
    out = []
    for text in cidrs:
        try:
            net = ipaddress.ip_network(text.strip(), strict=False)
        except ValueError:
            continue
        if net.version == 4:
            out.append((V4_PREFIX + net.network_address.packed, net.prefixlen + 96))
        else:
            out.append((net.network_address.packed, net.prefixlen))
    return out


def _range(net: bytes, length: int) -> tuple[bytes, bytes]:
    low = int.from_bytes(net, "big")
    return net, (low | ((1 << (128 - length)) - 1)).to_bytes(16, "big")


def in_network(ip16, cidr: str) -> Column:
    low, high = _range(*parse_networks([cidr])[0])
    return _c(ip16).between(binary(low), binary(high))


def in_cidrs(ip16, cidrs: Iterable[str]) -> Column:
    """Membership in a short CIDR list.  Empty or wholly invalid lists match every row.

    Overlapping entries are collapsed first, so each range is tested once.
    """
    nets = [ipaddress.IPv6Network((net, length)) for net, length in parse_networks(cidrs)]
    if not nets:
        return F.lit(True)
    match = F.lit(False)
    for net in ipaddress.collapse_addresses(nets):
        low, high = _range(net.network_address.packed, net.prefixlen)
        match = match | _c(ip16).between(binary(low), binary(high))
    return match


def in_scope(ip16, scope: str, local: Iterable[str]) -> Column:
    """'internal' = in the local list; 'external' = neither local nor a special-use range."""
    local = list(local)
    if scope not in ("internal", "external") or not parse_networks(local):
        return F.lit(True)
    inside = in_cidrs(ip16, local)
    return inside if scope == "internal" else ~inside & ~in_cidrs(ip16, SPECIAL_RANGES)


def same_address(ip16, text: str) -> Column:
    """Equality with one address, whichever spelling (plain or mapped) was given."""
    nets = parse_networks([text])
    return _c(ip16) == binary(nets[0][0]) if nets and nets[0][1] == 128 else F.lit(False)


def strip_mapped(col) -> Column:
    return F.regexp_replace(_c(col), "^::ffff:", "")


def label_address(label) -> Column:
    """Stable synthetic address in 0100::/64 for a target that has no IP: FNV-1a 64 of the label.

    64-bit arithmetic is done on two 32-bit halves so it never overflows LONG.
    """
    codes = F.transform(
        F.sequence(F.lit(1), F.octet_length(_c(label))),
        lambda i: F.conv(F.hex(F.substring(F.encode(_c(label), "UTF-8"), i, F.lit(1))), 16, 10).cast("long"),
    )
    # FNV-1a 64-bit offset basis and prime.
    basis, prime = 0xCBF29CE484222325, 0x100000001B3
    start = F.struct(F.lit(basis >> 32).cast("long").alias("hi"), F.lit(basis & 0xFFFFFFFF).cast("long").alias("lo"))
    low32, rest = F.lit(0xFFFFFFFF), F.lit(prime & 0xFFFF)

    def mix(acc, code):
        lo = acc["lo"].bitwiseXOR(code)
        prod = lo * rest
        # prime = 2^40 + rest: the high half gains lo << 8 plus the carry of lo * rest.
        hi = (acc["hi"] * rest + F.shiftleft(lo, 8) + F.shiftright(prod, 32)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), prod.bitwiseAND(low32).alias("lo"))

    def text(acc):
        return F.concat(F.lpad(F.hex(acc["hi"]), 8, "0"), F.lpad(F.hex(acc["lo"]), 8, "0"))

    empty = F.lit(f"{basis:x}")
    digest = F.when(F.octet_length(_c(label)) == 0, empty).otherwise(F.aggregate(codes, start, mix, text))
    return F.unhex(F.concat(F.lit("0100000000000000"), digest))
