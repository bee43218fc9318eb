import ipaddress
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netweir.functions import addr, asn, fmt, names
from netweir.operators.enrich import classify_query
from netweir import params


def packed(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return bytes(16)
    return ip.packed if ip.version == 6 else addr.V4_PREFIX + ip.packed


def test_to_ip16_and_back(spark):
    rnd = random.Random(7)
    texts = ["1.2.3.4", "::ffff:10.0.0.1", "::", "::1", "fe80::", "2001:db8:0:0:1:0:0:1", "1:2:3:4:5:6:7:8", "1.2.3", "1.2.3.4.5",
             "300.1.1.1", "zz", "", "12345::", "1::2:3:4:5:6:7", "ABCD::EF", "0.0.0.0", "255.255.255.255"]
    for _ in range(300):
        groups = [rnd.choice([0, 0, 0, 1, 0xFF, 0xABCD]) for _ in range(8)]
        texts.append(str(ipaddress.IPv6Address(b"".join(g.to_bytes(2, "big") for g in groups))))
        texts.append(str(ipaddress.IPv4Address(rnd.getrandbits(32))))
    df = spark.createDataFrame([(t,) for t in texts], "ip string").withColumn("b", addr.to_ip16("ip")).withColumn("t", addr.ip_text("b"))
    for row in df.collect():
        want = packed(row.ip)
        assert bytes(row.b) == want, row.ip
        address = ipaddress.IPv6Address(want)
        assert row.t == str(address.ipv4_mapped or address), row.ip


def test_null_address_is_unspecified(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS ip").select(addr.to_ip16("ip").alias("b")).first()
    assert bytes(row.b) == bytes(16)


def test_network_and_prefix_of_match_ipaddress(spark):
    rnd = random.Random(3)
    rows = [(str(ipaddress.IPv4Address(rnd.getrandbits(32))), rnd.randint(1, 32)) for _ in range(60)]
    rows += [(str(ipaddress.IPv6Address(rnd.getrandbits(128))), rnd.randint(1, 128)) for _ in range(60)]
    df = spark.createDataFrame(rows, "ip string, n int").withColumn("b", addr.to_ip16("ip"))
    for row in df.withColumn("p", addr.prefix_of("b", "n")).collect():
        assert row.p == str(ipaddress.ip_network(f"{row.ip}/{row.n}", strict=False))
    for length in (0, 7, 48, 64, 100, 120, 128):
        for row in df.withColumn("net", addr.network_of("b", length)).collect():
            mask = ((1 << 128) - 1) ^ ((1 << (128 - length)) - 1)
            assert int.from_bytes(row.net, "big") == int.from_bytes(row.b, "big") & mask
    assert df.limit(1).select(addr.prefix_of("b", F.lit(0)).alias("p")).first().p == ""


@pytest.mark.parametrize(
    "cidrs, hits",
    [
        ([], {"1.2.3.4", "5.6.7.8", "2001:db8::1"}),
        (["junk", "999.1.1.1/8"], {"1.2.3.4", "5.6.7.8", "2001:db8::1"}),
        (["1.2.3.0/24", "junk"], {"1.2.3.4"}),
        (["5.6.7.8"], {"5.6.7.8"}),
        (["2001:db8::/32", "1.2.3.0/24", "1.2.0.0/16"], {"1.2.3.4", "2001:db8::1"}),
    ],
)
def test_cidr_list(spark, cidrs, hits):
    df = spark.createDataFrame([("1.2.3.4",), ("5.6.7.8",), ("2001:db8::1",)], "ip string").withColumn("b", addr.to_ip16("ip"))
    assert {r.ip for r in df.filter(addr.in_cidrs("b", cidrs)).collect()} == hits


def test_label_address_is_fnv1a(spark):
    def fnv(text):
        h = 0xCBF29CE484222325
        for byte in text.encode():
            h = (h ^ byte) * 0x100000001B3 % (1 << 64)
        return b"\x01" + bytes(7) + h.to_bytes(8, "big")

    labels = ["transit-1", "peering-1", "a", "", "lien-é"]
    df = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("b", addr.label_address("label"))
    for row in df.collect():
        assert bytes(row.b) == fnv(row.label), row.label


def test_private_as(spark):
    cases = {64511: False, 64512: True, 65534: True, 65535: False, 4199999999: False, 4200000000: True, 4294967294: True, 4294967295: False}
    df = spark.createDataFrame([(k,) for k in cases], "a long").select("a", asn.is_private("a").alias("p"), asn.grouped_as("a").alias("g"))
    for row in df.collect():
        assert row.p == cases[row.a]
        assert row.g == (asn.PRIVATE_GROUP if row.p else row.a)


def test_asymmetry(spark):
    cases = [(1000, 100000, "content"), (100000, 1000, "eyeball"), (1000, 1000, "balanced"), (0, 100, "content"), (0, 0, "balanced")]
    df = spark.createDataFrame(cases, "i long, o long, want string")
    for row in df.select("*", asn.asymmetry_class("i", "o").alias("got"), asn.asymmetry_ratio("i", "o").alias("ratio")).collect():
        assert row.got == row.want
        assert row.ratio == (0.0 if row.i == row.o == 0 else row.o / max(row.i, 1))


def test_names_and_formats(spark):
    row = spark.range(1).select(
        names.protocol_name(F.lit(6)).alias("tcp"), names.protocol_name(F.lit(250)).alias("other"),
        names.service_name(F.lit(17), F.lit(443)).alias("quic"), names.service_name(F.lit(1), F.lit(443)).alias("none"),
        fmt.humanize(F.lit(999)).alias("b"), fmt.humanize(F.lit(1_500_000)).alias("mb"),
        fmt.format_metric(F.lit("bps"), F.lit(2_500_000.0)).alias("bps"), fmt.format_metric(F.lit("count"), F.lit(3.0)).alias("count"),
        fmt.country_flag(F.lit("fr")).alias("fr"), fmt.country_flag(F.lit("Unknown")).alias("globe"),
    ).first()
    assert (row.tcp, row.other, row.quic, row.none) == ("TCP", "proto:250", "HTTP/3", "")
    assert (row.b, row.mb, row.bps, row["count"]) == ("999 B", "1.50 MB", "2.50 Mbps", "3")
    assert (row.fr, row.globe) == ("\U0001f1eb\U0001f1f7", "\U0001f310")


def test_classify_query(spark):
    cases = {"AS123": ("as", "123"), "a77": ("as", "77"), "42": ("as", "42"), "10.0.0.0/8": ("ip", "10.0.0.0"), "2001:db8::/32": ("ip", "2001:db8::"),
             "some name": ("text", "some name"), "a b:c": ("text", "a b:c")}
    df = spark.createDataFrame([(k,) for k in cases], "q string").withColumn("c", classify_query("q"))
    assert {r.q: (r.c.kind, r.c.key) for r in df.collect()} == cases


T0 = datetime(2024, 1, 24, 15, 30)


def test_windows_steps_and_routes():
    hours = lambda h: (T0 - timedelta(hours=h), T0)
    assert [params.auto_step(*hours(h)) for h in (3, 6, 36, 72, 168, 169)] == [60, 120, 300, 900, 1800, 3600]
    assert params.route_source("as", *hours(3)) == "flows" and params.route_source("ip", *hours(6)) == "flows"
    assert params.route_source("as", *hours(4)) == "traffic_by_as" and params.route_source("ip", *hours(7)) == "traffic_by_ip"
    assert params.route_source("link", *hours(24 * 91)) == "traffic_by_link_hourly"
    assert params.route_source("as", *hours(24 * 731)) == "traffic_by_as_daily"
    for length in (timedelta(hours=24), timedelta(minutes=90)):
        start, end = params.prior_window(T0 - length, T0)
        assert end == T0 - length and end - start == length
    assert params.resolve_window("90m", T0)[0] == T0 - timedelta(minutes=90)
    assert params.resolve_window("1h30m", T0)[0] == T0 - timedelta(minutes=90)
    assert params.resolve_window("week", T0) == (datetime(2024, 1, 22), T0)
    assert params.resolve_window("yesterday", T0) == (datetime(2024, 1, 23), datetime(2024, 1, 24))
    assert params.resolve_window("x", T0)[0] == T0 - timedelta(hours=24)
    big = params.QueryParams(datetime(2024, 1, 1), datetime(2024, 1, 2), limit=5000, offset=10**6, link_tags=[f"t{i}" for i in range(60)])
    assert (big.limit, big.offset, len(big.link_tags)) == (5000, 10**6, 60)
    for bad in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            params.QueryParams(datetime(2024, 1, 1), datetime(2024, 1, 2), **bad)
    assert params.order_column("drop table") == "total_bytes"
    assert params.FlowFilters(T0 - timedelta(days=31), T0, limit=None).limit is None
