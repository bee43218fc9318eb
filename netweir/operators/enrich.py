"""Row-level enrichment of decoded flows (batch and streaming): all map-side except large dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.addr import in_cidrs, network_of, parse_networks, to_ip16
from ..functions.asn import is_private
from .scopes import networks

FUTURE_SKEW = "INTERVAL 5 MINUTES"
PAST_SKEW = "INTERVAL 24 HOURS"


def interface_map(current_links: DataFrame) -> DataFrame:
    """(router, interface) -> tag, one tag per interface: the newest configuration wins."""
    return current_links.groupBy("router_ip", "snmp_index").agg(
        F.max(F.struct("updated_at", "tag")).getField("tag").alias("tag")
    )


def attribute_links(flows: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Tag a flow by its input interface ('in'), else by its output interface ('out').

    ``interfaces`` comes from :func:`interface_map`; broadcast it when bounded so the
    fact table is not shuffled.
    """
    had = {"link_tag", "direction"} <= set(flows.columns)
    side = interfaces.select(
        F.col("router_ip").alias("_r"), F.col("snmp_index").cast("long").alias("_i"), F.col("tag").alias("_t")
    )

    def match(df, interface, tag):
        renamed = side.withColumnRenamed("_t", tag)
        on = (F.col("router_ip") == F.col("_r")) & (F.col(interface) == F.col("_i"))
        return df.join(renamed, on, "left").drop("_r", "_i")

    out = match(match(flows, "in_interface", "_in"), "out_interface", "_out")
    tag0, dir0 = (F.col("link_tag"), F.col("direction")) if had else (F.lit(""), F.lit(""))
    # An exporter-supplied tag survives unless the input interface matches; only an untagged flow looks at the output.
    tag = F.coalesce("_in", F.when(tag0 != "", tag0), "_out", tag0)
    direction = (
        F.when(F.col("_in").isNotNull(), "in").when(tag0 != "", dir0).when(F.col("_out").isNotNull(), "out").otherwise(dir0)
    )
    return out.withColumns({"link_tag": tag, "direction": direction}).drop("_in", "_out")


def clamp_timestamps(flows: DataFrame, received: str = "received_at") -> DataFrame:
    """Exporter times that are missing, over 5 minutes ahead or over 24 hours old become the receive time."""
    ts, now = F.col("timestamp"), F.col(received)
    bad = ts.isNull() | (ts > now + F.expr(FUTURE_SKEW)) | (ts < now - F.expr(PAST_SKEW))
    return flows.withColumns({"timestamp": F.when(bad, now).otherwise(ts), "clamped": bad})


def override_local_as(flows: DataFrame, local_as: int, prefixes) -> DataFrame:
    """A local address with AS 0 or a private AS belongs to the local AS."""
    if local_as <= 0 or not parse_networks(prefixes):
        return flows

    def fixed(ip16: str, asn: str) -> Column:
        wrong = (F.col(asn) == 0) | is_private(asn)
        return F.when(wrong & in_cidrs(ip16, prefixes), F.lit(local_as).cast("long")).otherwise(F.col(asn))

    return flows.withColumns({"src_as": fixed("src_ip16", "src_as"), "dst_as": fixed("dst_ip16", "dst_as")})


def normalize_addresses(flows: DataFrame) -> DataFrame:
    return flows.withColumns({"src_ip16": to_ip16("src_ip"), "dst_ip16": to_ip16("dst_ip")})


def direction_text(code) -> Column:
    """Stored code 0/1/2 -> '', 'in', 'out'."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 1, "in").when(c == 2, "out").otherwise("")


def exported_direction(code) -> Column:
    """Exporter direction field (61): 0 -> 'in', 1 -> 'out'."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 0, "in").when(c == 1, "out").otherwise("")


def match_prefixes(df: DataFrame, ip16: str, prefixes: DataFrame, out: str = "matched_prefix") -> DataFrame:
    """Longest matching prefix from a ``(prefix, net, length)`` table of any size; no match gives NULL.

    Each distinct address is masked to every length the table has (129 at most), all lengths meet the table in one equi-join on (net, length),
    and the longest hit is joined back by address. Spark broadcasts whichever side it knows to be small.
    """
    lengths = sorted(r[0] for r in prefixes.select("length").distinct().collect())
    if not lengths:
        return df.withColumn(out, F.lit(None).cast("string"))
    table = prefixes.groupBy("net", "length").agg(F.min("prefix").alias("prefix"))
    probes = df.select(ip16).filter(F.col(ip16).isNotNull()).distinct().withColumn("length", F.explode(F.array(*[F.lit(int(n)) for n in lengths])))
    hits = probes.withColumn("net", network_of(ip16, F.col("length"))).join(table, ["net", "length"])
    return df.join(hits.groupBy(ip16).agg(F.max_by("prefix", "length").alias(out)), ip16, "left")


def prefix_table(df: DataFrame, column: str) -> DataFrame:
    """CIDR texts of a column -> distinct ``(prefix, net, length)``; native parsing, bad texts dropped."""
    texts = df.select(F.col(column).alias("prefix")).filter(F.col("prefix").contains("/")).distinct()
    return networks(texts, "prefix").select("prefix", "net", "length")


def classify_query(text) -> Column:
    """What a search string names: 'as', 'ip' or 'text' with its key, as struct(kind, key)."""
    q = F.trim(F.col(text) if isinstance(text, str) else text)
    as_number = F.regexp_extract(q, "^[Aa][Ss]?([0-9]+)$", 1)
    return (
        F.when(as_number != "", F.struct(F.lit("as").alias("kind"), as_number.alias("key")))
        .when(q.rlike("^[0-9]+$"), F.struct(F.lit("as").alias("kind"), q.alias("key")))
        .when(
            q.rlike("^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}") | (q.contains(":") & ~q.contains(" ")),
            F.struct(F.lit("ip").alias("kind"), F.split(q, "/")[0].alias("key")),
        )
        .otherwise(F.struct(F.lit("text").alias("kind"), q.alias("key")))
    )
