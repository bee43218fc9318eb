"""Top-N and entity breakdowns over rollup partials.

Every operator aggregates first and joins names on the few surviving groups;
percentages of the unlimited total come from a scalar subquery, so no group
set is ever pulled into one task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.addr import in_cidrs, in_scope, let, parse_networks, same_address, to_ip16
from ..functions.asn import asymmetry_class, asymmetry_ratio, grouped_as, grouped_as_name
from ..functions.names import protocol_name, service_name
from ..params import QueryParams, order_column
from ..plans.filters import by_links, in_range, scoped, since, top_k, without_as
from .dims import with_as_info, with_link_info

TOTALS = {"total_bytes": "bytes", "total_packets": "packets", "total_flows": "flow_count"}


def totals() -> list[Column]:
    return [F.sum(src).alias(out) for out, src in TOTALS.items()]


def when_sum(condition: Column, column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(F.when(condition, c).otherwise(F.lit(0).cast("long")))


def avg_packet() -> Column:
    return F.col("total_bytes") / F.greatest(F.col("total_packets"), F.lit(1))


def ranked(page: DataFrame, metric: str, ties: list[str]) -> DataFrame:
    """Order of a finished page (joins do not promise to keep it); a page is one small partition."""
    return page.orderBy(F.desc(metric), *ties)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def share(df: DataFrame, column: str = "total_bytes", out: str = "percent", per: str | None = None) -> DataFrame:
    """Share of the displayed total.  For an already limited result (a page of rows)."""
    w = Window.partitionBy(per) if per else Window.partitionBy()
    return df.withColumn(out, percent(F.col(column), F.sum(column).over(w)))


def whole_of(grouped: DataFrame, names=tuple(TOTALS)) -> Column:
    """Totals over all groups as a scalar subquery (struct of sums).

    It sums every column of the grouping, so its exchange is the one the ranking already
    made and is reused: the source is scanned once.
    """
    return grouped.agg(F.struct(*[F.sum(n).alias(n) for n in names]).alias("w")).scalar()


def folded(df: DataFrame, as_dim: DataFrame, key: str = "as_num") -> DataFrame:
    """AS name and country for folded AS groups; the private group gets its fixed name."""
    named = with_as_info(df, as_dim, key)
    return named.withColumn("as_name", grouped_as_name(key, "as_name"))


def top_as(rows: DataFrame, as_dim: DataFrame, p: QueryParams) -> DataFrame:
    base = without_as(scoped(rows, p), p.exclude_as)
    d = F.col("direction")
    grouped = base.groupBy(grouped_as("as_number").alias("as_num")).agg(
        *totals(), when_sum(d == "in", "bytes").alias("bytes_in"), when_sum(d == "out", "bytes").alias("bytes_out")
    )
    whole = whole_of(grouped, (*TOTALS, "bytes_in", "bytes_out"))["total_bytes"]
    page = folded(top_k(grouped, p.order_column, ["as_num"], p.limit, p.offset), as_dim)
    out = page.select(
        "as_num", "as_name", "country", "total_bytes", "total_packets", "total_flows",
        avg_packet().alias("avg_pkt_size"), "bytes_in", "bytes_out",
        asymmetry_ratio("bytes_in", "bytes_out").alias("ratio"),
        asymmetry_class("bytes_in", "bytes_out").alias("class"),
        percent(F.col("total_bytes"), whole).alias("percent"),
    )
    return ranked(out, p.order_column, ["as_num"])


def top_ip(rows: DataFrame, as_dim: DataFrame, p: QueryParams) -> DataFrame:
    base = scoped(rows, p).filter(in_scope("ip16", p.scope, p.local_prefixes))
    grouped = base.groupBy("ip", "as_number").agg(*totals())
    page = with_as_info(top_k(grouped, p.order_column, ["ip", "as_number"], p.limit, p.offset), as_dim)
    out = page.select("ip", "as_number", "as_name", *TOTALS, avg_packet().alias("avg_pkt_size"))
    return ranked(out, p.order_column, ["ip", "as_number"])


def prefix_group(prefix, p: QueryParams) -> tuple[Column, Column]:
    """(grouping key, row filter) of the prefix scope: internal folds into the first announced prefix."""
    valid = [c for c in p.local_prefixes if parse_networks([c])]
    if not valid or p.scope not in ("internal", "external"):
        return F.col(prefix), F.lit(True)
    network = to_ip16(F.split_part(F.col(prefix), F.lit("/"), F.lit(1)))
    inside = let(network, lambda n: in_cidrs(n, valid))
    if p.scope == "external":
        return F.col(prefix), ~inside

    def first_match(n: Column) -> Column:
        key = F.when(in_cidrs(n, valid[:1]), F.lit(valid[0]))
        for cidr in valid[1:]:
            key = key.when(in_cidrs(n, [cidr]), F.lit(cidr))
        return key

    return F.coalesce(let(network, first_match), F.col(prefix)), inside


def top_prefix(rows: DataFrame, as_dim: DataFrame, p: QueryParams) -> DataFrame:
    # Prefixes are summed as text first, so the address test runs once per distinct prefix.  The (always true)
    # condition on a sum keeps the test there: on the grouping column alone it would move below the aggregate.
    per_text = scoped(rows, p).groupBy("prefix", "as_number").agg(*totals())
    key, keep = prefix_group("prefix", p)
    keep = F.when(F.col("total_flows") >= 0, keep)
    grouped = (
        per_text.filter(keep)
        .groupBy(key.alias("grouped_prefix"), "as_number")
        .agg(*[F.sum(c).alias(c) for c in TOTALS])
    )
    page = with_as_info(top_k(grouped, p.order_column, ["grouped_prefix", "as_number"], p.limit, p.offset), as_dim)
    out = page.select("grouped_prefix", "as_number", "as_name", *TOTALS, avg_packet().alias("avg_pkt_size"))
    return ranked(out, p.order_column, ["grouped_prefix", "as_number"])


def country_or_unknown() -> Column:
    return F.when(F.col("country") == "", "Unknown").otherwise(F.col("country"))


def top_country(rows: DataFrame, as_dim: DataFrame, p: QueryParams) -> DataFrame:
    base = scoped(rows, p)
    sums = base.groupBy("as_number").agg(*totals())
    grouped = with_as_info(sums, as_dim).groupBy(country_or_unknown().alias("country_code")).agg(*[F.sum(c).alias(c) for c in TOTALS])
    whole = whole_of(sums)["total_bytes"]
    page = top_k(grouped, "total_bytes", ["country_code"], p.limit, p.offset)
    return page.select("country_code", *TOTALS, percent(F.col("total_bytes"), whole).alias("percent"))


def top_protocol(rows: DataFrame, p: QueryParams) -> DataFrame:
    """(protocol, direction): at most 512 groups, so the share of the returned rows is a small window."""
    grouped = scoped(rows, p).groupBy("protocol", "direction").agg(*totals())
    return share(grouped).withColumn("protocol_name", protocol_name("protocol"))


def top_port(rows: DataFrame, p: QueryParams, protocol: int = 0, limit: int = 50) -> DataFrame:
    base = scoped(rows, p).filter(F.col("port") > 0)
    base = base.filter(F.col("protocol") == protocol) if protocol > 0 else base
    grouped = base.groupBy("protocol", "port", "direction").agg(*totals())
    page = top_k(grouped, "total_bytes", ["protocol", "port", "direction"], limit if limit > 0 else 50, p.offset)
    return share(page).withColumns(
        {"protocol_name": protocol_name("protocol"), "service": service_name("protocol", "port")}
    )


def link_top_as(rows: DataFrame, as_dim: DataFrame, tag: str, p: QueryParams) -> DataFrame:
    base = scoped(rows, p.with_(link_tags=(tag,)))
    grouped = base.groupBy(grouped_as("as_number").alias("as_num")).agg(*totals())
    page = folded(top_k(grouped, "total_bytes", ["as_num"], p.limit), as_dim)
    return ranked(page.select("as_num", "as_name", *TOTALS), "total_bytes", ["as_num"])


def volumes(flows: DataFrame) -> DataFrame:
    """Sampling-corrected volume columns on raw flows."""
    return flows.withColumns(
        {
            "bytes": F.col("bytes") * F.col("sampling_rate"),
            "packets": F.col("packets") * F.col("sampling_rate"),
            "flow_count": F.lit(1).cast("long"),
        }
    )


def as_peers(flows: DataFrame, as_dim: DataFrame, asn: int, p: QueryParams) -> DataFrame:
    peers = volumes(in_range(flows, p.start, p.end, "timestamp")).filter(
        (F.col("src_as") == asn) & (F.col("dst_as") > 0) & (F.col("dst_as") != asn)
    )
    grouped = peers.groupBy(F.col("dst_as").alias("as_number")).agg(*totals())
    page = with_as_info(top_k(grouped, "total_bytes", ["as_number"], p.limit), as_dim)
    return ranked(page.select("as_number", "as_name", *TOTALS), "total_bytes", ["as_number"])


def as_top_ips(rows: DataFrame, asn: int, p: QueryParams) -> DataFrame:
    base = scoped(rows, p).filter(F.col("as_number") == asn)
    base = base.filter(in_scope("ip16", p.scope, p.local_prefixes))
    return top_k(base.groupBy("ip").agg(*totals()), "total_bytes", ["ip"], p.limit)


def as_remote_ips(flows: DataFrame, asn: int, p: QueryParams) -> DataFrame:
    rows = volumes(in_range(flows, p.start, p.end, "timestamp")).filter(F.col("src_as") == asn)
    grouped = rows.groupBy(F.col("src_ip").alias("ip")).agg(*totals())
    return top_k(grouped, "total_bytes", ["ip"], p.limit)


def ip_top_as(rows: DataFrame, as_dim: DataFrame, ip: str, p: QueryParams) -> DataFrame:
    grouped = scoped(rows, p).filter(same_address("ip16", ip)).groupBy("as_number").agg(*totals())
    page = with_as_info(top_k(grouped, "total_bytes", ["as_number"], p.limit), as_dim)
    return ranked(page.select("as_number", "as_name", *TOTALS), "total_bytes", ["as_number"])


def ip_peers(flows: DataFrame, ip: str, p: QueryParams) -> DataFrame:
    """Counterparts of an address in either role: one scan, both roles exploded."""
    rows = volumes(in_range(flows, p.start, p.end, "timestamp"))
    peer = F.explode(
        F.array(
            F.when(same_address("src_ip16", ip), F.col("dst_ip")),
            F.when(same_address("dst_ip16", ip), F.col("src_ip")),
        )
    )
    touching = rows.filter(same_address("src_ip16", ip) | same_address("dst_ip16", ip))
    sides = touching.select(peer.alias("ip"), "bytes", "packets", "flow_count").filter("ip IS NOT NULL")
    return top_k(sides.groupBy("ip").agg(*totals()), "total_bytes", ["ip"], p.limit)


def ip_info(flows: DataFrame, as_dim: DataFrame, ip: str, as_of: datetime) -> DataFrame:
    """Most frequent (AS, prefix) of an address over the last day: as source, else as destination."""
    recent = since(flows, as_of - timedelta(days=1), "timestamp")
    side = lambda rank, end: F.when(
        same_address(f"{end}_ip16", ip) & (F.col(f"{end}_as") > 0),
        F.struct(F.lit(rank).alias("rank"), F.col(f"{end}_as").alias("as_number"), F.col(f"{end}_prefix").alias("prefix")),
    )
    hits = recent.filter(same_address("src_ip16", ip) | same_address("dst_ip16", ip)).select(
        F.explode(F.array(side(0, "src"), side(1, "dst"))).alias("s")
    )
    counts = hits.filter("s IS NOT NULL").groupBy("s.rank", "s.as_number", "s.prefix").agg(F.count("*").alias("seen"))
    best = counts.orderBy("rank", F.desc("seen"), "as_number", "prefix").limit(1)
    return with_as_info(best, as_dim).select("as_number", "as_name", "prefix")


def link_list(rows: DataFrame, links: DataFrame, p: QueryParams) -> DataFrame:
    grouped = in_range(rows, p.start, p.end).groupBy("link_tag").agg(
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")
    )
    named = with_link_info(grouped, links)
    return named.orderBy(F.desc(F.col("bytes_in") + F.col("bytes_out")), "link_tag")


def overview(link_rows, as_rows, ip_rows, links, as_dim, p: QueryParams, exact: bool = True) -> dict[str, DataFrame]:
    """Dashboard bundle: scalar totals plus the top-10 lists and the link list."""
    total = in_range(link_rows, p.start, p.end).agg(
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("total_bytes_in"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("total_bytes_out"),
        F.coalesce(F.sum("flow_count"), F.lit(0)).alias("total_flows"),
    )
    count = F.count_distinct if exact else F.approx_count_distinct
    active = in_range(as_rows, p.start, p.end).agg(count("as_number").alias("n")).scalar()
    return {
        "totals": total.withColumn("active_as_count", active),
        "top_as": top_as(as_rows, as_dim, p.with_(limit=10)),
        "top_ip": top_ip(ip_rows, as_dim, p.with_(limit=10)),
        "links": link_list(link_rows, links, p),
    }


CONVERSATION_DIMENSIONS = ("src_dst_ip", "src_dst_as", "dst_port_proto")


def conversations(rows: DataFrame, dimension: str, p: QueryParams, limit: int = 50) -> DataFrame:
    """Bidirectional pairs: A<->B folded into one row with a forward (A to B) and reverse split.

    ``rows`` is the minute flow log or ``partials`` of raw flows; both carry corrected volumes.
    """
    base = by_links(in_range(rows, p.start, p.end), p.link_tags)
    if dimension == "src_dst_ip":
        ends = ("src_ip16", "dst_ip16", "src_ip", "dst_ip")
        forward = F.col("src_ip16") <= F.col("dst_ip16")
        pair = lambda a, b: (F.when(forward, F.col(a)).otherwise(F.col(b)))
        keys = {"endpoint_a": pair(ends[2], ends[3]), "endpoint_b": pair(ends[3], ends[2])}
    elif dimension == "src_dst_as":
        a, b = grouped_as("src_as"), grouped_as("dst_as")
        forward = a <= b
        keys = {"endpoint_a": F.least(a, b).cast("string"), "endpoint_b": F.greatest(a, b).cast("string")}
    elif dimension == "dst_port_proto":
        forward = F.lit(True)
        keys = {"endpoint_a": F.col("protocol").cast("string"), "endpoint_b": F.col("dst_port").cast("string")}
    else:
        raise ValueError(f"invalid conversation dimension: {dimension!r}")
    shaped = base.select(*[c.alias(n) for n, c in keys.items()], forward.alias("fwd"), "bytes", "packets", "flow_count")
    grouped = shaped.groupBy(*keys).agg(
        *totals()[:2],
        when_sum(F.col("fwd"), "bytes").alias("fwd_bytes"),
        when_sum(F.col("fwd"), "packets").alias("fwd_packets"),
        when_sum(~F.col("fwd"), "bytes").alias("rev_bytes"),
        when_sum(~F.col("fwd"), "packets").alias("rev_packets"),
        F.sum("flow_count").alias("total_flows"),
    )
    return top_k(grouped, "total_bytes", list(keys), limit)


def top_sources(flows: DataFrame, targets: DataFrame, n: int = 5, lanes: int = 64) -> DataFrame:
    """Heaviest sources of each (target, since).

    A target is joined in ``lanes`` parts, each with its own sources, so a flooded target spreads over tasks. Where the join is shuffled, the sums need no
    second exchange, as a source lies in one lane; where it is broadcast, they combine before theirs. Raw flows move once at most.
    """
    laned = volumes(flows).select("dst_ip", "src_ip", "timestamp", "bytes", F.pmod(F.xxhash64("src_ip"), F.lit(lanes)).alias("lane"))
    every = targets.withColumn("target_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    same = (F.col("dst_ip") == F.col("target")) & (F.col("lane") == F.col("target_lane"))
    joined = laned.join(every, same & (F.col("timestamp") >= F.col("since")), "inner")
    grouped = joined.groupBy("target", "target_lane", "since", "src_ip").agg(F.sum("bytes").alias("total_bytes")).drop("target_lane")
    w = Window.partitionBy("target", "since").orderBy(F.desc("total_bytes"), "src_ip")
    return grouped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dual_stack_merge(v4: DataFrame, v6: DataFrame, limit: int = 50) -> DataFrame:
    """Two per-family top lists (as_num, as_name, total_bytes) -> one list by combined bytes."""
    a = v4.select("as_num", F.col("as_name").alias("n4"), F.col("total_bytes").alias("v4_bytes"))
    b = v6.select("as_num", F.col("as_name").alias("n6"), F.col("total_bytes").alias("v6_bytes"))
    zero = F.lit(0).cast("long")
    merged = a.join(b, "as_num", "full_outer").select(
        "as_num",
        F.coalesce(F.when(F.col("n6") != "", F.col("n6")), "n4", F.lit("")).alias("as_name"),
        F.coalesce("v4_bytes", zero).alias("v4_bytes"),
        F.coalesce("v6_bytes", zero).alias("v6_bytes"),
    )
    combined = merged.withColumn("total_bytes", F.col("v4_bytes") + F.col("v6_bytes"))
    return top_k(combined, "total_bytes", ["as_num"], limit)


def protocols_by_direction(protocols: DataFrame) -> DataFrame:
    w = Window.partitionBy("direction").orderBy(F.desc("total_bytes"), "protocol")
    return protocols.withColumn("rank", F.row_number().over(w))


def display_share(page: DataFrame, metric: str) -> DataFrame:
    """Share of the displayed total of the chosen metric (bytes, packets or flows)."""
    return share(page, order_column(metric), "share")
