"""Detection rules over the minute rollups.

All rules of a family share one scan and one shuffle: a target's volumes are
summed per distinct window with conditional sums, and every rule is then a
predicate on those sums.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.addr import in_cidrs, ip_text, network_of
from ..functions.names import protocol_name, service_name
from ..functions.timeb import instant
from ..plans.filters import in_range, since
from ..plans.sizing import config_rows, materialize
from .capacity import utilization
from .dims import with_as_info
from .scopes import scope_table, with_scopes
from .series import Tables
from .top import percent, volumes, when_sum

SMTP_PORTS = (25, 465, 587)

# Fixed values of the statistical baseline.
LOOKBACK_WEEKS = 8
MIN_SAMPLES = 4
MAD_SCALE = 1.4826
MIN_RATIO = 1.20

METRIC_TYPES = {
    "volume_in": "bps", "volume_out": "bps", "subnet_flood": "bps", "anomaly": "bps",
    "syn_flood": "pps", "icmp_flood": "pps", "udp_flood": "pps", "smtp_abuse": "pps",
    "amplification": "count", "connection_flood": "count", "port_scan": "count",
    "link_capacity": "percent",
}
DST_FAMILY = ("volume_in", "syn_flood", "amplification", "icmp_flood", "udp_flood", "connection_flood")
SRC_FAMILY = ("volume_out", "port_scan")

VIOLATION = ("rule_id", "target_kind", "target", "protocol", "metric_value", "unique_count")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    name: str = ""
    threshold_bps: int = 0
    threshold_pps: int = 0
    threshold_count: int = 0
    window_seconds: int = 60
    cooldown_seconds: int = 300
    severity: str = "warning"
    action: str = "notify"
    target_filter: str = ""
    hostgroup_id: str = ""
    subnet_prefix_len: int = 24
    enabled: bool = True
    prefixes: tuple[str, ...] = ()
    #: Name of a scope kept in a table; it takes the place of ``prefixes``.
    scope: str = ""

    @property
    def metric_type(self) -> str:
        return METRIC_TYPES[self.rule_type]

    @property
    def threshold(self) -> int:
        return {"bps": self.threshold_bps, "pps": self.threshold_pps}.get(self.metric_type, self.threshold_count)


# The seeded rule catalogue (name, type, thresholds, window, cooldown, severity, action).
DEFAULT_RULES = (
    Rule("r-01", "volume_in", "High inbound volume", threshold_bps=500_000_000),
    Rule("r-02", "volume_in", "Critical inbound volume", threshold_bps=2_000_000_000, severity="critical", action="ack_required"),
    Rule("r-03", "syn_flood", "SYN flood", threshold_pps=50_000, severity="critical", action="ack_required"),
    Rule("r-04", "connection_flood", "Connection-rate flood", threshold_count=200_000),
    Rule("r-05", "amplification", "Reflection/amplification attack", threshold_count=10_000, threshold_bps=100_000_000, severity="critical"),
    Rule("r-06", "icmp_flood", "ICMP flood", threshold_pps=20_000),
    Rule("r-07", "udp_flood", "UDP flood", threshold_pps=100_000),
    Rule("r-08", "port_scan", "Port scan from internal host", threshold_count=1_000, cooldown_seconds=600),
    Rule("r-09", "volume_out", "High outbound volume (compromised host)", threshold_bps=500_000_000),
    Rule("r-10", "volume_out", "Sustained outbound exfiltration", threshold_bps=50_000_000, window_seconds=300, cooldown_seconds=1800, severity="info"),
    Rule("r-11", "subnet_flood", "Carpet bomb /24 (warning)", threshold_bps=2_000_000_000),
    Rule("r-12", "smtp_abuse", "SMTP abuse (compromised relay)", threshold_pps=50, window_seconds=300, cooldown_seconds=1800),
    Rule("r-13", "link_capacity", "Link capacity high", threshold_count=80, window_seconds=86400, cooldown_seconds=21600),
    Rule("r-14", "anomaly", "Link throughput anomaly (example)", threshold_count=25, window_seconds=3600, cooldown_seconds=3600, severity="info", enabled=False),
    Rule("r-15", "subnet_flood", "Carpet bomb /24 (critical)", threshold_bps=5_000_000_000, severity="critical", action="ack_required"),
)


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (r.rule_id, r.name, r.rule_type, r.enabled, r.threshold_bps, r.threshold_pps, r.threshold_count, r.window_seconds,
         r.cooldown_seconds, r.severity, r.target_filter, r.hostgroup_id, r.subnet_prefix_len, r.action)
        for r in DEFAULT_RULES
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, name string, rule_type string, enabled boolean, threshold_bps long, threshold_pps long, "
        "threshold_count long, window_seconds int, cooldown_seconds int, severity string, target_filter string, "
        "hostgroup_id string, subnet_prefix_len int, action string",
    )


def resolve_scopes(rules: DataFrame, hostgroups: DataFrame, global_prefixes) -> DataFrame:
    """(rule_id, cidr): the hostgroup's list, else the rule's own filter, else the global prefixes.

    An unknown hostgroup falls back to the global list.
    """
    everyone = F.array(*[F.lit(c) for c in global_prefixes]) if global_prefixes else F.expr("CAST(array() AS array<string>)")
    groups = hostgroups.select(F.col("id").alias("hostgroup_id"), "cidrs")
    own = F.when((F.col("hostgroup_id") == "") & (F.col("target_filter") != ""), F.array("target_filter"))
    scoped = rules.join(groups, "hostgroup_id", "left").withColumn("scope", F.coalesce("cidrs", own, everyone))
    return scoped.select("rule_id", F.explode("scope").alias("cidr"))


#: A scope of more CIDRs than this stays in a table and is joined.
INLINE_CIDRS = 64


def load_rules(rules: DataFrame, hostgroups: DataFrame, global_prefixes, inline: int = INLINE_CIDRS) -> tuple[list[Rule], DataFrame | None]:
    """Config tables -> rule objects and, for the scopes of more than ``inline`` CIDRs, a scope table (else None).

    Rules become column expressions and are collected; their scopes are not, whatever their size. Rules of one list share one scope.
    """
    resolved = resolve_scopes(rules, hostgroups, global_prefixes)
    size = resolved.groupBy("rule_id").agg(F.count("*").alias("n")).filter(F.col("n") <= inline).select("rule_id")
    short = resolved.join(size, "rule_id", "left_semi").groupBy("rule_id").agg(F.array_sort(F.collect_list("cidr")).alias("cidrs"))
    short = {r["rule_id"]: tuple(r["cidrs"]) for r in short.collect()}
    groups = {r["id"] for r in hostgroups.join(rules, hostgroups["id"] == rules["hostgroup_id"], "left_semi").select("id").collect()}
    known = config_rows(rules)
    # the list of a known group, else the global list
    named = {r["rule_id"]: r["hostgroup_id"] if r["hostgroup_id"] in groups else "*" for r in known if r["rule_id"] not in short}
    fields = [f for f in Rule.__dataclass_fields__ if f not in ("prefixes", "scope")]
    loaded = [
        replace(Rule(**{f: row[f] for f in fields if f in rules.columns}), prefixes=short.get(row["rule_id"], ()), scope=named.get(row["rule_id"], ""))
        for row in known
    ]
    if not named:
        return loaded, None
    leaders = {scope: rule for rule, scope in sorted(named.items(), reverse=True)}
    cidrs = resolved.filter(F.col("rule_id").isin(list(leaders.values()))).replace({rule: scope for scope, rule in leaders.items()}, subset="rule_id")
    table = materialize(scope_table(cidrs.withColumnRenamed("rule_id", "scope")), "scopes")
    # a list without a valid entry matches every address, as a short one does
    valid = {r["scope"] for r in table.select("scope").distinct().collect()}
    return [replace(r, scope=r.scope if r.scope in valid else "") for r in loaded], table


def _in_scope(ip16: str, rule: Rule) -> Column:
    """Whether an address is in the rule's scope; for a scope in a table, rows carry their ``scopes`` (:func:`_scoped`)."""
    return F.coalesce(F.array_contains("scopes", rule.scope), F.lit(False)) if rule.scope else in_cidrs(ip16, rule.prefixes)


def _scoped(rows: DataFrame, ip16: str, rules: list[Rule], scopes: DataFrame | None) -> DataFrame:
    """Rows with the scopes of their address if a rule has its scope in a table."""
    names = sorted({r.scope for r in rules} - {""})
    if not names:
        return rows
    if scopes is None:
        raise ValueError(f"no scope table for {names[0]!r}")
    return with_scopes(rows, ip16, scopes.filter(F.col("scope").isin(names)))


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def _since(as_of: datetime, seconds: int) -> Column:
    return F.col("ts") >= instant(as_of - timedelta(seconds=seconds))


def _unique(sketch: str, raw: str, cond: Column, exact: bool) -> Column:
    """Distinct values inside a window: counted on raw partials, or estimated from a stored rollup's sketches."""
    if not exact:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(cond, F.col(sketch)))), F.lit(0).cast("long"))
    return F.count_distinct(F.when(cond, F.col(raw)))


def _violation(rule: Rule, kind: str, target, protocol, metric: Column, unique: Column, rank: Column) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(kind).alias("target_kind"), target.alias("target"),
        protocol.cast("int").alias("protocol"), metric.cast("double").alias("metric_value"),
        unique.cast("long").alias("unique_count"), rank.cast("double").alias("rank_value"),
    )


def _exceeds(pairs, either: bool = False) -> Column | None:
    """Conjunction (or disjunction) of the set thresholds; a rule with none never fires."""
    tests = [value > F.lit(limit) for value, limit in pairs if limit > 0]
    if not tests:
        return None
    out = tests[0]
    for t in tests[1:]:
        out = (out | t) if either else (out & t)
    return out


def _oldest(rows: DataFrame, rules: list[Rule], as_of: datetime, ts: str = "ts") -> DataFrame:
    """Rows of the widest window; day partitions outside it are not read."""
    return since(rows, as_of - timedelta(seconds=max(r.window_seconds for r in rules)), ts)


def _family(rows: DataFrame, side: str, rules: list[Rule], as_of: datetime, exact: bool, scopes: DataFrame | None) -> DataFrame:
    """Violations of every per-host rule on one side (dst or src)."""
    ip, ip16 = f"{side}_ip", f"{side}_ip16"
    windows = sorted({r.window_seconds for r in rules})
    uniques = {r.window_seconds for r in rules if r.rule_type in ("amplification", "port_scan")}
    sketch, raw = ("unique_src_ips", "src_ip16") if side == "dst" else ("unique_dst_ports", "dst_port")
    aggs = []
    for w in windows:
        recent, proto = _since(as_of, w), F.col("protocol")
        aggs += [
            when_sum(recent, "bytes").alias(f"bytes_{w}"), when_sum(recent, "packets").alias(f"packets_{w}"),
            when_sum(recent, "flow_count").alias(f"flows_{w}"), F.min(F.when(recent, proto)).alias(f"proto_{w}"),
        ]
        if side == "dst":
            aggs += [
                when_sum(recent & (proto == 6), "syn_count").alias(f"syn_{w}"),
                when_sum(recent & (proto == 1), "packets").alias(f"icmp_{w}"),
                when_sum(recent & (proto == 17), "packets").alias(f"udp_{w}"),
            ]
        if w in uniques:
            aggs.append(_unique(sketch, raw, recent, exact).alias(f"unique_{w}"))
    rows = _oldest(rows, rules, as_of)
    if not any(r.scope for r in rules):
        scope = F.lit(False)
        for prefixes in {r.prefixes for r in rules}:
            scope = scope | in_cidrs(ip16, prefixes)
        rows = rows.filter(scope)
    # scopes in a table join the sums, one row a host, so a flooded host is no hot key
    sums = _scoped(rows.groupBy(ip, ip16).agg(*aggs), ip16, rules, scopes)

    hits = []
    for r in rules:
        w = r.window_seconds
        col = lambda n: F.col(f"{n}_{w}")  # noqa: B023,E731
        bps, pps = col("bytes") * 8 / F.lit(w), col("packets") / F.lit(w)
        seen, zero, fixed = col("flows") > 0, F.lit(0), None
        if r.rule_type in ("volume_in", "volume_out"):
            cond, metric, unique = _exceeds([(bps, r.threshold_bps), (pps, r.threshold_pps)]), bps, zero
        elif r.rule_type == "syn_flood":
            metric, unique, fixed = col("syn") / F.lit(w), zero, 6
            cond = metric > r.threshold_pps
        elif r.rule_type in ("icmp_flood", "udp_flood"):
            name, fixed = ("icmp", 1) if r.rule_type == "icmp_flood" else ("udp", 17)
            metric, unique = _whole(col(name) / F.lit(w)), zero
            cond = metric > r.threshold_pps
        elif r.rule_type == "connection_flood":
            metric = unique = col("flows")
            cond = metric > r.threshold_count
        else:  # amplification, port_scan
            metric = unique = col("unique")
            cond = metric > r.threshold_count
            if r.rule_type == "amplification" and r.threshold_bps > 0:
                cond = cond & (bps >= r.threshold_bps)
        if cond is None:
            continue
        protocol = F.lit(fixed) if fixed else col("proto")
        hit = _violation(r, "ip", F.col(ip), protocol, metric, unique, metric)
        hits.append(F.when(seen & cond & _in_scope(ip16, r), hit))
    return _exploded(sums, hits)


def _nothing(rows: DataFrame) -> DataFrame:
    hit = _violation(Rule("", "volume_in"), "ip", F.lit(""), F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    return rows.filter(F.lit(False)).select(hit.alias("v")).select("v.*")


def _subnets(rows: DataFrame, rules: list[Rule], as_of: datetime, scopes: DataFrame | None) -> DataFrame:
    """All subnet rules in one scan and one shuffle: a row is exploded to the distinct prefix lengths, sums are per (scope, window)."""
    if bad := [r.subnet_prefix_len for r in rules if not 8 <= r.subnet_prefix_len <= 32]:
        raise ValueError(f"subnet prefix length must be 8..32, got {bad[0]}")
    rows = _oldest(rows, rules, as_of)
    if any(r.scope for r in rules):  # one row a minute and host before the scopes are joined
        rows = _scoped(rows.groupBy("ts", "dst_ip16").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")), "dst_ip16", rules, scopes)
    sums, aggs = sorted({(r.scope, r.prefixes, r.window_seconds) for r in rules}), []
    for i, (scope, prefixes, window) in enumerate(sums):
        seen = _since(as_of, window) & _in_scope("dst_ip16", Rule("", "subnet_flood", prefixes=prefixes, scope=scope))
        aggs += [when_sum(seen, "bytes").alias(f"b_{i}"), when_sum(seen, "packets").alias(f"p_{i}"), F.count_if(seen).alias(f"n_{i}")]
    lengths = F.array(*[F.lit(n) for n in sorted({r.subnet_prefix_len for r in rules})])
    nets = rows.withColumn("length", F.explode(lengths))
    nets = nets.groupBy("length", network_of("dst_ip16", F.col("length") + 96).alias("net")).agg(*aggs)
    hits = []
    for r in rules:
        i = sums.index((r.scope, r.prefixes, r.window_seconds))
        bps, pps = _whole(F.col(f"b_{i}") * 8 / r.window_seconds), _whole(F.col(f"p_{i}") / r.window_seconds)
        cond = _exceeds([(bps, r.threshold_bps), (pps, r.threshold_pps)], either=True)
        if cond is not None:
            here = (F.col("length") == r.subnet_prefix_len) & (F.col(f"n_{i}") > 0)
            hits.append(F.when(here & cond, _violation(r, "ip", ip_text("net"), F.lit(0), bps, F.lit(0), bps)))
    return _exploded(nets, hits)


def _exploded(sums: DataFrame, hits: list[Column]) -> DataFrame:
    if not hits:
        return _nothing(sums)
    return sums.select(F.explode(F.array(*hits)).alias("v")).filter("v IS NOT NULL").select("v.*")


def _smtp(flows: DataFrame, rules: list[Rule], as_of: datetime, scopes: DataFrame | None) -> DataFrame:
    """All mail-abuse rules in one scan of raw flows and one shuffle."""
    kept = _oldest(flows, rules, as_of, "timestamp").filter((F.col("protocol") == 6) & F.col("dst_port").isin(*SMTP_PORTS))
    aggs = []
    for w in sorted({r.window_seconds for r in rules}):
        recent = F.col("timestamp") >= instant(as_of - timedelta(seconds=w))
        aggs += [when_sum(recent, "packets").alias(f"p_{w}"), when_sum(recent, "flow_count").alias(f"flows_{w}")]
    sums, hits = _scoped(volumes(kept).groupBy("src_ip", "src_ip16").agg(*aggs), "src_ip16", rules, scopes), []
    for r in rules:
        pps, n = _whole(F.col(f"p_{r.window_seconds}") / r.window_seconds), F.col(f"flows_{r.window_seconds}")
        cond = _exceeds([(pps, r.threshold_pps), (n, r.threshold_count)], either=True)
        if cond is not None:
            hit = _violation(r, "ip", F.col("src_ip"), F.lit(6), pps if r.threshold_pps > 0 else n, n, pps)
            hits.append(F.when(cond & _in_scope("src_ip16", r), hit))
    return _exploded(sums, hits)


def _worst(sums: DataFrame, hits: list[Column]) -> DataFrame:
    """The worst link of each rule."""
    order = Window.partitionBy("rule_id").orderBy(F.desc("rank_value"), "target")
    return _exploded(sums, hits).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def _link_capacity(hourly: DataFrame, links: DataFrame, rules: list[Rule], as_of: datetime) -> DataFrame:
    """All capacity rules in one scan: p95 of a link's hourly rates in each distinct window against its capacity."""
    rate = ((F.sum("bytes_in") + F.sum("bytes_out")) * 8 / F.lit(3600)).alias("bps")
    hours = _oldest(hourly, rules, as_of).groupBy("link_tag", "ts").agg(rate)
    windows = sorted({r.window_seconds for r in rules})
    p95 = hours.groupBy("link_tag").agg(*[F.percentile(F.when(_since(as_of, w), F.col("bps")), F.lit(0.95)).alias(f"p95_{w}") for w in windows])
    sized = p95.join(links.select(F.col("tag").alias("link_tag"), "capacity_mbps"), "link_tag").filter(F.col("capacity_mbps") > 0)
    hits = []
    for r in rules:
        util = utilization(f"p95_{r.window_seconds}", "capacity_mbps")
        hits.append(F.when(util > r.threshold_count, _violation(r, "label", F.col("link_tag"), F.lit(0), util, F.lit(0), util)))
    return _worst(sized, hits)


def median_mad(samples: DataFrame, k: float, value: str = "bps", current: str = "is_current", key: str = "link_tag"):
    """Robust baseline per key: median + k * 1.4826 * MAD of the historical samples, and the current value."""
    past = F.when(~F.col(current), F.col(value))
    centred = samples.withColumn("med", F.median(past).over(Window.partitionBy(key)))
    stats = centred.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col(current), F.col(value))), F.lit(0.0)).alias("current"),
        F.count(past).alias("samples"),
        F.max("med").alias("med"),
        F.median(F.abs(past - F.col("med"))).alias("mad"),
    )
    return stats.withColumn("baseline", F.col("med") + F.lit(k * MAD_SCALE) * F.col("mad"))


def _deviation(samples: Column, current: Column, baseline: Column) -> tuple[Column, Column]:
    """Ratio to the baseline and whether it counts: enough history, a positive baseline, above it and by the minimum ratio."""
    ratio = F.when((samples >= MIN_SAMPLES) & (baseline > 0), current / baseline)
    return ratio, F.coalesce((current > baseline) & (ratio >= MIN_RATIO), F.lit(False))


def anomaly_decision(stats: DataFrame) -> DataFrame:
    """Adds ``deviation`` and ``fires``."""
    ratio, fires = _deviation(F.col("samples"), F.col("current"), F.col("baseline"))
    return stats.withColumns({"deviation": ratio, "fires": fires})


def link_samples(hourly: DataFrame, as_of: datetime, link: str = "") -> DataFrame:
    """Rate of the last complete hour and of the same hour of the week over the look-back, per link."""
    current = as_of.replace(minute=0, second=0, microsecond=0) - timedelta(hours=1)
    rows = since(hourly, current - timedelta(weeks=LOOKBACK_WEEKS)).filter(
        (F.col("ts") <= instant(current))
        & (F.weekday("ts") == current.weekday())
        & (F.hour("ts") == current.hour)
        & (F.col("link_tag") == link if link else F.col("link_tag") != "")
    )
    return rows.groupBy("link_tag", "ts").agg(
        ((F.sum("bytes_in") + F.sum("bytes_out")) * 8 / F.lit(3600)).alias("bps")
    ).withColumn("is_current", F.col("ts") == instant(current))


def anomalies(hourly: DataFrame, k: float, as_of: datetime, link: str = "") -> DataFrame:
    """The link that deviates most, with its baseline statistics."""
    decided = anomaly_decision(median_mad(link_samples(hourly, as_of, link), k))
    worst = decided.filter("fires").orderBy(F.desc("deviation"), "link_tag").limit(1)
    return worst.select("link_tag", "current", "baseline", "deviation", "samples", F.lit(k).alias("sensitivity_k"))


def _anomaly(hourly: DataFrame, rules: list[Rule], as_of: datetime) -> DataFrame:
    """All anomaly rules in one scan: median and MAD of a link serve every sensitivity."""
    only = {r.target_filter for r in rules}
    stats = median_mad(link_samples(hourly, as_of, only.pop() if len(only) == 1 else ""), 0.0)
    hits = []
    for r in rules:
        baseline = F.col("med") + F.lit(r.threshold_count / 10.0 * MAD_SCALE) * F.col("mad")
        ratio, fires = _deviation(F.col("samples"), F.col("current"), baseline)
        mine = (F.col("link_tag") == r.target_filter) if r.target_filter else F.lit(True)
        hits.append(F.when(mine & fires, _violation(r, "label", F.col("link_tag"), F.lit(0), F.col("current"), F.lit(0), ratio)))
    return _worst(stats, hits)


def evaluate_rules(
    rules: list[Rule], tables: Tables, links: DataFrame, as_of: datetime, max_targets: int | None = None, exact: bool = True,
    scopes: DataFrame | None = None,
) -> DataFrame:
    """Violations of all enabled rules.

    Per-host rules take one scan a side, subnet rules one, mail rules one, capacity rules one and anomaly rules one. ``max_targets`` keeps
    only that many worst targets of a rule. ``exact=False`` estimates distinct counts from the sketches of stored rollups. ``scopes`` is the scope table of
    rules that name one (:func:`load_rules`).
    """
    live = [r for r in rules if r.enabled and r.rule_type in METRIC_TYPES]
    of = lambda *types: [r for r in live if r.rule_type in types]
    parts = []
    if of(*DST_FAMILY):
        parts.append(_family(tables["traffic_by_dst_1min"], "dst", of(*DST_FAMILY), as_of, exact, scopes))
    if of(*SRC_FAMILY):
        parts.append(_family(tables["traffic_by_src_1min"], "src", of(*SRC_FAMILY), as_of, exact, scopes))
    if of("subnet_flood"):
        parts.append(_subnets(tables["traffic_by_dst_1min"], of("subnet_flood"), as_of, scopes))
    if of("smtp_abuse"):
        parts.append(_smtp(tables["flows"], of("smtp_abuse"), as_of, scopes))
    if of("link_capacity"):
        parts.append(_link_capacity(tables["traffic_by_link_hourly"], links, of("link_capacity"), as_of))
    if of("anomaly"):
        parts.append(_anomaly(tables["traffic_by_link_hourly"], of("anomaly"), as_of))
    if not parts:
        return _nothing(tables["flows"]).select(*VIOLATION)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if max_targets is not None:
        w = Window.partitionBy("rule_id").orderBy(F.desc("rank_value"), "target")
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_targets)
    return out.select(*VIOLATION)


# ---- live threats ---------------------------------------------------------------


def live_threats(rows: DataFrame, as_of: datetime, window: int = 300, limit: int = 50, prefixes=(), exact: bool = True) -> DataFrame:
    kept = since(rows, as_of - timedelta(seconds=window)).filter(in_cidrs("dst_ip16", prefixes))
    sums = kept.groupBy("dst_ip").agg(
        F.sum("bytes").alias("b"), F.sum("packets").alias("p"), F.sum("syn_count").alias("s"),
        _unique("unique_src_ips", "src_ip16", F.lit(True), exact).alias("unique_src_ips"),
    )
    rated = sums.select(
        F.col("dst_ip").alias("target"), _whole(F.col("b") * 8 / window).alias("bps"), _whole(F.col("p") / window).alias("pps"),
        _whole(F.col("s") / window).alias("syn_pps"), "unique_src_ips",
    )
    return rated.orderBy(F.desc("bps"), "target").limit(limit)


def annotate_threats(threats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Highest share of any applicable enabled threshold, the rule it belongs to and a status.

    The rule list is an array literal folded per row, so there is no cross join.
    """

    def share(r: Rule) -> Column | None:
        if r.rule_type in ("volume_in", "subnet_flood") and r.threshold_bps > 0:
            return F.col("bps") / F.lit(r.threshold_bps) * 100
        if r.rule_type == "volume_in" and r.threshold_pps > 0:
            return F.col("pps") / F.lit(r.threshold_pps) * 100
        if r.rule_type == "syn_flood" and r.threshold_pps > 0:
            return F.col("syn_pps") / F.lit(r.threshold_pps) * 100
        if r.rule_type == "amplification" and r.threshold_count > 0:
            return F.col("unique_src_ips") / F.lit(r.threshold_count) * 100
        return None

    # On equal shares the earlier rule wins, hence the negative position.
    entries = [F.struct(F.lit(0.0).alias("pct"), F.lit(1).alias("pos"), F.lit("").alias("rule"))]
    for i, r in enumerate(r for r in rules if r.enabled):
        pct = share(r)
        if pct is not None:
            entries.append(F.struct(pct.alias("pct"), F.lit(-i).alias("pos"), F.lit(r.name).alias("rule")))
    worst = threats.withColumn("w", F.array_max(F.array(*entries)))
    status = F.when(F.col("w.pct") >= 100, "critical").when(F.col("w.pct") >= 50, "warn").otherwise("ok")
    return worst.select(
        *threats.columns, F.col("w.pct").alias("worst_pct"), F.col("w.rule").alias("worst_rule"), status.alias("status")
    )


def threat_summary(annotated: DataFrame) -> DataFrame:
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return annotated.agg(is_("critical"), is_("warn"), is_("ok"))


def visible_threats(annotated: DataFrame, sort: str = "bps", ascending: bool = False, hide_ok: bool = True) -> DataFrame:
    shown = annotated.filter(F.col("status") != "ok") if hide_ok else annotated
    return shown.orderBy(F.asc(sort) if ascending else F.desc(sort), "target")


# ---- anomaly explanation ---------------------------------------------------------


SECTION = ("section", "rank", "key", "name", "bytes", "packets")


def _contributors(rows: DataFrame, as_dim: DataFrame, n: int) -> DataFrame:
    """Top source AS, source addresses and destination ports of each link: one shuffle, each flow contributes to three sections."""

    def entry(section, key, asn=None, proto=None, port=None):
        none = F.lit(None)
        return F.struct(
            F.lit(section).alias("section"), key.cast("string").alias("key"),
            (none if asn is None else asn).cast("long").alias("asn"),
            (none if proto is None else proto).cast("int").alias("proto"), (none if port is None else port).cast("int").alias("port"),
        )

    sections = F.array(
        F.when(F.col("src_as") > 0, entry("as", F.col("src_as"), asn=F.col("src_as"))),
        entry("ip", F.col("src_ip")),
        entry(
            "port", F.concat_ws("/", F.col("protocol").cast("string"), F.col("dst_port").cast("string")),
            proto=F.col("protocol"), port=F.col("dst_port"),
        ),
    )
    exploded = rows.select("link_tag", F.explode(sections).alias("e"), "bytes", "packets").filter("e IS NOT NULL")
    grouped = exploded.groupBy("link_tag", "e.section", "e.key", "e.asn", "e.proto", "e.port").agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")
    )
    w = Window.partitionBy("link_tag", "section").orderBy(F.desc("bytes"), "key")
    top = grouped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    named = with_as_info(top, as_dim, "asn")
    name = (
        F.when(F.col("section") == "as", F.col("as_name"))
        .when(F.col("section") == "port", F.concat_ws(" ", protocol_name("proto"), F.nullif(service_name("proto", "port"), F.lit(""))))
        .otherwise(F.lit(""))
    )
    return named.withColumn("name", name).select("link_tag", *SECTION)


def anomaly_explain(flows: DataFrame, as_dim: DataFrame, tag: str, start: datetime, end: datetime, n: int = 10) -> DataFrame:
    """Top source AS, source addresses and destination ports of a link with their share of its bytes."""
    rows = volumes(in_range(flows, start, end, "timestamp").filter(F.col("link_tag") == tag))
    whole = rows.agg(F.sum("bytes").alias("whole")).scalar()
    return _contributors(rows, as_dim, n).select(*SECTION, percent(F.col("bytes"), whole).alias("percent"))


def explain_links(flows: DataFrame, as_dim: DataFrame, tags: DataFrame, start: datetime, end: datetime, n: int = 10) -> DataFrame:
    """The same for every link in ``tags`` (link_tag) at once."""
    rows = volumes(in_range(flows, start, end, "timestamp")).join(tags.select("link_tag").distinct(), "link_tag", "left_semi")
    whole = rows.groupBy("link_tag").agg(F.sum("bytes").alias("whole"))
    shares = _contributors(rows, as_dim, n).join(whole, "link_tag")
    return shares.select("link_tag", *SECTION, percent(F.col("bytes"), F.col("whole")).alias("percent"))


# ---- sliding evaluation ------------------------------------------------------------


def rule_fires(sums: DataFrame, rule: Rule) -> DataFrame:
    """Rows whose sums over the rule's window (b bytes, p packets) exceed its thresholds, with the bit rate as metric."""
    bps, pps = F.col("b") * 8 / F.lit(rule.window_seconds), F.col("p") / F.lit(rule.window_seconds)
    cond = _exceeds([(bps, rule.threshold_bps), (pps, rule.threshold_pps)])
    return sums.filter(cond if cond is not None else F.lit(False)).withColumn("metric_value", bps)


def sliding_ticks(rows: DataFrame, rule: Rule, step: int = 30) -> DataFrame:
    """A ``volume_in`` rule evaluated on every tick of a grid over the whole table.

    A minute row is visible from its own start until the window leaves it, so it is first
    summed per (minute, target) and then exploded to the few ticks that see it.
    """
    w = rule.window_seconds
    minutes = rows.filter(in_cidrs("dst_ip16", rule.prefixes)).groupBy("ts", "dst_ip").agg(
        F.sum("bytes").alias("b"), F.sum("packets").alias("p")
    )
    every = F.make_dt_interval(secs=F.lit(step))
    ticks = F.sequence(F.col("ts"), F.col("ts") + F.make_dt_interval(secs=F.lit(w // step * step)), every)
    seen = minutes.select("dst_ip", "b", "p", F.explode(ticks).alias("tick")).groupBy("dst_ip", "tick").agg(
        F.sum("b").alias("b"), F.sum("p").alias("p")
    )
    fired = rule_fires(seen, rule)
    return fired.select(
        F.lit(rule.rule_id).alias("rule_id"), F.col("dst_ip").alias("target"), "tick", "metric_value",
        F.lit(rule.cooldown_seconds).alias("cooldown_seconds"),
    )
