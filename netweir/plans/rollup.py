"""Declarative rollups: role projection, partial aggregation, merge and compaction.

A rollup table holds *partial* rows that are always summed at read.  That makes
three things interchangeable inputs of every read operator: the un-aggregated
role projection (``partials``), one batch's aggregate (``build``) and any
append-only pile of such aggregates (``merge`` collapses it).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeb import bucket
from .filters import syn_only

MINUTE, FIVE_MINUTES, HOUR, DAY = 60, 300, 3600, 86400
LG_K = 12


@dataclass(frozen=True)
class Role:
    """How one flow becomes one rollup row: constant/column expressions and an optional condition."""

    columns: dict[str, str]
    condition: str | None = None


@dataclass(frozen=True)
class Rollup:
    name: str
    seconds: int
    keys: tuple[str, ...]
    roles: tuple[Role, ...]
    sums: tuple[str, ...] = ("bytes", "packets", "flow_count")
    sketches: tuple[tuple[str, str], ...] = ()  # (output column, source column)

    @property
    def group_keys(self) -> list[str]:
        return ["ts", *self.keys]


VOLUME = {
    "bytes": "bytes * sampling_rate",
    "packets": "packets * sampling_rate",
    "flow_count": "CAST(1 AS BIGINT)",
}


def _ends(column: str, src: str, dst: str, src_role: str, dst_role: str, src_if=None, dst_if=None, **more):
    def role(direction, side, cond):
        cols = {"direction": f"'{direction}'", column: side}
        cols.update({k: v[0] if side == src else v[1] for k, v in more.items()})
        return Role(cols, cond)

    return (role(src_role, src, src_if), role(dst_role, dst, dst_if))


def _as_rollup(name: str, seconds: int) -> Rollup:
    return Rollup(
        name,
        seconds,
        ("link_tag", "direction", "as_number", "ip_version"),
        _ends("as_number", "src_as", "dst_as", "out", "in", "src_as > 0", "dst_as > 0"),
    )


_LINK_SUMS = {
    "bytes_in": "IF(direction = 'in', bytes * sampling_rate, 0L)",
    "bytes_out": "IF(direction = 'out', bytes * sampling_rate, 0L)",
    "packets_in": "IF(direction = 'in', packets * sampling_rate, 0L)",
    "packets_out": "IF(direction = 'out', packets * sampling_rate, 0L)",
}


def _link_rollup(name: str, seconds: int) -> Rollup:
    return Rollup(
        name,
        seconds,
        ("link_tag", "ip_version"),
        (Role(_LINK_SUMS, "link_tag != ''"),),
        sums=(*_LINK_SUMS, "flow_count"),
    )


_TUPLE = (
    "router_ip", "link_tag", "src_ip", "dst_ip", "src_ip16", "dst_ip16", "src_as", "dst_as", "protocol",
    "src_port", "dst_port", "tcp_flags", "ip_version",
)

ROLLUPS: dict[str, Rollup] = {
    r.name: r
    for r in (
        _as_rollup("traffic_by_as", FIVE_MINUTES),
        _as_rollup("traffic_by_as_hourly", HOUR),
        _as_rollup("traffic_by_as_daily", DAY),
        Rollup(
            "traffic_by_ip",
            FIVE_MINUTES,
            ("link_tag", "direction", "ip", "ip16", "as_number"),
            _ends("ip", "src_ip", "dst_ip", "out", "in",
                  ip16=("src_ip16", "dst_ip16"), as_number=("src_as", "dst_as")),
        ),
        Rollup(
            "traffic_by_prefix",
            FIVE_MINUTES,
            ("link_tag", "direction", "prefix", "as_number"),
            _ends("prefix", "src_prefix", "dst_prefix", "out", "in", "src_prefix != ''", "dst_prefix != ''",
                  as_number=("src_as", "dst_as")),
        ),
        _link_rollup("traffic_by_link", FIVE_MINUTES),
        _link_rollup("traffic_by_link_hourly", HOUR),
        _link_rollup("traffic_by_link_daily", DAY),
        Rollup(
            "traffic_by_ip_as",
            FIVE_MINUTES,
            ("link_tag", "direction", "ip", "ip16", "as_number"),
            (
                Role({"direction": "'in'", "ip": "dst_ip", "ip16": "dst_ip16", "as_number": "src_as"}, "src_as > 0"),
                Role({"direction": "'out'", "ip": "src_ip", "ip16": "src_ip16", "as_number": "dst_as"}, "dst_as > 0"),
            ),
        ),
        Rollup("flows_log", MINUTE, _TUPLE, (Role({}),)),
        Rollup(
            "traffic_by_port",
            FIVE_MINUTES,
            ("link_tag", "direction", "protocol", "port", "ip_version"),
            _ends("port", "src_port", "dst_port", "out", "in",
                  "src_port > 0 OR protocol = 1", "dst_port > 0 OR protocol = 1"),
        ),
        Rollup(
            "traffic_by_dst_1min",
            MINUTE,
            ("dst_ip", "dst_ip16", "protocol"),
            (Role({}),),
            sums=("bytes", "packets", "flow_count", "syn_count"),
            sketches=(("unique_src_ips", "src_ip16"), ("unique_src_ports", "src_port")),
        ),
        Rollup(
            "traffic_by_src_1min",
            MINUTE,
            ("src_ip", "src_ip16", "protocol"),
            (Role({}),),
            sketches=(("unique_dst_ips", "dst_ip16"), ("unique_dst_ports", "dst_port")),
        ),
    )
}


def partials(flows: DataFrame, spec: Rollup, ts: str = "timestamp", bucketed: bool = True) -> DataFrame:
    """Role projection only: one row per flow and role, no shuffle.

    A single pass over the flows; a two-role rollup explodes an array of structs.
    """
    extra = [src for _, src in spec.sketches]
    names = [*spec.keys, *spec.sums, *extra]

    def value(role: Role, name: str) -> Column:
        if name in role.columns:
            return F.expr(role.columns[name])
        if name == "syn_count":
            return F.when(syn_only(), F.col("packets") * F.col("sampling_rate")).otherwise(F.lit(0).cast("long"))
        return F.expr(VOLUME[name]) if name in VOLUME and name in spec.sums else F.col(name)

    def projected(role: Role) -> list[Column]:
        return [value(role, n).alias(n) for n in dict.fromkeys(names)]

    start = (bucket(ts, spec.seconds) if bucketed else F.col(ts)).alias("ts")
    if len(spec.roles) == 1:
        role = spec.roles[0]
        kept = flows.filter(role.condition) if role.condition else flows
        return kept.select(start, *projected(role))
    entries = [
        F.when(F.expr(r.condition), F.struct(*projected(r))) if r.condition else F.struct(*projected(r))
        for r in spec.roles
    ]
    rows = flows.select(start, F.explode(F.array(*entries)).alias("r"))
    return rows.filter("r IS NOT NULL").select("ts", "r.*")


def build(flows: DataFrame, spec: Rollup, exact: bool = False, ts: str = "timestamp") -> DataFrame:
    """Partial aggregate of one batch of flows: one shuffle on the group key, map-side combined.

    ``exact=True`` replaces the mergeable sketches by exact distinct counts (not mergeable).
    """
    rows = partials(flows, spec, ts)
    aggs = [F.sum(c).alias(c) for c in spec.sums]
    for out, src in spec.sketches:
        aggs.append(
            F.count_distinct(src).alias(out) if exact else F.hll_sketch_agg(src, F.lit(LG_K)).alias(out)
        )
    return rows.groupBy(spec.group_keys).agg(*aggs)


def merge(partial_rows: DataFrame, spec: Rollup) -> DataFrame:
    """Collapse partial rows of the same key: counters are summed, sketches are united."""
    aggs = [F.sum(c).alias(c) for c in spec.sums]
    aggs += [F.hll_union_agg(out).alias(out) for out, _ in spec.sketches]
    return partial_rows.groupBy(spec.group_keys).agg(*aggs)


def coarsen(partial_rows: DataFrame, spec: Rollup) -> DataFrame:
    """Finer partials -> the coarser rollup ``spec`` of the same keys (5 min -> hour -> day)."""
    return merge(partial_rows.withColumn("ts", bucket("ts", spec.seconds)), spec)


def legacy_backfill(old: DataFrame, new_columns: dict[str, Column], current: DataFrame) -> DataFrame:
    """Rows written before a key column existed get a constant for it and join the current table."""
    return old.withColumns(new_columns).select(current.columns).unionByName(current)


def drop_dimension(partial_rows: DataFrame, spec: Rollup, column: str) -> DataFrame:
    """Re-aggregate one key column away."""
    keys = [k for k in spec.group_keys if k != column]
    aggs = [F.sum(c).alias(c) for c in spec.sums] + [F.hll_union_agg(o).alias(o) for o, _ in spec.sketches]
    return partial_rows.groupBy(keys).agg(*aggs)


def by_day(rows: DataFrame) -> DataFrame:
    """Rows dealt by ``dt`` for a day-partitioned write: files grow with the days and the bytes, not with days times tasks.

    Spark splits a day above the advisory partition size over several tasks and files, and packs small days into one task.
    """
    return rows.hint("rebalance", F.col("dt"))


def write_partials(rows: DataFrame, spec: Rollup, path: str, batch_id: int | None = None) -> None:
    """Append one batch, day-partitioned and sorted so row-group statistics prune.

    With a ``batch_id`` the batch owns its part of each day and a retry overwrites it (idempotent).
    """
    out = rows.withColumn("dt", F.to_date("ts"))
    lead = [c for c in ("dst_ip16", "src_ip16", "ip16", "as_number", "link_tag", "prefix", "port") if c in out.columns]
    if batch_id is None:
        out = by_day(out).sortWithinPartitions("dt", *lead[:1], "ts")
        out.write.mode("append").partitionBy("dt").parquet(path)
        return
    out = out.withColumn("batch_id", F.lit(batch_id).cast("long"))
    (
        out.sortWithinPartitions("dt", *lead[:1], "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "batch_id")
        .parquet(path)
    )


def compact(spark, spec: Rollup, path: str, out_path: str, days=None) -> None:
    """Merge an append-only table, or some of its days, into another folder.

    Written days replace the same days there and leave the others alone; the caller swaps the folders.
    """
    table = spark.read.parquet(path)
    table = table.filter(F.col("dt").isin(list(days))) if days is not None else table
    merged = merge(table, spec).withColumn("dt", F.to_date("ts"))
    lead = [c for c in ("dst_ip16", "src_ip16", "ip16", "as_number", "link_tag", "prefix", "port") if c in merged.columns]
    out = by_day(merged).sortWithinPartitions("dt", *lead[:1], "ts")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(out_path)
