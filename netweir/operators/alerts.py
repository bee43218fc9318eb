"""Alert lifecycle, listings, transitions, notification routing and mitigation blocks."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.addr import ip_text, label_address
from ..functions.timeb import instant
from ..plans.filters import since
from .detect import SECTION, explain_links
from .top import top_sources

SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}
STALE_SECONDS = 300
TICK_SECONDS = 30
BLOCK_SECONDS = 3600


@dataclass
class KeyState:
    """One (rule, target): the open alert, if any, and when the cooldown last started."""

    triggered: float | None = None
    seen: float = 0.0
    metric: float = 0.0
    heartbeats: int = 0
    cooldown_from: float | None = None
    closed: list[tuple] = field(default_factory=list)

    def close(self, status: str, resolved: float | None) -> None:
        self.closed.append((self.triggered, self.seen, resolved, status, self.metric, self.heartbeats))
        self.triggered = None

    def expire(self, now: float, stale: float, tick: float) -> None:
        """The first evaluation later than last-seen + stale resolves the alert."""
        if self.triggered is not None and self.seen < now - stale:
            self.close("resolved", (self.seen + stale) // tick * tick + tick)

    def violate(self, now: float, metric: float, cooldown: float, stale: float, tick: float) -> bool:
        """A violation at ``now``; True when it opens an alert."""
        self.expire(now, stale, tick)
        if self.triggered is not None:
            self.seen, self.heartbeats = now, self.heartbeats + 1
            return False
        if self.cooldown_from is not None and now - self.cooldown_from < cooldown:
            return False
        self.triggered = self.seen = self.cooldown_from = now
        self.metric, self.heartbeats = metric, 0
        return True


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") / 1e6


def _stamp(seconds: float | None):
    return None if seconds is None else pd.Timestamp(round(seconds * 1e6), unit="us")


def _micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', {ts})")


def _instant_of(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ '1970-01-01'"))


def lifecycle(ticks: DataFrame, as_of: datetime, stale: int = STALE_SECONDS, tick: int = TICK_SECONDS) -> DataFrame:
    """Alerts from rule violations: open, heartbeat, cooldown, auto-resolve, acknowledge.

    ``ticks``: rule_id, target, tick, metric_value, cooldown_seconds and optionally ``action`` ('violation' by default, 'acknowledge' or 'resolve').

    Violations of a key without a silence longer than ``stale`` and without an action between them are an island, found with window functions. What one
    island leaves for the next is only when the last alert opened, so a fold over a key's islands finds where the cooldown lets each open: at
    its first tick that is late enough, if any.
    """
    end = int((as_of.replace(tzinfo=None) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    quiet, step = stale * 1_000_000, tick * 1_000_000
    if "action" not in ticks.columns:
        ticks = ticks.withColumn("action", F.lit("violation"))
    rows = ticks.withColumn("tick", F.col("tick").cast("timestamp_ntz")).select(
        "rule_id", "target", _micros("tick").alias("at"), F.col("metric_value").cast("double").alias("metric"),
        (F.col("cooldown_seconds").cast("double") * 1_000_000).cast("long").alias("cooldown"), "action",
    )
    w = Window.partitionBy("rule_id", "target").orderBy("at", "action")
    violation = F.col("action") == "violation"
    before, acted = F.lag("at").over(w), F.lag("action").over(w) != "violation"
    starts = violation & (before.isNull() | acted | (F.col("at") - before > quiet))
    islands = rows.withColumn("island", F.sum(starts.cast("int")).over(w)).filter("island > 0").groupBy("rule_id", "target", "island").agg(
        F.array_sort(F.collect_list(F.when(violation, F.struct("at", "metric", "cooldown")))).alias("ticks"),
        F.min(F.when(~violation, F.struct("at", "action"))).alias("act"),
    )
    keyed = islands.groupBy("rule_id", "target").agg(F.array_sort(F.collect_list(F.struct("island", "ticks", "act"))).alias("islands"))
    one = "struct<opened:bigint,seen:bigint,metric:double,heartbeats:bigint,act:struct<at:bigint,action:string>,island:int>"
    nothing = F.struct(F.lit(None).cast("long").alias("since"), F.array().cast(f"array<{one}>").alias("alerts"))

    def judge(state: Column, island: Column) -> Column:
        late = F.transform(island["ticks"], lambda t: F.coalesce(t["at"] - state["since"] >= t["cooldown"], F.lit(True)))
        first = F.array_position(late, True).cast("int")
        opening = F.get(island["ticks"], first - 1)
        alert = F.struct(
            opening["at"].alias("opened"), F.element_at(island["ticks"], -1)["at"].alias("seen"), opening["metric"].alias("metric"),
            (F.size(island["ticks"]) - first).cast("long").alias("heartbeats"), island["act"].alias("act"), island["island"].cast("int").alias("island"),
        )
        opens = first > 0
        return F.struct(
            F.when(opens, opening["at"]).otherwise(state["since"]).alias("since"),
            F.when(opens, F.concat(state["alerts"], F.array(alert))).otherwise(state["alerts"]).alias("alerts"),
        )

    alerts = keyed.select("rule_id", "target", F.size("islands").alias("last"), F.explode(F.aggregate("islands", nothing, judge)["alerts"]).alias("a")).select("rule_id", "target", "last", "a.*")
    by_hand = F.coalesce(F.col("act.at") - F.col("seen") <= quiet, F.lit(False))
    silent = (F.col("island") < F.col("last")) | F.col("act").isNotNull() | (F.col("seen") < end - quiet)
    done = F.when(by_hand & (F.col("act.action") == "resolve"), F.col("act.at")).when(~by_hand & silent, F.floor((F.col("seen") + quiet) / step) * step + step)
    status = F.when(done.isNotNull(), "resolved").when(by_hand, "acknowledged").otherwise("active")
    return alerts.select(
        "rule_id", "target", _instant_of(F.col("opened")).alias("triggered_at"), _instant_of(F.col("seen")).alias("last_seen_at"),
        _instant_of(done).alias("resolved_at"), status.alias("status"), F.col("metric").alias("metric_value"), "heartbeats",
    )


def alerts_of_events(events: DataFrame, as_of: datetime, stale: int = STALE_SECONDS, tick: int = TICK_SECONDS) -> DataFrame:
    """Alerts as of an instant, from the opened / heartbeat / resolved events of the stream: one aggregate.

    An alert that the stream has not closed yet is resolved if it has been silent for longer than ``stale``, at the evaluation that would see it.
    """
    seen = F.when(F.col("event") != "resolved", F.col("at"))
    rows = events.groupBy("rule_id", "target", "triggered_at").agg(
        F.max(seen).alias("last_seen_at"), F.max(F.when(F.col("event") == "resolved", F.col("at"))).alias("closed"),
        F.max(F.when(F.col("event") == "opened", F.col("metric_value"))).alias("metric_value"), F.count(F.when(F.col("event") == "heartbeat", 1)).alias("heartbeats"),
    )
    silent = F.unix_seconds(F.col("last_seen_at").cast("timestamp")) + stale
    end = F.timestamp_seconds(F.floor(silent / tick) * tick + tick).cast("timestamp_ntz")
    gone = F.col("last_seen_at") + F.make_dt_interval(secs=F.lit(stale)) < F.lit(as_of.replace(tzinfo=None))
    resolved = F.coalesce("closed", F.when(gone, end))
    return rows.select(
        "rule_id", "target", "triggered_at", "last_seen_at", resolved.alias("resolved_at"),
        F.when(resolved.isNotNull(), "resolved").otherwise("active").alias("status"), "metric_value", "heartbeats",
    )


def auto_resolve(alerts: DataFrame, as_of: datetime, stale: int = STALE_SECONDS) -> DataFrame:
    gone = (F.col("status") == "active") & (F.col("last_seen_at") < instant(as_of - timedelta(seconds=stale)))
    return alerts.withColumns(
        {
            "status": F.when(gone, "resolved").otherwise(F.col("status")),
            "resolved_at": F.when(gone, instant(as_of)) if "resolved_at" not in alerts.columns
            else F.when(gone, instant(as_of)).otherwise(F.col("resolved_at")),
        }
    )


def target_identity(violations: DataFrame) -> DataFrame:
    """Dedup identity of a violation: the address text, or a synthetic address for a label target."""
    label = F.col("target_kind") == "label"
    return violations.withColumn("target_id", F.when(label, ip_text(label_address("target"))).otherwise(F.col("target")))


def open_alerts(violations: DataFrame, active: DataFrame) -> DataFrame:
    """Violations without an active alert of the same rule and target."""
    return violations.join(active.filter(F.col("status") == "active"), ["rule_id", "target"], "left_anti")


def details_json(top_sources="top_sources", unique="unique_count", window="window_seconds", extra=None):
    """Details payload; empty members are left out."""
    sources = F.when(F.size(top_sources) > 0, F.col(top_sources))
    members = [
        sources.alias("top_sources"),
        F.when(F.col(unique) > 0, F.col(unique)).alias("unique_count"),
        F.when(F.col(window) > 0, F.col(window)).alias("window_seconds"),
    ]
    if extra is not None:
        members.append(F.when(F.size(extra) > 0, F.col(extra) if isinstance(extra, str) else extra).alias("extra"))
    return F.to_json(F.struct(*members))


def with_top_sources(opened: DataFrame, flows: DataFrame, as_of: datetime, n: int = 5) -> DataFrame:
    """The heaviest sources of newly opened address alerts within each alert's own window, as an ordered array.

    The flows are cut to the widest alert window before the join; that width is one number, read when the plan is built.
    """
    opened = opened.withColumn("since", instant(as_of) - F.make_dt_interval(secs=F.col("window_seconds")))
    targets = opened.filter(F.col("target_kind") == "ip").select("target", "since").distinct()
    widest = opened.agg(F.coalesce(F.max("window_seconds"), F.lit(0))).first()[0]
    best = top_sources(since(flows, as_of - timedelta(seconds=int(widest)), "timestamp"), targets, n)
    listed = best.groupBy("target", "since").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "src_ip"))), lambda s: s["src_ip"]).alias("top_sources")
    )
    none = F.expr("CAST(array() AS array<string>)")
    return opened.join(listed, ["target", "since"], "left").drop("since").withColumn("top_sources", F.coalesce("top_sources", none))


def with_explanations(opened: DataFrame, flows: DataFrame, as_dim: DataFrame, as_of: datetime, n: int = 10) -> DataFrame:
    """Newly opened anomaly alerts get what their link carried in the last complete hour as ``extra`` (a map for ``details_json``); others get NULL.

    All links are explained in one scan; a link's list has at most three times ``n`` entries.
    """
    end = as_of.replace(minute=0, second=0, microsecond=0)
    anomalous = (F.col("target_kind") == "label") & (F.col("rule_type") == "anomaly")
    tags = opened.filter(anomalous).select(F.col("target").alias("link_tag"))
    found = explain_links(flows, as_dim, tags, end - timedelta(hours=1), end, n)
    entries = F.array_sort(F.collect_list(F.struct(*SECTION, "percent")))
    listed = found.groupBy(F.col("link_tag").alias("target")).agg(F.create_map(F.lit("explanation"), entries).alias("found"))
    return opened.join(listed, "target", "left").withColumn("extra", F.when(anomalous, F.col("found"))).drop("found")


def list_alerts(alerts: DataFrame, status: str = "", limit: int = 100) -> DataFrame:
    kept = alerts.filter(F.col("status") == status) if status else alerts
    return kept.orderBy(F.desc("triggered_at"), "id").limit(limit if limit > 0 else 100)


def active_by_severity(alerts: DataFrame) -> DataFrame:
    """Counts of active alerts per severity, with the total on every row."""
    counts = alerts.filter(F.col("status") == "active").groupBy("severity").agg(F.count("*").alias("alerts"))
    # Three severities exist: the window runs over at most a handful of rows.
    return counts.withColumn("total", F.sum("alerts").over(Window.partitionBy()))


def stored(rows: DataFrame, column: str, kind: str) -> Column:
    """The column as it is, NULL where the table does not have it yet."""
    return F.col(column) if column in rows.columns else F.lit(None).cast(kind)


def transition(alerts: DataFrame, condition, status: str, at: datetime, by: str = "") -> DataFrame:
    """Acknowledge/resolve as appended events (alert id, status, time, user)."""
    return alerts.filter(condition).select("id", F.lit(status).alias("status"), instant(at).alias("at"), F.lit(by).alias("by"))


def apply_transitions(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Current state: the latest event of an alert overrides its stored status; what it does not set stays as stored."""
    last = events.groupBy("id").agg(F.max(F.struct("at", "status", "by")).alias("e"))
    acknowledged, resolved = F.col("e.status") == "acknowledged", F.col("e.status") == "resolved"
    return (
        alerts.join(last, "id", "left")
        .withColumns(
            {
                "acknowledged_by": F.when(acknowledged, F.col("e.by")).otherwise(stored(alerts, "acknowledged_by", "string")),
                "acknowledged_at": F.when(acknowledged, F.col("e.at")).otherwise(stored(alerts, "acknowledged_at", "timestamp_ntz")),
                "resolved_at": F.when(resolved, F.col("e.at")).otherwise(stored(alerts, "resolved_at", "timestamp_ntz")),
                "status": F.coalesce("e.status", "status"),
            }
        )
        .drop("e")
    )


def severity_rank(column: str):
    c = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        c = F.when(F.col(column) == name, rank).otherwise(c)
    return c


def route_notifications(alerts: DataFrame, rules: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Deliveries: alert x the rule's webhooks that are enabled and whose minimum severity is met."""
    wanted = rules.select("rule_id", F.explode("webhook_ids").alias("webhook_id"))
    hooks = webhooks.filter(F.col("enabled") == 1).select(F.col("id").alias("webhook_id"), "webhook_type", "min_severity")
    routed = alerts.join(wanted, "rule_id").join(hooks, "webhook_id")
    return routed.filter(severity_rank("severity") >= severity_rank("min_severity"))


def block_candidates(alerts: DataFrame, rules: DataFrame, blocks: DataFrame, as_of: datetime) -> DataFrame:
    """Block rows for auto-block rules: address targets that are not blocked already, for one hour; one a target, of its earliest alert.

    ``alerts`` carry rule_name, metric_value, metric_type, threshold and top_sources (an array, maybe empty).
    """
    blocking = rules.filter(F.col("action") == "auto_block").select("rule_id")
    active = blocks.filter(F.col("status") == "active").select(F.col("ip").alias("target"))
    chosen = alerts.filter((F.col("status") == "active") & (F.col("target_kind") == "ip")).join(blocking, "rule_id", "left_semi")
    new = chosen.join(active, "target", "left_anti")
    carried = ("rule_name", "metric_value", "metric_type", "threshold", "top_sources")
    first = new.groupBy("target").agg(F.min_by(F.struct("id", *carried), F.struct("triggered_at", "id")).alias("a")).select("target", "a.*")
    # Fixed value: the wording of the description.
    metric, limit = F.col("metric_value").cast("double"), F.col("threshold").cast("double")
    sources = F.when(F.size("top_sources") > 0, F.concat(F.lit(" Top sources: "), F.array_join("top_sources", ", "))).otherwise("")
    text = F.format_string("Auto-blocked by rule '%s': %.2f %s exceeded threshold %.2f.%s", "rule_name", metric, "metric_type", limit, sources)
    return first.select(
        F.col("target").alias("ip"), F.lit(32).alias("prefix_len"), F.lit("auto_block").alias("reason"), text.alias("description"), F.lit("active").alias("status"),
        F.lit("engine").alias("blocked_by"), instant(as_of).alias("blocked_at"), F.col("id").alias("alert_id"), "rule_name", metric.alias("metric_value"),
        "metric_type", limit.alias("threshold"), "top_sources", F.lit(BLOCK_SECONDS).alias("duration_seconds"),
        instant(as_of + timedelta(seconds=BLOCK_SECONDS)).alias("expires_at"),
    )


def blocks_at(blocks: DataFrame, at: datetime) -> DataFrame:
    """Blocks in force at an instant: started, not expired, not withdrawn."""
    until = F.least(F.col("expires_at"), F.col("unblocked_at"))  # least skips NULL
    return blocks.filter((F.col("blocked_at") <= instant(at)) & (instant(at) < until))


def active_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("status") == "active").orderBy(F.desc("blocked_at"), "id")


def block_history(blocks: DataFrame, limit: int = 200) -> DataFrame:
    return blocks.orderBy(F.desc("blocked_at"), "id").limit(limit)


def withdraw(blocks: DataFrame, ip: str, at: datetime, by: str, reason: str) -> DataFrame:
    hit = (F.col("ip") == ip) & (F.col("status") == "active")
    return blocks.withColumns(
        {
            "unblocked_at": F.when(hit, instant(at)).otherwise(F.col("unblocked_at")),
            "unblocked_by": F.when(hit, F.lit(by)).otherwise(stored(blocks, "unblocked_by", "string")),
            "unblock_reason": F.when(hit, F.lit(reason)).otherwise(stored(blocks, "unblock_reason", "string")),
            "status": F.when(hit, "withdrawn").otherwise(F.col("status")),
        }
    )
