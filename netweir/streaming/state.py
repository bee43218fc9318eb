"""Keyed state: the alert lifecycle and the template cache of an exporter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.addr import in_cidrs
from ..operators.alerts import STALE_SECONDS, TICK_SECONDS, KeyState, _seconds, _stamp
from ..operators.detect import Rule, rule_fires
from ..sources.netflow import FIELDS, TEMPLATE_KEY, TEMPLATE_TTL

IDLE_SECONDS = 3600

ALERT_EVENTS = "rule_id string, target string, event string, at timestamp_ntz, triggered_at timestamp_ntz, metric_value double"
_ALERT_STATE = "triggered double, seen double, metric double, heartbeats long, cooldown_from double"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertState(StatefulProcessor):
    """The open alert and the cooldown of one (rule, target); a timer resolves a silent alert and drops a key that has been idle for an hour."""

    def __init__(self, stale: int, tick: int):
        self.stale, self.tick = stale, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", _ALERT_STATE)

    def _load(self) -> KeyState:
        saved = self.state.get() if self.state.exists() else (None, 0.0, 0.0, 0, None)
        return KeyState(saved[0], saved[1], saved[2], int(saved[3]), saved[4])

    def _save(self, s: KeyState, watermark: float) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max(s.seen, s.cooldown_from or 0.0)
        if s.triggered is None and last + IDLE_SECONDS <= watermark:
            self.state.clear()
            return
        self.state.update((s.triggered, s.seen, s.metric, s.heartbeats, s.cooldown_from))
        wake = s.seen + self.stale if s.triggered is not None else last + IDLE_SECONDS
        self.handle.registerTimer(int(max(wake, watermark) * 1000) + 1000)

    def _resolved(self, key, s: KeyState) -> list[tuple]:
        rows = [(*key, "resolved", _stamp(end), _stamp(start), metric) for start, _, end, _, metric, _ in s.closed]
        s.closed.clear()
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        # ticks of one target in one micro-batch
        steps = sorted(row for pdf in rows for row in zip(_seconds(pdf.tick), pdf.metric_value, pdf.cooldown_seconds))
        for now, metric, cooldown in steps:
            before = s.triggered
            opened = s.violate(now, metric, cooldown, self.stale, self.tick)
            out += self._resolved(key, s)
            if opened or (before is not None and s.triggered is not None):
                out.append((*key, "opened" if opened else "heartbeat", _stamp(now), _stamp(s.triggered), float(metric)))
        self._save(s, timerValues.getCurrentWatermarkInMs() / 1000)
        yield pd.DataFrame(out, columns=_names(ALERT_EVENTS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, watermark = self._load(), timerValues.getCurrentWatermarkInMs() / 1000
        s.expire(watermark, self.stale, self.tick)
        out = self._resolved(key, s)
        self._save(s, watermark)
        yield pd.DataFrame(out, columns=_names(ALERT_EVENTS))

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def alert_events(
    ticks: DataFrame, stale: int = STALE_SECONDS, tick: int = TICK_SECONDS, lateness: str | None = "24 hours"
) -> DataFrame:
    """Stream of violations -> opened / heartbeat / resolved events, one state per (rule, target).

    Same transitions as the batch lifecycle. Without ``lateness`` the ticks keep the watermark they have, so the operator can stand behind another
    stateful one. Sets the session's state store to RocksDB, which this kind of state needs.
    """
    ticks.sparkSession.conf.set(PROVIDER, ROCKSDB)
    timed = ticks.withColumn("tick", F.col("tick").cast("timestamp"))
    timed = timed.withWatermark("tick", lateness) if lateness else timed
    shaped = timed.select(
        "rule_id", "target", "tick", F.col("metric_value").cast("double").alias("metric_value"),
        F.col("cooldown_seconds").cast("double").alias("cooldown_seconds"),
    )
    return shaped.groupBy("rule_id", "target").transformWithStateInPandas(AlertState(stale, tick), ALERT_EVENTS, "Append", "EventTime")


TEMPLATES = "templates"
_MATCHED = "router_ip string, source_id long, export_seconds long, body binary, record_length int, base_version int, positions array<int>"
_ABSENT = -1


class TemplateVersions(StatefulProcessor):
    """The templates of one (router, source, template id) by arrival; each goes as the watermark has passed its last valid second."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState(TEMPLATES, "arrival long, sequence long, set_no int", "record_length int, base_version int, positions array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = []  # data of one template in one micro-batch; its templates may come behind it
        for pdf in rows:
            arrival = pdf.received_at.astype("datetime64[us]").astype("int64").to_numpy()
            is_template = pdf.layout.notna().to_numpy()
            new = pdf[is_template]
            for at, seq, no, length, version, layout in zip(arrival[is_template], new.sequence, new.set_no, new.record_length, new.base_version, new.layout):
                self.versions.updateValue((int(at), int(seq), int(no)), (int(length), int(version), _positions(layout)))
            if not is_template.all():
                data = pdf.loc[~is_template, ["sequence", "set_no", "export_seconds", "body"]]
                waiting.append(data.assign(arrival=arrival[~is_template]))
        known = sorted(self.versions.iterator())
        if known:
            at = np.array([k for k, _ in known], np.int64)
            for data in waiting:
                found = self._matched(*key[:2], data, at, [v for _, v in known])
                if len(found):
                    yield found
            self._forget(known, timerValues)

    def _forget(self, known: list, timerValues) -> None:
        """Drops the versions that no set in time can ask for, and wakes up when the next one is due."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [(k, k[0] // 1000 + self.ttl * 1000 + 1) for k, _ in known]
        watermark = timerValues.getCurrentWatermarkInMs()
        for k, end in ends:
            if end <= watermark:
                self.versions.removeKey(k)
        if left := [end for _, end in ends if end > watermark]:
            self.handle.registerTimer(min(left))

    def _matched(self, router, source, data: pd.DataFrame, at: np.ndarray, known: list) -> pd.DataFrame:
        rows = np.concatenate((at, data[["arrival", "sequence", "set_no"]].to_numpy(np.int64)))
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        last = np.empty(len(rows), np.int64)
        last[order] = np.maximum.accumulate(np.where(order < len(at), np.arange(len(rows)), -1))
        last = last[len(at) :]
        version = np.where(last >= 0, order[last], -1)
        fresh = (version >= 0) & (data.arrival.to_numpy() - at[version, 0] <= self.ttl * 1_000_000)
        found = [known[v] for v in version[fresh]]
        return pd.DataFrame(
            {
                "router_ip": router, "source_id": source, "export_seconds": data.export_seconds[fresh], "body": data.body[fresh],
                "record_length": [v[0] for v in found], "base_version": [v[1] for v in found], "positions": [list(v[2]) for v in found],
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget(sorted(self.versions.iterator()), timerValues)
        return iter(())

    def close(self) -> None:
        pass


def _positions(layout) -> list[int]:
    """Offset and width of each flow field in their fixed order."""
    cells = layout if isinstance(layout, dict) else layout.asDict()
    return [_ABSENT if cells[f] is None else int(cells[f][part]) for f in FIELDS for part in ("o", "n")]


def match_templates_stream(sets: DataFrame, ttl: int = TEMPLATE_TTL, lateness: str = "1 hour") -> DataFrame:
    """Data sets with the layout of their template, from a stream of sets (templates and data mixed).

    The same rule as the batch match: the newest template that arrived before the data and is not older than ``ttl``. State is one map per (router, source, template id)
    in RocksDB, in which a template is one entry that is written once; an event-time timer removes it when the watermark has passed its last valid
    second, so an idle exporter leaves nothing behind. Sets later than the watermark are dropped. Sets the session's state store to RocksDB, which
    this kind of state needs.
    """
    sets.sparkSession.conf.set(PROVIDER, ROCKSDB)
    timed = sets.withWatermark("received_at", lateness)
    matched = timed.groupBy(*TEMPLATE_KEY).transformWithStateInPandas(TemplateVersions(ttl), _MATCHED, "Append", "EventTime")

    def cell(i: int):
        o, n = F.col("positions")[2 * i], F.col("positions")[2 * i + 1]
        return F.when(o != _ABSENT, F.struct(o.alias("o"), n.alias("n")))

    return matched.withColumn("layout", F.struct(*(cell(i).alias(f) for i, f in enumerate(FIELDS)))).drop("positions")


def sliding_alerts(minutes: DataFrame, rule: Rule, step: int = TICK_SECONDS, stale: int = STALE_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Alert events of a ``volume_in`` rule that is evaluated every ``step`` seconds, over a stream of minute rows: two stateful operators in one query.

    The first sums the last W seconds of each target in sliding event-time windows and emits a tick once the watermark has closed it; the second is the alert
    lifecycle. A minute is seen from its own start until the window leaves it, both ends included.
    """
    w = rule.window_seconds
    timed = minutes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    window = F.window("ts", f"{w + step} seconds", f"{step} seconds").alias("w")
    sums = timed.filter(in_cidrs("dst_ip16", rule.prefixes)).groupBy(window, "dst_ip").agg(F.sum("bytes").alias("b"), F.sum("packets").alias("p"))
    fired = rule_fires(sums, rule)
    tick = (F.col("w.end") - F.make_dt_interval(secs=F.lit(step))).alias("tick")
    ticks = fired.select(F.lit(rule.rule_id).alias("rule_id"), F.col("dst_ip").alias("target"), tick, "metric_value", F.lit(rule.cooldown_seconds).alias("cooldown_seconds"))
    return alert_events(ticks, stale, step, lateness=None)
