"""Query parameters, time windows, bucket steps and source routing (driver side)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

METRIC_COLUMNS = {"bytes": "total_bytes", "packets": "total_packets", "flows": "total_flows"}

RELATIVE_SECONDS = {
    "15m": 900,
    "1h": 3600,
    "3h": 10800,
    "4h": 14400,
    "6h": 21600,
    "12h": 43200,
    "24h": 86400,
    "7d": 604800,
    "30d": 2592000,
}
_UNIT_SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}


@dataclass(frozen=True)
class QueryParams:
    """One read request.  ``start``/``end`` are explicit; no operator reads a clock."""

    start: datetime
    end: datetime
    limit: int = 20
    offset: int = 0
    direction: str = ""
    link_tags: tuple[str, ...] = ()
    ip_version: int = 0
    metric: str = "bytes"
    exclude_as: int = 0
    scope: str = ""
    local_prefixes: tuple[str, ...] = ()

    def __post_init__(self):
        if self.limit <= 0 or self.offset < 0:
            raise ValueError("limit must be positive and offset not negative")
        if self.direction not in ("in", "out"):
            object.__setattr__(self, "direction", "")
        if self.ip_version not in (4, 6):
            object.__setattr__(self, "ip_version", 0)
        object.__setattr__(self, "link_tags", tuple(self.link_tags))

    def with_(self, **kw) -> "QueryParams":
        return replace(self, **kw)

    @property
    def order_column(self) -> str:
        return order_column(self.metric)

    @property
    def seconds(self) -> float:
        return (self.end - self.start).total_seconds()

    @property
    def step(self) -> int:
        return auto_step(self.start, self.end)


@dataclass(frozen=True)
class FlowFilters:
    """Forensic search: empty string and 0 mean "any"; without a limit the whole result is returned."""

    start: datetime
    end: datetime
    src_ip: str = ""
    dst_ip: str = ""
    src_as: int = 0
    dst_as: int = 0
    protocol: int = 0
    src_port: int = 0
    dst_port: int = 0
    link_tag: str = ""
    ip_version: int = 0
    min_bytes: int = 0
    order_by: str = "bytes"
    limit: int | None = 100
    offset: int = 0

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError("end must not be before start")
        if (self.limit is not None and self.limit <= 0) or self.offset < 0:
            raise ValueError("limit must be positive and offset not negative")


def order_column(metric: str) -> str:
    return METRIC_COLUMNS.get(metric, "total_bytes")


def auto_step(start: datetime, end: datetime) -> int:
    """Bucket width in seconds for a chart over ``[start, end)``."""
    hours = (end - start).total_seconds() / 3600
    for limit_hours, step in ((3, 60), (6, 120), (36, 300), (72, 900), (168, 1800)):
        if hours <= limit_hours:
            return step
    return 3600


def route_source(entity: str, start: datetime, end: datetime) -> str:
    """Table that answers a range: raw flows, or the 5-minute, hourly or daily rollup."""
    span = end - start
    if span <= timedelta(hours=6 if entity == "ip" else 3):
        return "flows"
    base = f"traffic_by_{entity}"
    if entity not in ("as", "link") or span <= timedelta(days=90):
        return base
    return f"{base}_hourly" if span <= timedelta(days=730) else f"{base}_daily"


def prior_window(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    return start - (end - start), start


def parse_duration(text: str) -> timedelta | None:
    """``90m``, ``1h30m``, ``250ms`` ... -> timedelta, None when malformed or not positive."""
    total, number, rest = 0.0, "", text
    while rest:
        if rest[0].isdigit() or rest[0] == ".":
            number, rest = number + rest[0], rest[1:]
            continue
        unit = "ms" if rest.startswith("ms") else rest[0]
        if unit not in _UNIT_SECONDS or not number or number.count(".") > 1 or number == ".":
            return None
        total += float(number) * _UNIT_SECONDS[unit]
        number, rest = "", rest[len(unit):]
    return timedelta(seconds=total) if total > 0 and not number else None


def resolve_window(period: str, as_of: datetime) -> tuple[datetime, datetime]:
    """Named or free-form period -> literal bounds; unknown names mean the last 24 hours."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if period == "yesterday":
        return midnight - timedelta(days=1), midnight
    if period == "week":
        return midnight - timedelta(days=as_of.weekday()), as_of
    if period in RELATIVE_SECONDS:
        return as_of - timedelta(seconds=RELATIVE_SECONDS[period]), as_of
    return as_of - (parse_duration(period) or timedelta(hours=24)), as_of


def report_window(frequency: str, at: datetime) -> tuple[datetime, datetime]:
    days = {"weekly": 7, "monthly": 30}.get(frequency, 1)
    return at - timedelta(days=days), at
