"""Time buckets (epoch aligned; the session time zone is UTC)."""

from datetime import datetime

from pyspark.sql import Column, functions as F


def bucket(ts, seconds: int) -> Column:
    """Start of the N-second bucket that holds ``ts``; keeps TIMESTAMP or TIMESTAMP_NTZ."""
    return F.window(ts, f"{seconds} seconds").getField("start")


def between(ts, start: datetime, end: datetime) -> Column:
    """Half-open ``[start, end)``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= instant(start)) & (c < instant(end))


def instant(at: datetime) -> Column:
    """Literal that compares with both TIMESTAMP and TIMESTAMP_NTZ under a UTC session."""
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def iso_weekday(ts) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(ts) + 1


def epoch_seconds(ts) -> Column:
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)
