"""Literal helpers shared by the column functions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)


def to_utc(value) -> _dt.datetime:
    """Python instant (aware or naive-UTC datetime, or ISO text) as aware UTC."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        return value.replace(tzinfo=_dt.timezone.utc)
    return value.astimezone(_dt.timezone.utc)


def micros(value) -> int:
    """Microseconds since the epoch of a Python instant."""
    delta = to_utc(value) - EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def ts_lit(value) -> Column:
    """A TIMESTAMP literal that does not depend on the Python process's zone."""
    if isinstance(value, Column):
        return value
    return F.timestamp_micros(F.lit(micros(value)))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rfc3339(ts: Column) -> Column:
    """Format an instant as RFC 3339 UTC text with second precision ('...Z')."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
