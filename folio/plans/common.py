"""Output conventions shared by the registered queries and their oracles.

Instants leave a query as 'YYYY-MM-DD hh:mm:ss' text (UTC) and doubles are
rounded to 6 places, so results compare across engines without depending on
a client's time zone or on the last bit of a division.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.common import col
from folio.sources.fixtures import AS_OF

__all__ = ["AS_OF", "fmt_ts", "r6", "TIMELINE_START", "TIMELINE_END", "CORPUS_START", "CORPUS_END", "sql_ts"]

TIMELINE_START = _dt.datetime(2024, 1, 1, tzinfo=_dt.timezone.utc)
TIMELINE_END = _dt.datetime(2024, 1, 31, tzinfo=_dt.timezone.utc)
CORPUS_START = _dt.datetime(2023, 12, 15, tzinfo=_dt.timezone.utc)
CORPUS_END = _dt.datetime(2024, 1, 31, tzinfo=_dt.timezone.utc)


def fmt_ts(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def r6(c) -> Column:
    return F.round(col(c), 6)


def sql_ts(value: _dt.datetime) -> str:
    """DuckDB TIMESTAMP literal of a UTC instant."""
    v = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
