"""Effective dates and bucket widths."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.common import col

# Metadata paths searched for a publication date, in precedence order.
DATE_PATHS = (
    "$.scraper_metadata.publish_date",
    "$.scraper_metadata.published_date",
    "$.additional_metadata.publish_date",
    "$.additional_metadata.published_date",
    "$.additional_metadata.date",
)

# Accepted text layouts: RFC 3339 (fraction optional, 'T' and 'Z' upper case),
# "YYYY-MM-DD hh:mm:ss" (fraction optional, UTC) and a bare date (midnight UTC).
_STRICT_DATE = (
    r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})"
    r"|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?"
    r"|\d{4}-\d{2}-\d{2})$"
)


def parse_date_text(text) -> Column:
    """Instant of a date string in one of the accepted layouts, else null.

    A shape check runs first because Spark's cast is more lenient than the
    layouts ('2024', '2024-1' would pass); out-of-range fields give null.
    """
    t = col(text)
    return F.when(t.rlike(_STRICT_DATE), t.try_cast("timestamp"))


DATE_OBJECTS = "struct<scraper_metadata: variant, additional_metadata: variant>"


def date_objects(metadata="metadata") -> Column:
    """The two metadata objects that may hold a publication date, parsed on
    their own (the parser skips every other key without building it)."""
    return F.from_json(col(metadata), DATE_OBJECTS)


def effective_date(metadata="metadata", created_at="created_at", *, objects: Column | None = None) -> Column:
    """First metadata path holding a parseable date string, else created_at.

    Non-string JSON values never match the shape check (numbers have no
    dashes in those positions, objects start with a brace), so the JSON type
    test of the reference is implied. With ``objects`` (a materialised
    ``date_objects`` column) the metadata is parsed once instead of once per
    path.
    """
    if objects is None:
        m = col(metadata)
        candidates = [parse_date_text(F.get_json_object(m, p)) for p in DATE_PATHS]
    else:
        candidates = []
        for p in DATE_PATHS:
            obj, key = p[2:].split(".")
            candidates.append(parse_date_text(F.try_variant_get(objects[obj], f"$.{key}", "string")))
    return F.coalesce(*candidates, col(created_at))


def effective_date_strict(metadata="metadata", created_at="created_at") -> Column:
    """R04 form: the migration's SQL cast, which fails on malformed text."""
    m = col(metadata)
    return F.coalesce(*[F.get_json_object(m, p).cast("timestamp") for p in DATE_PATHS], col(created_at))


_HOUR = 3600


def bucket_width(start, end) -> int:
    """Automatic bucket width in seconds for a range."""
    span = (end - start).total_seconds()
    if span < 24 * _HOUR:
        return _HOUR
    if span < 7 * 24 * _HOUR:
        return 3 * _HOUR
    if span < 30 * 24 * _HOUR:
        return 6 * _HOUR
    if span < 90 * 24 * _HOUR:
        return 24 * _HOUR
    return 48 * _HOUR


def timeline_plan(start: _dt.datetime, end: _dt.datetime, bucket_seconds: int | None, max_buckets: int | None = 1000):
    """Bucket count and width (micros) of a timeline request (§2.10 items 1-2).

    Returns (n, width_us, duration_seconds). Width is kept exact in micros; the
    reported duration is truncated to whole seconds. More than ``max_buckets``
    buckets (1000, as in the reference; None: no bound) widen the buckets.
    """
    from folio.functions.common import micros

    if end < start:
        raise ValueError("end must not be before start")
    if bucket_seconds is None:
        bucket_seconds = bucket_width(start, end)
    width_us = int(bucket_seconds * 1_000_000)
    if width_us < 1_000_000:
        raise ValueError("bucket width must be at least one second")
    total_us = micros(end) - micros(start)
    n = total_us // width_us
    if n == 0:
        n = 1
    if max_buckets is not None and n > max_buckets:
        n = max_buckets
        width_us = total_us // max_buckets
        if width_us < 1_000_000:
            raise ValueError("bucket width must be at least one second")
    return n, width_us, width_us // 1_000_000
