"""Incremental tag timeline (R25, R26, R35, R69 from a maintained rollup).

The rollup counts the documents that may be visible, per base hour of the
effective date, tag, and hour from which the document's tombstone is due. It is a
plain sum, so it is kept up to date by signed rows: a changed document's old
version counts -1, its new one +1, and folding adds them up. A timeline of any
width that is a multiple of the hour is then answered from the rollup, whose size
grows with hours and tags, not with documents.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.common import micros, ts_lit
from folio.functions.dates import timeline_plan
from folio.operators.timeline import on_spine, stats_of, top_tags_per_bucket

HOUR_US = 3_600_000_000
#: Columns of a rollup; tag is null in the rows that count documents.
KEY = ["hour", "on_hour", "tag", "due_hour"]


def timeline_rollup(documents: DataFrame) -> DataFrame:
    """(hour, on_hour, tag, due_hour, n): documents with seo on per hour of their
    effective date, whether it is the hour itself (a timeline's end includes that
    instant only), tag (each once per document; null counts the document), and
    the first full hour at which its tombstone is due (null: never)."""
    eff, tomb = F.unix_micros("effective_date"), F.unix_micros("tombstone_at")
    hour = F.floor(eff / F.lit(HOUR_US)).cast("long")
    due = F.ceil(tomb / F.lit(HOUR_US)).cast("long")
    live = documents.filter(F.col("seo_enabled") & F.col("effective_date").isNotNull())
    tags = F.filter(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: t.isNotNull())
    each = F.explode(F.concat(F.array(F.lit(None).cast("string")), tags)).alias("tag")
    rows = live.select(hour.alias("hour"), (eff % F.lit(HOUR_US) == 0).alias("on_hour"), due.alias("due_hour"), each)
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def rollup_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rollup rows of changed documents: their versions before (none for
    new documents) and after (none for deleted ones). Only these are read."""
    old = timeline_rollup(before).withColumn("n", -F.col("n"))
    return merge_rollups(old, timeline_rollup(after))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Sum of rollups and signed changes, in any order and grouping; keys that
    have come to nothing go."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*KEY).agg(F.sum("n").alias("n")).filter("n <> 0")


def _bucketed(rollup: DataFrame, start, end, bucket_seconds, max_buckets, as_of) -> tuple[DataFrame, int, int, int]:
    n, width_us, duration = timeline_plan(start, end, bucket_seconds, max_buckets)
    for name, value in (("start", micros(start)), ("end", micros(end)), ("as_of", micros(as_of)), ("the bucket width", width_us)):
        if value % HOUR_US:
            raise ValueError(f"{name} must fall on a full hour to be answered from the rollup")
    first, last = micros(start) // HOUR_US, micros(end) // HOUR_US
    inside = (F.col("hour") >= first) & ((F.col("hour") < last) | ((F.col("hour") == last) & F.col("on_hour")))
    live = F.col("due_hour").isNull() | (F.col("due_hour") > micros(as_of) // HOUR_US)
    bucket = F.floor((F.col("hour") - first) / F.lit(width_us // HOUR_US)).cast("long")
    return rollup.filter(inside & live).withColumn("bucket", bucket), n, width_us, duration


def _ranked(hours: DataFrame, max_tags: int) -> DataFrame:
    counts = hours.filter(F.col("tag").isNotNull()).groupBy("bucket", "tag").agg(F.sum("n").alias("doc_count"))
    return top_tags_per_bucket(counts.filter("doc_count > 0"), max_tags)


def timeline_from_rollup(
    rollup: DataFrame, start: _dt.datetime, end: _dt.datetime, *, as_of, bucket_seconds: int | None = None, max_tags: int = 20,
    max_buckets: int | None = 1000,
) -> DataFrame:
    """R35 from a rollup: the rows of ``tag_timeline`` over the documents that the
    rollup counts. Start, end, width and as_of fall on full hours (all automatic
    widths do, unless more than ``max_buckets`` were asked for)."""
    hours, n, width_us, duration = _bucketed(rollup, start, end, bucket_seconds, max_buckets, as_of)
    return on_spine(_ranked(hours, max_tags), start, n, width_us, duration, max_tags)


def stats_from_rollup(rollup: DataFrame, start: _dt.datetime, end: _dt.datetime, *, as_of, bucket_seconds: int | None = None, max_tags: int = 20) -> DataFrame:
    """R35 stats from a rollup: the row of ``timeline_stats``."""
    hours, n, _, _ = _bucketed(rollup, start, end, bucket_seconds, 1000, as_of)
    total = hours.filter(F.col("tag").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"))
    return stats_of(total, _ranked(hours, max_tags), n)
