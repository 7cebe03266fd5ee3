"""Tag timeline (R25, R26, R35, R36, R69) — the flagship aggregate.

Plan: visible ∧ in-range filter → bucket index by arithmetic (no join with a
bucket series) → explode the per-document *distinct* tags → partial/final
count per (bucket, tag) → top-k window per bucket → attach to the bucket spine.

Scale notes
* No COUNT(DISTINCT): each document sits in exactly one bucket and its tags
  are de-duplicated before the explode, so a plain count is the distinct
  count, and the aggregate combines map-side (hot tags are absorbed there).
* The window's maximum is taken after the top-k cut: the rank-1 row carries
  the bucket maximum, so the cut can run before the shuffle (WindowGroupLimit).
* The ranked rows are bounded by (n + 1) * k <= 1001 * 100, which is what
  makes broadcasting them onto the spine safe.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.common import micros, ts_lit
from folio.functions.dates import timeline_plan
from folio.functions.scores import popularity, size_factor
from folio.operators.documents import visible

MAX_TAGS_LIMIT = 100


def assign_buckets(documents: DataFrame, start, end, width_us: int) -> DataFrame:
    """Bucket index floor((eff - start) / width) for documents with
    start <= eff <= end. Index n (documents at the very end, or a partial tail)
    is kept; the caller decides whether it is listed."""
    eff = F.col("effective_date")
    in_range = documents.filter((eff >= ts_lit(start)) & (eff <= ts_lit(end)))
    offset_us = F.unix_micros(eff) - F.lit(micros(start))
    return in_range.withColumn("bucket", F.floor(offset_us / F.lit(width_us)).cast("long"))


def bucket_tag_counts(doc_buckets: DataFrame) -> DataFrame:
    """R26 + count: distinct documents per (bucket, tag)."""
    exploded = doc_buckets.select("bucket", F.explode(F.array_distinct("tags")).alias("tag"))
    return exploded.filter(F.col("tag").isNotNull()).groupBy("bucket", "tag").agg(F.count(F.lit(1)).alias("doc_count"))


def top_tags_per_bucket(counts: DataFrame, k: int = 20) -> DataFrame:
    """Rank by count desc, tag asc; keep k per bucket; popularity against
    the bucket maximum; size factor."""
    if not 1 <= k <= MAX_TAGS_LIMIT:
        raise ValueError("max_tags must be between 1 and 100")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_count").desc(), F.col("tag").asc())
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    max_count = F.max("doc_count").over(Window.partitionBy("bucket"))
    pop = popularity("doc_count", max_count)
    return ranked.withColumn("popularity_score", pop).withColumn("size_factor", size_factor("popularity_score"))


def _ranked(documents: DataFrame, start, end, bucket_seconds, max_tags, as_of, max_buckets=1000):
    n, width_us, duration = timeline_plan(start, end, bucket_seconds, max_buckets)
    docs = assign_buckets(visible(documents, as_of), start, end, width_us)
    ranked = top_tags_per_bucket(bucket_tag_counts(docs), max_tags)
    return ranked, n, width_us, duration


def tag_timeline(
    documents: DataFrame,
    start: _dt.datetime,
    end: _dt.datetime,
    *,
    as_of,
    bucket_seconds: int | None = None,
    max_tags: int = 20,
    max_buckets: int | None = 1000,
) -> DataFrame:
    """One row per (listed bucket, top tag); empty buckets appear once
    with a null tag. Buckets 0..n-1 are listed (§2.10). A request for more than
    ``max_buckets`` buckets gets wider ones; None lifts the bound."""
    ranked, n, width_us, duration = _ranked(documents, start, end, bucket_seconds, max_tags, as_of, max_buckets)
    return on_spine(ranked, start, n, width_us, duration, max_tags)


def on_spine(ranked: DataFrame, start, n: int, width_us: int, duration: int, max_tags: int) -> DataFrame:
    """The listed buckets 0..n-1 with their ranked tags."""
    spark = ranked.sparkSession
    spine = spark.range(n).select(
        F.col("id").alias("bucket"),
        F.timestamp_micros(F.lit(micros(start)) + F.col("id") * F.lit(width_us)).alias("bucket_start"),
        F.lit(duration).cast("long").alias("duration_seconds"),
    )
    listed = ranked.filter(F.col("bucket") < n).select(
        "bucket", "tag", "doc_count", "rank", "popularity_score", "size_factor"
    )
    # listed rows are at most n * max_tags: broadcast only while that is small
    bounded = n * max_tags <= 100_000
    return spine.join(F.broadcast(listed) if bounded else listed, "bucket", "left")


def timeline_stats(
    documents: DataFrame,
    start: _dt.datetime,
    end: _dt.datetime,
    *,
    as_of,
    bucket_seconds: int | None = None,
    max_tags: int = 20,
) -> DataFrame:
    """R35 stats: total visible documents in [start, end], distinct tags among
    the ranked rows (tail bucket included), and the listed bucket count."""
    ranked, n, _, _ = _ranked(documents, start, end, bucket_seconds, max_tags, as_of)
    eff = F.col("effective_date")
    total = (
        visible(documents, as_of)
        .filter((eff >= ts_lit(start)) & (eff <= ts_lit(end)))
        .agg(F.count(F.lit(1)).alias("total_documents"))
    )
    return stats_of(total, ranked, n)


def stats_of(total: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """One row of ``total`` (total_documents), the ranked rows' tags and n."""
    tags = ranked.agg(F.count_distinct("tag").alias("total_unique_tags"))
    # two single-row aggregates side by side, without a join
    null = F.lit(None).cast("long")
    both = total.select("total_documents", null.alias("total_unique_tags")).unionByName(
        tags.select(null.alias("total_documents"), "total_unique_tags")
    )
    return both.agg(
        F.max("total_documents").alias("total_documents"),
        F.max("total_unique_tags").alias("total_unique_tags"),
    ).select("total_documents", "total_unique_tags", F.lit(n).cast("long").alias("bucket_count"))


def nested_timeline(flat: DataFrame) -> DataFrame:
    """Response shape of R35: one row per bucket with its ordered tag list."""
    entry = F.struct(
        F.col("doc_count").alias("count_sort"),
        F.col("tag"),
        F.col("doc_count").alias("count"),
        F.col("popularity_score"),
        F.col("size_factor"),
    )
    grouped = flat.groupBy("bucket", "bucket_start", "duration_seconds").agg(
        F.collect_list(F.when(F.col("tag").isNotNull(), F.struct(F.col("rank"), entry.alias("e")))).alias("entries")
    )
    return grouped.select(
        "bucket",
        "bucket_start",
        "duration_seconds",
        F.transform(F.array_sort("entries"), lambda x: x["e"].dropFields("count_sort")).alias("tags"),
    ).orderBy("bucket")


def timeline_extent(documents: DataFrame, *, as_of) -> DataFrame:
    """Earliest effective date over all documents (no visibility
    filter); as_of - 30 days when there are none."""
    fallback = F.timestamp_micros(F.lit(micros(as_of) - 30 * 86_400_000_000))
    return documents.agg(F.coalesce(F.min("effective_date"), fallback).alias("earliest"))
