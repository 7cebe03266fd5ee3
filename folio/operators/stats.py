"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.visibility import is_due, is_live

# Job statuses reported, "pending" included although no job can hold it.
REPORTED_STATUSES = ("pending", "processing", "completed", "failed", "queued")


def document_stats(documents: DataFrame, *, as_of) -> DataFrame:
    """R37 as (metric, key, value) rows: live documents per source_type;
    documents with at least one tag; distinct tags; live and seo-enabled;
    tombstones due. All counts come from one pass grouped by source type, whose
    few rows are then added up; only the distinct tags need a second one."""
    spark = documents.sparkSession
    live = is_live("tombstone_at", as_of)
    per_type = documents.groupBy("source_type").agg(
        F.count_if(live).alias("live"),
        F.count_if(F.size(F.coalesce("tags", F.array())) > 0).alias("documents_with_tags"),
        F.count_if(F.col("seo_enabled") & live).alias("live_seo_enabled"),
        F.count_if(is_due("tombstone_at", as_of)).alias("tombstones_due"),
    )
    totals = ("documents_with_tags", "live_seo_enabled", "tombstones_due")
    row = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("long").alias("value"))
    parts = [row("live_by_source_type", F.col("source_type"), F.col("live")), *(row(c, F.lit(""), F.col(c)) for c in totals)]
    rows = per_type.select(F.inline(F.array(*parts))).filter("metric <> 'live_by_source_type' OR value > 0")
    zeros = spark.createDataFrame([(c, "", 0) for c in totals], "metric string, key string, value long")
    counted = rows.unionByName(zeros).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    tags = (
        documents.select(F.explode("tags").alias("tag"))
        .agg(F.count_distinct("tag").alias("value"))
        .select(F.lit("unique_tags").alias("metric"), F.lit("").alias("key"), "value")
    )
    return counted.unionByName(tags)


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    """Job count per status, zero-filled over the five reported statuses."""
    spark = jobs.sparkSession
    spine = spark.createDataFrame([(s,) for s in REPORTED_STATUSES], "status string")
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("job_count"))
    # the aggregated side has one row per distinct status value
    return spine.join(counts, "status", "left").select(
        "status", F.coalesce("job_count", F.lit(0)).cast("long").alias("job_count")
    )


def tombstone_report(log: DataFrame) -> DataFrame:
    """Tombstones created per (reason, tag) with the period distribution
    (count, min, avg, max and percentiles of days). ``log`` rows: reason, tag,
    period_days. Percentiles are exact; they count distinct periods, which are few."""
    return log.groupBy("reason", "tag").agg(
        F.count(F.lit(1)).alias("tombstones"),
        F.min("period_days").alias("min_days"),
        F.round(F.avg("period_days"), 6).alias("avg_days"),
        F.max("period_days").alias("max_days"),
        *(F.round(F.percentile("period_days", p / 100), 6).alias(f"p{p}_days") for p in (50, 90, 99)),
    )


def request_outcomes(requests: DataFrame) -> DataFrame:
    """R39 (requests): scrape requests per outcome; a cached or failed
    request is also counted as accepted, as the reference's counter does.
    ``requests`` rows carry ``outcome`` in {accepted, cached, error}."""
    counted = requests.select(
        F.explode(
            F.when(F.col("outcome").isin("cached", "error"), F.array(F.col("outcome"), F.lit("accepted"))).otherwise(
                F.array(F.col("outcome"))
            )
        ).alias("outcome")
    )
    return counted.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))
