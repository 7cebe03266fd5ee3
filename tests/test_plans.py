"""Plan-shape checks: the properties the design relies on at scale."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
STREAMS = {"enrich_stream", "dedupe_url_stream", "status_feed", "status_feed_events", "live_metrics", "live_metrics_figures", "ingest_read_documents", "ingest_second_batch", "crawl", "scrape_stream", "status_feed_bounded", "queue_waits_bounded"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    from folio.plans.queries import QUERIES

    for name in QUERIES:
        if name in STREAMS:
            continue
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_timeline_plan_shape(spark):
    p = plan(spark, "tag_timeline")
    # top-k applied on both sides of the exchange, partial aggregation, no distinct expansion
    assert p.count("WindowGroupLimit") == 2 and "Expand" not in p
    assert "GreaterThanOrEqual(ts," in p and "LessThanOrEqual(ts," in p  # date range reaches the scan
    c = plan(spark, "corpus_tag_timeline")
    assert "text:string" not in c  # the document text is pruned from the scan


def test_only_bounded_explicit_broadcasts(spark):
    # the timeline's only broadcast is the ranked rows (<= buckets x k)
    p = plan(spark, "tag_timeline")
    assert p.count("BroadcastExchange") == 1


def test_lookups_shuffle_only_matching_rows(spark):
    """Without automatic broadcasts an id list is a pushed filter below any exchange."""
    from folio.operators import documents as D
    from folio.sources.tables import load_table
    from pyspark.sql import functions as F

    docs = load_table(spark, SF, "documents").select(F.col("source").alias("id"), F.col("lang").alias("slug"), "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (D.get_documents(docs, ["src1"]), D.get_by_slug(docs, ["de"])):
            assert "PushedFilters: [IsNotNull" in (p := df._jdf.queryExecution().executedPlan().toString()) or "In(" in p or "EqualTo(" in p, p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_not_found_reports_do_not_shuffle_the_table(spark, tmp_path):
    """A few changes against all documents: the documents are the streamed side
    of a broadcast semi-join, and no exchange lies directly on their scan."""
    from folio.operators import jobs as J, merges as M
    from folio.sources.tables import load_table
    from pyspark.sql import functions as F

    docs = load_table(spark, SF, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("seo_enabled"))
    spark.createDataFrame([("1", False), ("none", True)], "id string, seo_enabled boolean").write.parquet(str(tmp_path / "changes"))
    changes = spark.read.parquet(str(tmp_path / "changes"))
    missing = M.set_seo(docs, changes).missing
    assert [r.id for r in missing.collect()] == ["none"]
    physical = missing._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in physical and "LeftSemi, BuildRight" in physical
    events = spark.createDataFrame([("1", "failed"), ("x", "failed"), ("x", "retry")], "job_id string, event string")
    assert [tuple(r) for r in J.unmatched_events(docs, events).collect()] == [("x", 2)]
