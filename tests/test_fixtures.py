"""The fixture derivations reproduce the figures stated in FIXTURES.md (sf0.01)."""

import os

import pytest
from pyspark.sql import functions as F

from folio.operators import crawl
from folio.plans.common import AS_OF, TIMELINE_END, TIMELINE_START
from folio.operators.timeline import tag_timeline
from folio.sources import fixtures as FX

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_job_tree_statuses(spark):
    jobs = FX.crawl_jobs(spark, SF)
    got = {r.status: r["count"] for r in jobs.groupBy("status").count().collect()}
    assert got == {"queued": 4979, "processing": 5088, "failed": 1626, "completed": 3307}
    depth = {r.depth: r["count"] for r in jobs.groupBy("depth").count().collect()}
    assert depth == {0: 10, 1: 90, 2: 900, 3: 9000, 4: 5000}


def test_timeline_bucket_zero(spark):
    out = tag_timeline(FX.timeline_documents(spark, SF), TIMELINE_START, TIMELINE_END, as_of=AS_OF, bucket_seconds=86400)
    top = [(r.tag, r.doc_count) for r in out.filter("bucket = 0").orderBy("rank").limit(3).collect()]
    assert top == [("click", 78), ("purchase", 74), ("error", 73)]


def test_corpus_tiers_and_tombstones(spark):
    texts = FX.labelled_texts(spark, SF).select(FX.text_score(F.col("quality"), F.col("toxic")).alias("s"))
    assert texts.filter("s < 0.25").count() == 51 and texts.filter("s >= 0.25 AND s < 0.35").count() == 49
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(FX.gate_score(F.col("page_id")).alias("s"))
    assert pages.filter("s < 0.25").count() == 63 and pages.filter("s >= 0.25 AND s < 0.35").count() == 25
    docs = FX.corpus_documents(spark, SF).filter(F.col("source_type") == "text")
    assert docs.filter(F.col("tombstone_at").isNotNull()).count() == 143
    assert docs.filter(F.col("tombstone_at") <= F.lit("2024-01-20 00:00:00").cast("timestamp")).count() == 84


def test_late_results_and_anchors(spark):
    res = FX.analysis_results(spark, SF).filter(F.col("status") == "completed")
    late = res.filter(F.unix_micros("arrived_at") - F.unix_micros("enqueued_at") > 60 * 60_000_000)
    assert (res.count(), late.count()) == (750, 360)
    assert crawl.page_links(spark.read.parquet(f"{SF}/pages.parquet")).count() == 1413


def test_scratch_needs_a_shared_folder_on_a_cluster():
    """Only a local session may fall back on a folder of its own."""
    import pytest

    from folio.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
