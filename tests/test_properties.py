"""Property checks: live/due partition the documents, filtered
results are visible documents in order, and the fixture corpus agrees with
itself across operators."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions.visibility import is_due, is_live
from folio.operators import documents as D
from folio.operators.timeline import tag_timeline, timeline_stats

UTC = dt.timezone.utc
AS_OF = dt.datetime(2024, 1, 20, tzinfo=UTC)
BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id string, effective_date timestamp, source_type string, tags array<string>, seo_enabled boolean, tombstone_at timestamp"

doc = st.tuples(
    st.integers(0, 40 * 24),  # effective_date hours after BASE
    st.sampled_from(["url", "text"]),
    st.lists(st.sampled_from(["a", "b", "news", "x-y-z", "Low-Quality"]), max_size=4),
    st.booleans(),
    st.one_of(st.none(), st.integers(0, 40 * 24)),  # tombstone hours after BASE
)


def make(spark, items):
    rows = [
        (f"d{i}", BASE + dt.timedelta(hours=h), s, t, seo, None if tb is None else BASE + dt.timedelta(hours=tb))
        for i, (h, s, t, seo, tb) in enumerate(items)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@settings(max_examples=6, deadline=None)
@given(st.lists(doc, max_size=30))
def test_live_and_due_partition(spark, items):
    df = make(spark, items)
    r = df.select(
        F.count_if(is_live("tombstone_at", AS_OF)).alias("live"),
        F.count_if(is_due("tombstone_at", AS_OF)).alias("due"),
        F.count_if(is_live("tombstone_at", AS_OF) & is_due("tombstone_at", AS_OF)).alias("both"),
        F.count(F.lit(1)).alias("n"),
    ).collect()[0]
    assert r.live + r.due == r.n and r.both == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(doc, max_size=30), st.lists(st.sampled_from(["a", "news", "x", "%-%"]), max_size=2), st.booleans())
def test_filter_is_ordered_subset_of_visible(spark, items, tags, fuzzy):
    df = make(spark, items)
    vis = {r.id for r in D.visible(df, AS_OF).collect()}
    out = D.filter_documents(df, as_of=AS_OF, tags=tags or None, fuzzy=fuzzy, limit=0).collect()
    assert {r.id for r in out} <= vis
    keys = [(-r.effective_date.timestamp(), r.id) for r in out]
    assert keys == sorted(keys)
    page = D.filter_documents(df, as_of=AS_OF, tags=tags or None, fuzzy=fuzzy, limit=3, offset=2).collect()
    assert [r.id for r in page] == [r.id for r in out][2:5]
    if out:
        last = out[min(2, len(out) - 1)]
        after = D.filter_documents(df, as_of=AS_OF, tags=tags or None, fuzzy=fuzzy, limit=0,
                                   after=(last.effective_date.replace(tzinfo=UTC), last.id)).collect()
        assert [r.id for r in after] == [r.id for r in out][min(2, len(out) - 1) + 1:]


@settings(max_examples=5, deadline=None)
@given(st.lists(doc, max_size=30).map(lambda xs: xs + [(40 * 24, "url", ["tail"], True, None)]))
def test_timeline_totals(spark, items):
    df = make(spark, items)
    start, end = dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 2, 10, tzinfo=UTC)
    flat = tag_timeline(df, start, end, as_of=AS_OF, max_tags=100).filter(F.col("tag").isNotNull())
    stats = timeline_stats(df, start, end, as_of=AS_OF, max_tags=100).collect()[0]
    visible = D.visible(df, AS_OF).filter(F.col("effective_date") <= F.lit(end.replace(tzinfo=None)))
    assert stats.total_documents == visible.count()
    # listed buckets cover [start, end) exactly (40 one-day buckets); a
    # document at end falls in the unlisted tail bucket
    listed = visible.filter(F.col("effective_date") < F.lit(end.replace(tzinfo=None)))
    pairs = listed.select(F.explode(F.array_distinct("tags")).alias("t")).count()
    assert (flat.agg(F.sum("doc_count")).collect()[0][0] or 0) == pairs
