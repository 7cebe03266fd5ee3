"""Tag timeline (R35) on the reference's worked cases plus property checks."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators.timeline import nested_timeline, tag_timeline, timeline_extent, timeline_stats

UTC = dt.timezone.utc
BASE = dt.datetime(2025, 10, 30, 12, 0, tzinfo=UTC)
AS_OF = dt.datetime(2025, 10, 31, 0, 0, tzinfo=UTC)
SCHEMA = "id string, effective_date timestamp, tags array<string>, seo_enabled boolean, tombstone_at timestamp"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.orderBy("bucket", "rank").collect()]


def test_single_bucket(spark):
    d = docs(spark, [
        ("doc-1", BASE, ["politics", "news"], True, None),
        ("doc-2", BASE + dt.timedelta(minutes=10), ["politics", "economy"], True, None),
        ("doc-3", BASE + dt.timedelta(minutes=20), ["politics", "tech", "tech"], True, None),
    ])
    start, end = BASE - dt.timedelta(minutes=10), BASE + dt.timedelta(minutes=50)
    out = rows_of(tag_timeline(d, start, end, as_of=AS_OF, bucket_seconds=3600))
    assert [(r["tag"], r["doc_count"]) for r in out] == [("politics", 3), ("economy", 1), ("news", 1), ("tech", 1)]
    assert out[0]["popularity_score"] == 1.0 and abs(out[1]["popularity_score"] - 1 / 3) < 1e-9
    assert out[0]["size_factor"] == 2.0
    stats = timeline_stats(d, start, end, as_of=AS_OF, bucket_seconds=3600).collect()[0]
    assert (stats.total_documents, stats.total_unique_tags, stats.bucket_count) == (3, 4, 1)


def test_three_buckets_and_empty_bucket(spark):
    d = docs(spark, [
        ("m1", BASE.replace(hour=8), ["morning"], True, None),
        ("m2", BASE.replace(hour=9), ["morning"], True, None),
        ("a1", BASE.replace(hour=13), ["afternoon"], True, None),
        ("e1", BASE.replace(hour=20), ["evening"], True, None),
        ("e2", BASE.replace(hour=21), ["evening"], True, None),
        ("e3", BASE.replace(hour=22), ["evening"], True, None),
    ])
    start = BASE.replace(hour=0)
    end = start + dt.timedelta(hours=24)
    out = rows_of(tag_timeline(d, start, end, as_of=AS_OF, bucket_seconds=6 * 3600))
    got = [(r["bucket"], r["tag"], r["doc_count"]) for r in out]
    assert got == [(0, None, None), (1, "morning", 2), (2, "afternoon", 1), (3, "evening", 3)]
    nested = nested_timeline(tag_timeline(d, start, end, as_of=AS_OF, bucket_seconds=6 * 3600)).collect()
    assert [len(b.tags) for b in nested] == [0, 1, 1, 1]


def test_top_k_and_ties(spark):
    rows = []
    for i in range(10):
        for j in range(10 - i):
            rows.append((f"d{i}-{j}", BASE, [f"tag{i:02d}"], True, None))
    rows.append(("tie", BASE, ["aaa"], True, None))
    d = docs(spark, rows)
    out = rows_of(tag_timeline(d, BASE, BASE + dt.timedelta(hours=1), as_of=AS_OF, bucket_seconds=3600, max_tags=5))
    assert [r["tag"] for r in out] == ["tag00", "tag01", "tag02", "tag03", "tag04"]
    assert [r["doc_count"] for r in out] == [10, 9, 8, 7, 6]


def test_visibility(spark):
    d = docs(spark, [
        ("visible", BASE, ["a"], True, None),
        ("seo-off", BASE, ["a"], False, None),
        ("past", BASE, ["a"], True, AS_OF - dt.timedelta(hours=1)),
        ("at-as-of", BASE, ["a"], True, AS_OF),
        ("future", BASE, ["a"], True, AS_OF + dt.timedelta(days=1)),
    ])
    out = rows_of(tag_timeline(d, BASE, BASE + dt.timedelta(hours=1), as_of=AS_OF, bucket_seconds=3600))
    assert [(r["tag"], r["doc_count"]) for r in out] == [("a", 2)]


def test_tail_bucket_counts_in_stats_only(spark):
    start = BASE
    end = BASE + dt.timedelta(hours=2)
    d = docs(spark, [("x", start, ["x"], True, None), ("at-end", end, ["tail-only"], True, None)])
    out = rows_of(tag_timeline(d, start, end, as_of=AS_OF, bucket_seconds=3600))
    assert [r["tag"] for r in out] == ["x", None]
    s = timeline_stats(d, start, end, as_of=AS_OF, bucket_seconds=3600).collect()[0]
    assert (s.total_documents, s.total_unique_tags, s.bucket_count) == (2, 2, 2)


def test_bucket_cap(spark):
    d = docs(spark, [("x", BASE, ["x"], True, None)])
    s = timeline_stats(d, BASE, BASE + dt.timedelta(days=30), as_of=AS_OF, bucket_seconds=60).collect()[0]
    assert s.bucket_count == 1000


def test_extent(spark):
    d = docs(spark, [("a", BASE, ["x"], False, AS_OF), ("b", BASE - dt.timedelta(days=3), ["y"], True, None)])
    assert timeline_extent(d, as_of=AS_OF).collect()[0][0] == (BASE - dt.timedelta(days=3)).replace(tzinfo=None)
    empty = docs(spark, [])
    assert timeline_extent(empty, as_of=AS_OF).collect()[0][0] == (AS_OF - dt.timedelta(days=30)).replace(tzinfo=None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 47), st.lists(st.sampled_from("abcdef"), min_size=0, max_size=4)), max_size=40))
def test_bucket_counts_equal_direct_count(spark, items):
    rows = [(f"d{i}", BASE + dt.timedelta(hours=h), tags, True, None) for i, (h, tags) in enumerate(items)]
    d = docs(spark, rows)
    end = BASE + dt.timedelta(hours=48)
    out = tag_timeline(d, BASE, end, as_of=AS_OF, bucket_seconds=6 * 3600, max_tags=100)
    got = {(r.bucket, r.tag): r.doc_count for r in out.collect() if r.tag is not None}
    want = {}
    for h, tags in items:
        for t in set(tags):
            want[(h // 6, t)] = want.get((h // 6, t), 0) + 1
    assert got == want


def test_rollup_equals_the_timeline_after_changes(spark):
    """Any multiple of the hour, with instants on and off the hour, documents
    without tags, changed, added and deleted; changes folded in any order."""
    import random

    from folio.operators import rollup as R
    from folio.operators.timeline import tag_timeline, timeline_stats

    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "id string, effective_date timestamp, tags array<string>, seo_enabled boolean, tombstone_at timestamp"

    def version(i):
        tags = [rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 4))] if rng.random() < 0.9 else None
        tomb = t0 + dt.timedelta(minutes=rng.choice([0, 60, 90, 10_000])) if rng.random() < 0.4 else None
        eff = t0 + dt.timedelta(minutes=rng.choice([0, 60, 61, 720, 1440, 1441, 30, 2880])) if rng.random() < 0.95 else None
        return (str(i), eff, tags, rng.random() < 0.8, tomb)

    one = {i: version(i) for i in range(200)}
    two = dict(one) | {i: version(i) for i in range(150, 260)}
    for i in range(20):
        del two[i]
    changed = set(range(20)) | set(range(150, 260))
    df = lambda rows: spark.createDataFrame(list(rows), schema)
    signed = R.rollup_changes(df(one[i] for i in one if i in changed), df(two[i] for i in two if i in changed))
    rollup = R.merge_rollups(signed, R.timeline_rollup(df(one.values())))
    assert R.merge_rollups(rollup, R.timeline_rollup(df(two.values())).withColumn("n", -F.col("n"))).count() == 0
    for hours, end, now in ((1, 24, 1), (6, 24, 0), (24, 48, 2), (5, 24, 200)):
        args = dict(as_of=t0 + dt.timedelta(hours=now), bucket_seconds=hours * 3600, max_tags=2)
        span = (t0, t0 + dt.timedelta(hours=end))
        got, want = R.timeline_from_rollup(rollup, *span, **args), tag_timeline(df(two.values()), *span, **args)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert R.stats_from_rollup(rollup, *span, **args).collect() == timeline_stats(df(two.values()), *span, **args).collect()
    with pytest.raises(ValueError, match="full hour"):
        R.timeline_from_rollup(rollup, t0, t0 + dt.timedelta(hours=2), as_of=t0, bucket_seconds=1800)
