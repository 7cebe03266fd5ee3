"""Streaming operators on small file streams (availableNow)."""

import datetime as dt
import glob
import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from folio.streaming import jobs as ST


def _write(spark, rows, schema):
    d = tempfile.mkdtemp(prefix="folio-stream-src-")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(os.path.join(d, "part"))
    return os.path.join(d, "part")


DOC_ROWS = "id string, job_id string, created_at timestamp"
RES_ROWS = "job_id string, status string, analysis string, arrived_at timestamp"


def test_enrich_stream_is_the_same_in_one_batch_or_many(spark):
    """Every awaiting document comes out once; several results per job; the
    input in one file or in five, in any order."""
    import random

    rng = random.Random(4)
    t0 = dt.datetime(2025, 1, 1)
    docs = [(f"d{i}", f"j{i}", t0 + dt.timedelta(hours=rng.randint(0, 700))) for i in range(100)]
    res, want = [], {}
    for i, (d, job, at) in enumerate(docs):
        waits = [rng.randint(0, 120) for _ in range(i % 4)]
        res += [(job, "completed", json.dumps({"k": w}), at + dt.timedelta(minutes=w)) for w in waits]
        res.append((job, "processing", "{}", at))
        good = [w for w in waits if w <= 60]
        want[d] = ("applied", min(good)) if good else ("timeout", None)
    for parts in (1, 5):
        a, b = tempfile.mkdtemp(), tempfile.mkdtemp()
        rng.shuffle(docs)
        rng.shuffle(res)
        for k in range(parts):
            spark.createDataFrame(docs[k::parts], DOC_ROWS).coalesce(1).write.mode("append").parquet(a)
            spark.createDataFrame(res[k::parts], RES_ROWS).coalesce(1).write.mode("append").parquet(b)
        one = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = ST.run_available(ST.enrich_stream(one(DOC_ROWS, a), one(RES_ROWS, b), delay="40 days"), "t-enrich")
        rows = ST.settle_enrichment(spark.read.schema(ST.ENRICHED).parquet(out), spark.read.parquet(a)).collect()
        assert len(rows) == 100 and {r.id: (r.outcome, r.elapsed_minutes) for r in rows} == want


def test_late_rows_fail_loudly(spark):
    t0 = dt.datetime(2025, 1, 1)
    path = tempfile.mkdtemp()
    for day in (90, 0):  # the second file is far behind the first
        spark.createDataFrame([(f"https://e.com/{day}", t0 + dt.timedelta(days=day))], "url string, seen_at timestamp").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    for k in range(2):  # further files move the watermark on
        spark.createDataFrame([(f"https://e.com/x{k}", t0 + dt.timedelta(days=1))], "url string, seen_at timestamp").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema("url string, seen_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(RuntimeError, match="later than the watermark"):
        ST.run_available(ST.dedupe_url_stream(stream), "t-late")


def test_feed_is_ordered_within_batches(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("r", "scraping", "s", str(i), t0 + dt.timedelta(seconds=(i * 37) % 50), i) for i in range(50)]
    schema = "request_id string, status string, stage string, message string, ts timestamp, seq long"
    path = _write(spark, rows, schema)
    out = ST.run_available(ST.status_feed(spark.readStream.schema(schema).parquet(path)), "t-feed", order=("ts", "seq"))
    got = [(r.ts, r.seq) for p in sorted(glob.glob(f"{out.removeprefix('file:')}/batch_id=0/part-*")) for r in spark.read.parquet(p).collect()]
    assert got == sorted(got) and len(got) == 50


def test_metrics_beat_fires_on_an_idle_stream(spark):
    from folio.session import scratch_path

    docs = spark.createDataFrame([("a", "url", ["x"], True, None)], "id string, source_type string, tags array<string>, seo_enabled boolean, tombstone_at timestamp")
    jobs = spark.createDataFrame([("j", "queued")], "id string, status string")
    base, called = scratch_path(spark, "t-beat"), []

    def clock():
        called.append(1)
        return dt.datetime(2025, 1, 2, tzinfo=dt.timezone.utc)

    q = ST.metrics_beat(spark, lambda: (docs, jobs), f"{base}/out", as_of=clock, every="1 second", checkpoint=f"{base}/ckpt")
    for _ in range(60):
        if len(called) >= 2:
            break
        time.sleep(1)
    q.stop()
    assert len(called) >= 2


def test_dedupe_url_stream(spark):
    t0 = dt.datetime(2025, 1, 1)
    path = _write(spark, [("https://e.com/a?utm_source=x", t0), ("https://E.COM/a/", t0 + dt.timedelta(days=1)),
                          ("https://e.com/b", t0), ("not a url", t0)], "url string, seen_at timestamp")
    stream = spark.readStream.schema("url string, seen_at timestamp").parquet(path)
    out = ST.run_available(ST.dedupe_url_stream(stream), "t-dedupe")
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 3 and sum(r.url_key is None for r in rows) == 1


def test_status_feed_latest(spark):
    t0 = dt.datetime(2025, 1, 1)
    path = _write(spark, [("r1", "scraping", "s", "m", t0, 1), ("r1", "scraped", "s", "m", t0 + dt.timedelta(seconds=1), 2),
                          ("r2", "enriching", "e", "m", t0, 3)],
                  "request_id string, status string, stage string, message string, ts timestamp, seq long")
    ev = spark.readStream.schema("request_id string, status string, stage string, message string, ts timestamp, seq long").parquet(path)
    watched = spark.createDataFrame([("r1",)], "request_id string")
    out = ST.run_available(ST.latest_status(ST.status_feed(ev, watched)), "t-status", mode="update")
    assert [(r.request_id, r.status, r.events) for r in spark.read.parquet(out).collect()] == [("r1", "scraped", 2)]


def test_live_metrics_beat(spark):
    import datetime as dt

    from folio.session import scratch_path

    t0 = dt.datetime(2025, 1, 1)
    path = _write(spark, [("j1", "queued", t0), ("j1", "processing", t0 + dt.timedelta(seconds=90)), ("j2", "queued", t0)],
                  "job_id string, event string, ts timestamp")
    ev = spark.readStream.schema("job_id string, event string, ts timestamp").parquet(path)
    docs = spark.createDataFrame(
        [("a", "url", ["x"], True, None), ("b", "text", [], False, dt.datetime(2024, 1, 1))],
        "id string, source_type string, tags array<string>, seo_enabled boolean, tombstone_at timestamp",
    )
    jobs = spark.createDataFrame([("j1", "queued"), ("j2", "failed")], "id string, status string")
    base = scratch_path(spark, "t-metrics")
    q = ST.live_metrics(ev, lambda: (docs, jobs), f"{base}/out", as_of=dt.datetime(2025, 1, 2, tzinfo=dt.timezone.utc),
                        checkpoint=f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    waits = {r.job_id: r.wait_seconds for r in spark.read.parquet(f"{base}/out/waits").collect()}
    assert waits == {"j1": 90.0, "j2": None}
    figs = {(r.metric, r.key): r.value for r in spark.read.parquet(f"{base}/out/figures").collect()}
    assert figs[("jobs_by_status", "failed")] == 1 and figs[("jobs_by_status", "pending")] == 0
    assert figs[("tombstones_due", "")] == 1 and figs[("live_by_source_type", "url")] == 1


def _cut(spark, rows, schema, parts):
    """A file stream of ``parts`` files, one per micro-batch."""
    path = tempfile.mkdtemp(prefix="folio-stream-cut-")
    for k in range(parts):
        size = -(-len(rows) // parts)
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_enrich_stream_answers_each_document_once(spark):
    """Inside the stream: one row per document in append mode, in one file or in
    several, with the closing mark for those that still wait."""
    import random

    rng = random.Random(11)
    t0 = dt.datetime(2025, 1, 1)
    docs = [(f"d{i}", f"j{i}", t0 + dt.timedelta(hours=rng.randint(0, 300))) for i in range(60)]
    res, want = [], {}
    for i, (d, job, at) in enumerate(docs):
        waits = [rng.randint(0, 120) for _ in range(i % 4)]
        res += [(job, "completed", json.dumps({"k": w}), at + dt.timedelta(minutes=w)) for w in waits]
        good = [w for w in waits if w <= 60]
        want[d] = ("applied", min(good), json.dumps({"k": min(good)})) if good else ("timeout", None, None)
    for parts in (1, 4):
        rng.shuffle(docs)
        rng.shuffle(res)
        d, close_docs = ST.closing_mark(_cut(spark, docs, DOC_ROWS, parts), "created_at", "id")
        r, close_res = ST.closing_mark(_cut(spark, res, RES_ROWS, parts), "arrived_at", "job_id", status="completed")
        out = ST.run_available(ST.enrich_once(d, r, delay="40 days"), "t-enrich-once", closing=(close_docs, close_res))
        rows = spark.read.schema(ST.ENRICHED).parquet(out).collect()
        assert len(rows) == 60 and {x.id: (x.outcome, x.elapsed_minutes, x.analysis) for x in rows} == want


def test_drops_are_counted_beyond_the_progress_that_spark_keeps(spark):
    t0 = dt.datetime(2025, 1, 1)
    days = [90, 90, 0, *range(91, 97)]  # one late row, then batches that push its report out
    rows = [(f"https://e.com/{i}", t0 + dt.timedelta(days=day)) for i, day in enumerate(days)]
    stream = _cut(spark, rows, "url string, seen_at timestamp", len(rows))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        with pytest.raises(RuntimeError, match="later than the watermark"):
            ST.run_available(ST.dedupe_url_stream(stream), "t-late-early")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


SIGHTINGS = "url string, seen_at timestamp, child boolean"


def scrapes(rows, ttl):
    """One by one: (url, day) of what is scraped."""
    last, out = {}, []
    for url, at, child in sorted(rows, key=lambda r: (r[1], not r[2])):
        if child or url not in last or at - last[url] >= ttl:
            out.append((url, at))
        if child or out and out[-1] == (url, at):
            last[url] = max(last.get(url, at), at)
    return sorted(out)


def test_scrape_stream_renews_the_ttl(spark):
    import random

    rng = random.Random(2)
    t0 = dt.datetime(2025, 1, 1)
    rows = sorted({(f"https://e.com/{rng.randint(0, 5)}", t0 + dt.timedelta(hours=rng.randint(0, 2000)), rng.random() < 0.2) for _ in range(300)}, key=lambda r: (r[1], not r[2]))
    want = scrapes(rows, dt.timedelta(days=7))
    assert 40 < len(want) < len(rows)
    for parts in (1, 4):
        out = ST.run_available(ST.scrape_stream(_cut(spark, rows, SIGHTINGS, parts), ttl="7 days", delay="90 days"), "t-scrapes")
        assert sorted((r.url, r.seen_at) for r in spark.read.parquet(out).collect()) == want
    # a renewal by a link keeps a submission cached that the first scrape alone would not
    few = [("https://e.com/a", t0, False), ("https://e.com/a", t0 + dt.timedelta(days=5), True), ("https://e.com/a", t0 + dt.timedelta(days=9), False),
           ("https://e.com/a", t0 + dt.timedelta(days=12), False), ("nonsense", t0, False), ("nonsense", t0, False)]
    out = ST.run_available(ST.scrape_stream(_cut(spark, few, SIGHTINGS, 1), ttl="7 days", delay="90 days"), "t-scrapes-few")
    got = sorted((r.url, (r.seen_at - t0).days) for r in spark.read.parquet(out).collect())
    assert got == [("https://e.com/a", 0), ("https://e.com/a", 5), ("https://e.com/a", 12), ("nonsense", 0), ("nonsense", 0)]


def test_needed_sightings_change_nothing():
    """What a task drops before the shuffle alters no decision, whatever came before."""
    import random

    rng = random.Random(6)
    for _ in range(300):
        rows = sorted(((rng.randint(0, 60), rng.random() < 0.4) for _ in range(rng.randint(1, 12))), key=lambda r: (r[0], not r[1]))
        kept = ST.needed_sightings([c for _, c in rows], [t for t, _ in rows], 10)
        other = [(rng.randint(-20, 60), rng.random() < 0.5) for _ in range(4)]

        def passed(some):
            last, out = None, []
            for t, child in sorted(some, key=lambda r: (r[0], not r[1])):
                if child:
                    last = t
                elif last is None or t - last >= 10:
                    last = t
                    out.append(t)
            return out

        assert passed([rows[i] for i in kept] + other) == passed(rows + other)


def _state_rows(spark, df, name):
    """Run, and return (output path, state rows at the end)."""
    seen = []

    class Watch(ST.StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

        def onQueryProgress(self, event):
            seen.append(sum(op.numRowsTotal for op in event.progress.stateOperators))

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        return ST.run_available(df, name, mode="update"), seen
    finally:
        spark.streams.removeListener(watch)


def test_status_state_ends(spark):
    """Documents are forgotten after their terminal event and the idle time."""
    t0 = dt.datetime(2025, 1, 1)
    schema = "request_id string, status string, stage string, message string, ts timestamp, seq long"
    rows = [(f"r{i}", s, "s", "m", t0 + dt.timedelta(hours=i, minutes=k), 10 * i + k) for i in range(20) for k, s in enumerate(["scraping", "scraped", "enriching", "enriched"])]
    rows += [("end", "enriched", "s", "m", t0 + dt.timedelta(days=60 + d), 1000 + d) for d in range(0, 60, 20)]
    out, state = _state_rows(spark, ST.latest_status_bounded(_cut(spark, rows, schema, 8), delay="1 day", idle="7 days"), "t-status-end")
    last = spark.read.parquet(out).groupBy("request_id").agg(F.max(F.struct("batch_id", "status", "events")).alias("s")).collect()
    got = {r.request_id: (r.s.status, r.s.events) for r in last}
    assert {got[f"r{i}"] for i in range(20)} == {("enriched", 4)}
    assert max(state) >= 20 and state[-1] <= 1  # at most the document of the newest event


def test_wait_state_ends(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(f"j{i}", e, t0 + dt.timedelta(hours=i, minutes=k)) for i in range(20) for k, e in enumerate(["queued", "processing", "completed"])]
    rows += [("open", "queued", t0), *[("end", e, t0 + dt.timedelta(days=60 + d)) for d, e in ((0, "queued"), (20, "processing"), (40, "completed"))]]
    rows.sort(key=lambda r: r[2])
    out, state = _state_rows(spark, ST.queue_waits_bounded(_cut(spark, rows, "job_id string, event string, ts timestamp", 8), delay="1 day", idle="7 days"), "t-wait-end")
    last = spark.read.parquet(out).groupBy("job_id").agg(F.max(F.struct("batch_id", "queued_at", "processing_at", "wait_seconds")).alias("w")).collect()
    got = {r.job_id: (r.w.queued_at, r.w.wait_seconds) for r in last}
    assert {got[f"j{i}"][1] for i in range(20)} == {60.0} and got["j3"][0] == t0 + dt.timedelta(hours=3)
    assert got["open"] == (t0, None)
    assert max(state) >= 20 and state[-1] <= 2  # the job still waiting, and the newest
