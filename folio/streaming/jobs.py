"""Structured Streaming operators.

The reference's asynchronous behaviour (waiting for analysis, the URL cache
TTL, the live status feed, the metrics ticker) maps onto four streaming
queries. Event time is explicit; each operator states its delay, and rows
later than the watermark are dropped by Spark (visible in the query
progress as ``numRowsDroppedByWatermark``); ``run_available`` raises then.

Each builder returns a streaming DataFrame (or starts a query when the sink
is part of the semantics); ``run_available`` drives one to completion over
the data present now (trigger ``availableNow``), with the checkpoint and the
output in the shared checkpoint folder.
"""

from __future__ import annotations

import datetime as _dt
import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from folio.functions.common import ts_lit
from folio.functions.urls import with_url_key
from folio.operators import stats as S
from folio.session import scratch_path, ship_package


# ---------------------------------------------------------------- R70 ----
#: Id and time of the row that closes a stream: see ``closing_mark``.
END_MARK = "\u0000end"
END_TIME = _dt.datetime(2300, 1, 1, tzinfo=_dt.timezone.utc)
#: Columns of ``enrich_stream``'s output.
ENRICHED = "id string, job_id string, created_at timestamp, outcome string, elapsed_minutes long, analysis string, arrived_at timestamp"


def enrich_stream(
    documents: DataFrame,
    results: DataFrame,
    *,
    max_wait: str = "60 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Each awaiting document (id, job_id, created_at) is matched with
    its completed analysis results (job_id, status, analysis, arrived_at)
    arriving within ``max_wait`` of creation; if none arrives, a timeout row
    comes out once the watermark passes created_at + max_wait.

    Stream-stream left outer join with watermarks on both sides and a
    time-bounded condition, so the join state is bounded by the wait and the
    delay. ``delay`` must cover the disorder of the input; ``run_available``
    fails if a row came later than that. A document with several results comes
    out once per result, each as it is matched; ``enrich_once`` gives one answer
    inside the stream, ``settle_enrichment`` after it."""
    docs = documents.withWatermark("created_at", delay).select(
        F.col("id"), F.col("job_id").alias("d_job_id"), F.col("created_at")
    )
    res = (
        results.filter(F.col("status") == "completed")
        .withWatermark("arrived_at", delay)
        .select(F.col("job_id").alias("r_job_id"), "analysis", "arrived_at")
    )
    cond = (
        (F.col("d_job_id") == F.col("r_job_id"))
        & (F.col("arrived_at") >= F.col("created_at"))
        & (F.col("arrived_at") <= F.col("created_at") + F.expr(f"INTERVAL {max_wait}"))
    )
    joined = docs.join(res, cond, "leftOuter")
    matched = F.col("r_job_id").isNotNull()
    return joined.select(
        "id",
        F.col("d_job_id").alias("job_id"),
        "created_at",
        F.when(matched, F.lit("applied")).otherwise(F.lit("timeout")).alias("outcome"),
        F.when(
            matched, F.floor((F.unix_micros("arrived_at") - F.unix_micros("created_at")) / F.lit(60_000_000))
        ).cast("long").alias("elapsed_minutes"),
        "analysis",
        "arrived_at",
    )


def settle_enrichment(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """R70 at the end of the input: one row per awaiting document. The first
    result to arrive wins (ties by content); documents that the stream still
    held get their timeout. ``documents`` is the stream's document input as a
    table. The rows do not depend on how the input was cut into micro-batches."""
    best = F.min(F.struct("arrived_at", "analysis", "elapsed_minutes")).alias("r")
    applied = answers.filter("outcome = 'applied'").groupBy("id").agg(best)
    return documents.select("id", "job_id", "created_at").join(applied, "id", "left").select(
        "id", "job_id", "created_at",
        F.when(F.col("r").isNotNull(), F.lit("applied")).otherwise(F.lit("timeout")).alias("outcome"),
        "r.elapsed_minutes", "r.analysis",
    )


def enrich_once(documents: DataFrame, results: DataFrame, *, max_wait: str = "60 minutes", delay: str = "10 minutes") -> DataFrame:
    """R70 with one answer per document: the first of its completed results to
    arrive within ``max_wait`` (ties by content), or a timeout.

    Two stateful operators in one query: the join of ``enrich_stream`` and a fold
    per document of what comes out of it, which closes when the join can give
    nothing more for the document. Both are built-in operators (no Python), and
    their state is bounded by the wait and the delay. In append mode each document
    comes out exactly once, however the input is cut into micro-batches. Documents
    still waiting when the input ends come out with ``closing_mark``."""
    # by its time, not its id: a filter on the id would be pushed below the watermark
    closed = F.col("created_at").eqNullSafe(ts_lit(END_TIME))
    joined = enrich_stream(documents, results, max_wait=max_wait, delay=delay).filter(~closed)
    # the answer's instant as micros: only created_at may be the fold's event time
    answer = F.struct(F.unix_micros("arrived_at").alias("at"), "analysis", "elapsed_minutes")
    folded = joined.groupBy("id", "job_id", "created_at").agg(F.min(F.when(F.col("outcome") == "applied", answer)).alias("r"))
    return folded.select(
        "id", "job_id", "created_at", F.when(F.col("r").isNotNull(), F.lit("applied")).otherwise(F.lit("timeout")).alias("outcome"),
        "r.elapsed_minutes", "r.analysis", F.timestamp_micros("r.at").alias("arrived_at"),
    )


def closing_mark(stream: DataFrame, time_column: str, key: str, **others) -> tuple[DataFrame, Callable[[], None]]:
    """(``stream`` with a second, still empty source; a function that puts a last
    row into it). The row's time lies behind all others, so the watermark passes
    every document that still waits; its key is ``END_MARK`` and ``others`` are the
    values by which it passes the filters below the watermark (results: status
    completed). Give the functions to ``run_available`` as ``closing``: they are
    called when all other input has been read."""
    spark = stream.sparkSession
    folder = scratch_path(spark, "closing-mark")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    schema = stream.schema

    def close() -> None:
        values = {time_column: END_TIME, key: END_MARK, **others}
        spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema).write.mode("append").parquet(folder)

    return stream.unionByName(spark.readStream.schema(schema).parquet(folder)), close


# ---------------------------------------------------------------- R71 ----
def dedupe_url_stream(urls: DataFrame, *, ttl: str = "30 days", ts_col: str = "seen_at") -> DataFrame:
    """Let a URL through once per TTL, keyed by its cache key.
    First sighting wins; the state for a key expires with the watermark, which
    trails the newest sighting by the TTL. A sighting older than that fails
    ``run_available`` instead of vanishing. Invalid URLs (no key) pass through
    unchanged, as the reference does not cache them."""
    # the key is derived once per row; the split below tests the column
    keyed = with_url_key(urls, "url", "url_key")
    valid = keyed.filter(F.col("url_key").isNotNull()).withWatermark(ts_col, ttl).dropDuplicatesWithinWatermark(["url_key"])
    invalid = keyed.filter(F.col("url_key").isNull())
    return valid.unionByName(invalid)


#: What the stateful operators below read and hold; event times in micros.
_SIGHTING = "url_key string, url string, child boolean, at long, seen_at timestamp"


def _micros_of(interval: str) -> int:
    """Micros of an interval such as '30 days'."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
    number, unit = interval.split()
    return int(float(number) * units[unit.rstrip("s")] * 1_000_000)


def needed_sightings(child: list[bool], at: list[int], ttl: int) -> list[int]:
    """Which of one key's sightings (sorted by time, a scrape before a submission
    of the same instant) can matter to others: submissions that no scrape here
    covers, and scrapes without which the time covered would shrink."""
    keep: list[int] = []
    scrapes: list[int] = []
    for i, (is_child, t) in enumerate(zip(child, at)):
        if is_child:
            if len(scrapes) > 1 and t - at[scrapes[-2]] < ttl:
                scrapes.pop()
            scrapes.append(i)
        elif not scrapes or t - at[scrapes[-1]] >= ttl:
            keep.append(i)
    return sorted(keep + scrapes)


def _folded(ttl: int):
    def run(frames):
        for frame in frames:
            frame = frame.sort_values(["url_key", "at", "child"], ascending=[True, True, False], kind="stable")
            several = frame["url_key"].duplicated(keep=False).to_numpy()
            keep = (~several).nonzero()[0].tolist()
            at = several.nonzero()[0]
            for rows in frame.iloc[at].groupby("url_key", sort=False).indices.values():
                part = frame.iloc[at[rows]]
                keep += [at[rows[i]] for i in needed_sightings(part["child"].tolist(), part["at"].tolist(), ttl)]
            yield frame.iloc[sorted(keep)]

    return run


def _renewing(ttl: int):
    """Per key: the latest scrape's time is the state. It times out, and goes, when
    the watermark has passed that time by the TTL."""

    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        if len(rows) > 1:
            rows = rows.sort_values(["at", "child", "url"], ascending=[True, False, True], kind="stable")
        passed = []
        for i, (child, at) in enumerate(zip(rows["child"].tolist(), rows["at"].tolist())):
            if child:
                last = at if last is None else max(last, at)
            elif last is None or at - last >= ttl:
                last = at
                passed.append(i)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[passed][["url_key", "url", "child", "seen_at"]]

    return run


def scrape_stream(urls: DataFrame, *, ttl: str = "30 days", delay: str = "1 day", ts_col: str = "seen_at", child_col: str = "child") -> DataFrame:
    """R71 with the TTL that the cache keeps: it runs from a URL's latest scrape.
    ``urls`` (url, ``ts_col``, ``child_col``) are submissions and, with the child
    column true, links found on scraped pages. A submission whose cache key (R52)
    was scraped less than ``ttl`` before is cached and does not come out; else it
    is scraped, which sets the key anew. Links are scraped without a look at the
    cache, and set the key too. Output: url_key, url, child, ``ts_col`` of every
    scrape. URLs without a key pass, as they are not cached.

    State per key is the time of its latest scrape, kept until the watermark
    (``delay`` behind the newest row) has passed it by the TTL. Within a micro-batch
    sightings count in order of time (a link before a submission of the same
    instant), across micro-batches in order of arrival; rows older than the
    watermark fail ``run_available``. Before the shuffle each task drops the
    sightings of a key that its other sightings make void, so of a URL on every
    page only few rows reach the task that holds its state; links themselves pass
    without a shuffle."""
    ship_package(urls.sparkSession)
    keyed = with_url_key(urls, "url", "url_key")
    rows = keyed.select("url_key", "url", F.coalesce(child_col, F.lit(False)).alias("child"), F.unix_micros(ts_col).alias("at"), F.col(ts_col).alias("seen_at"))
    free = rows.filter(F.col("child") | F.col("url_key").isNull()).select("url_key", "url", "child", "seen_at")
    width = _micros_of(ttl)
    # the watermark stands above the fold, which Spark cannot see through
    cached = rows.filter(F.col("url_key").isNotNull()).mapInPandas(_folded(width), _SIGHTING).withWatermark("seen_at", delay)
    passed = cached.groupBy("url_key").applyInPandasWithState(
        _renewing(width), "url_key string, url string, child boolean, seen_at timestamp", "last long", "append", "EventTimeTimeout"
    )
    return passed.unionByName(free).withColumnRenamed("seen_at", ts_col)


# ---------------------------------------------------------------- R72 ----
# Lifecycle event statuses.
LIFECYCLE_STATUSES = (
    "scraping", "scraped", "scrape_failed", "extracting_links", "links_extracted",
    "link_extraction_failed", "enriching", "enriched", "enrichment_failed",
)


def status_feed(events: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """R72 (feed): lifecycle events (request_id, status, stage, message, ts)
    of the watched documents; ``run_available`` with ``order`` writes each
    micro-batch in that order, and batches are numbered in order of arrival.
    ``watched`` is a static table of request ids (stream-static semi join;
    a broadcast when its size allows). Unlike a bounded channel, nothing is
    dropped."""
    if watched is None:
        return events
    return events.join(watched.select("request_id").distinct(), "request_id", "left_semi")


def latest_status(events: DataFrame) -> DataFrame:
    """R72 (state): the latest status per document — a stateful aggregate
    (update/complete mode), partial per micro-batch."""
    return events.groupBy("request_id").agg(
        F.max(F.struct("ts", "seq", "status"))["status"].alias("status"),
        F.max("ts").alias("last_event_at"),
        F.count(F.lit(1)).alias("events"),
    )


#: Statuses after which nothing more is expected of a document.
TERMINAL_STATUSES = ("scrape_failed", "link_extraction_failed", "enriched", "enrichment_failed")


def _until_done(merge, start, row, done, idle: int):
    """State per key that ends: ``merge`` folds the partial rows of a micro-batch
    into the state, ``row`` makes the output, ``done`` tells whether the key has had
    its last event. The state goes when the watermark has passed the key's newest
    event by ``idle`` micros and the key is done."""

    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        value = state.get if state.exists else start
        for frame in frames:
            for part in frame.itertuples(index=False):
                value = merge(value, part)
        state.update(value)
        if done(value):
            state.setTimeoutTimestamp(max((value[0] + idle) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([row(key, value)])

    return run


def latest_status_bounded(events: DataFrame, *, delay: str = "1 day", idle: str = "7 days") -> DataFrame:
    """R72 (state) with an end: as ``latest_status``, but a document whose latest
    status is terminal is forgotten once the watermark (``delay`` behind the newest
    event) has passed its newest event by ``idle``. An event after that would start
    it anew. Update mode. Each task folds its rows per document before the
    shuffle."""

    def fold(frames):
        import pandas as pd

        for frame in frames:
            if len(frame):
                frame = frame.sort_values(["request_id", "at", "seq"], kind="stable")
                last = frame.groupby("request_id", as_index=False).tail(1).set_index("request_id")
                last["events"] = frame.groupby("request_id").size()
                yield last.reset_index()[["request_id", "ts", "at", "seq", "status", "events"]]
            else:
                yield pd.DataFrame({c: [] for c in ("request_id", "ts", "at", "seq", "status", "events")})

    def merge(value, part):
        at, seq, status, n = value
        newer = (part.at, part.seq, part.status) > (at, seq, status)
        return (part.at, part.seq, part.status, n + part.events) if newer else (at, seq, status, n + part.events)

    def row(key, value):
        import pandas as pd

        return {"request_id": key[0], "status": value[2], "last_event_at": pd.Timestamp(value[0], unit="us"), "events": value[3]}

    ship_package(events.sparkSession)
    rows = events.select("request_id", "ts", F.unix_micros("ts").alias("at"), "seq", "status", F.lit(1).cast("long").alias("events"))
    partial = rows.mapInPandas(fold, "request_id string, ts timestamp, at long, seq long, status string, events long").withWatermark("ts", delay)
    run = _until_done(merge, (-(2**62), 0, "", 0), row, lambda v: v[2] in TERMINAL_STATUSES, _micros_of(idle))
    return partial.groupBy("request_id").applyInPandasWithState(
        run, "request_id string, status string, last_event_at timestamp, events long", "at long, seq long, status string, events long", "update", "EventTimeTimeout"
    )


# ---------------------------------------------------------------- R73 ----
def queue_waits(job_events: DataFrame) -> DataFrame:
    """R73 (wait): per job, first processing time minus first queued time,
    in seconds — a stateful aggregate over the job-event stream."""
    agg = job_events.groupBy("job_id").agg(
        F.min(F.when(F.col("event") == "queued", F.col("ts"))).alias("queued_at"),
        F.min(F.when(F.col("event") == "processing", F.col("ts"))).alias("processing_at"),
    )
    wait_us = F.unix_micros("processing_at") - F.unix_micros("queued_at")
    return agg.withColumn("wait_seconds", F.when(wait_us.isNotNull(), wait_us / 1e6))


def queue_waits_bounded(job_events: DataFrame, *, delay: str = "1 day", idle: str = "7 days") -> DataFrame:
    """R73 (wait) with an end: as ``queue_waits``, but a job that was queued and
    taken up is forgotten once the watermark has passed its newest event by
    ``idle``. Update mode, folded per task before the shuffle."""

    def fold(frames):
        for frame in frames:
            frame = frame.sort_values(["job_id", "at"], kind="stable")
            yield frame.groupby("job_id", as_index=False).agg(ts=("ts", "max"), at=("at", "max"), queued=("queued", "min"), processing=("processing", "min"))

    def first(a, b):
        known = [int(x) for x in (a, b) if x is not None and x == x]
        return min(known, default=None)

    def merge(value, part):
        return max(value[0], part.at), first(value[1], part.queued), first(value[2], part.processing)

    def row(key, value):
        import pandas as pd

        _, queued, processing = value
        stamp = lambda x: pd.NaT if x is None else pd.Timestamp(x, unit="us")
        wait = None if queued is None or processing is None else (processing - queued) / 1e6
        return {"job_id": key[0], "queued_at": stamp(queued), "processing_at": stamp(processing), "wait_seconds": wait}

    ship_package(job_events.sparkSession)
    at = F.unix_micros("ts")
    rows = job_events.select(
        "job_id", "ts", at.alias("at"), F.when(F.col("event") == "queued", at).alias("queued"), F.when(F.col("event") == "processing", at).alias("processing")
    )
    partial = rows.mapInPandas(fold, "job_id string, ts timestamp, at long, queued double, processing double").withWatermark("ts", delay)
    run = _until_done(merge, (-(2**62), None, None), row, lambda v: v[1] is not None and v[2] is not None, _micros_of(idle))
    return partial.groupBy("job_id").applyInPandasWithState(
        run, "job_id string, queued_at timestamp, processing_at timestamp, wait_seconds double", "at long, queued long, processing long", "update", "EventTimeTimeout"
    )


def live_metrics(
    job_events: DataFrame,
    snapshot: Callable[[], tuple[DataFrame, DataFrame]],
    out_path: str,
    *,
    as_of,
    every: str = "15 seconds",
    checkpoint: str,
    available_now: bool = False,
):
    """On a fixed beat, refresh the document statistics (R37) and job
    status counts (R38) from the current snapshot tables and the queue waits
    from the job-event stream; each micro-batch writes its figures under
    ``out_path/<figures|waits>/batch_id=N`` (idempotent on replay). ``snapshot()``
    returns the current (documents, jobs) tables, read anew every beat, and
    ``as_of`` is an instant or a function that gives the beat's own. Spark calls
    a beat when events came; ``metrics_beat`` also fires on an idle stream."""
    waits = queue_waits(job_events)

    def beat(batch: DataFrame, batch_id: int) -> None:
        _write_figures(snapshot, as_of, f"{out_path}/figures/batch_id={batch_id}")
        batch.write.mode("overwrite").parquet(f"{out_path}/waits/batch_id={batch_id}")

    writer = waits.writeStream.outputMode("update").foreachBatch(beat).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def _write_figures(snapshot, as_of, path: str) -> None:
    docs, jobs = snapshot()
    now = as_of() if callable(as_of) else as_of
    figures = S.document_stats(docs, as_of=now).unionByName(
        S.jobs_by_status(jobs).select(
            F.lit("jobs_by_status").alias("metric"), F.col("status").alias("key"), F.col("job_count").alias("value")
        )
    )
    # one folder per micro-batch, overwritten: a batch replayed after a
    # failure replaces its own output instead of appending it twice
    figures.write.mode("overwrite").parquet(path)


def metrics_beat(
    spark: SparkSession, snapshot: Callable[[], tuple[DataFrame, DataFrame]], out_path: str, *, as_of, every: str = "15 seconds", checkpoint: str
):
    """R73 (beat): the figures every ``every``, whether or not events come. The
    clock is a rate stream; ``as_of`` is called at each beat."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def beat(batch: DataFrame, batch_id: int) -> None:
        _write_figures(snapshot, as_of, f"{out_path}/figures/batch_id={batch_id}")

    return ticks.writeStream.foreachBatch(beat).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


# ------------------------------------------------------------- driving ----
class _Drops(StreamingQueryListener):
    """Rows that the watermark dropped, summed over every micro-batch (the query
    itself remembers only the last ones)."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.rows[run] = self.rows.get(run, 0) + dropped

    def onQueryTerminated(self, event):
        self.ended[str(event.runId)].set()


def run_available(
    df: DataFrame, name: str, *, mode: str = "append", order: tuple[str, ...] = (), closing: tuple[Callable[[], None], ...] = (),
    spark: SparkSession | None = None,
) -> str:
    """Run a streaming DataFrame over everything available now into parquet
    under the shared checkpoint folder; return the output path. With ``order``
    or in update mode every micro-batch is its own folder ``batch_id=N``, sorted
    and overwritten if it runs again. With ``closing`` functions the query goes on
    after they were called, from its own checkpoint, over what they added. Raises if
    the watermark dropped rows, in whichever micro-batch."""
    spark = spark or df.sparkSession
    base = scratch_path(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    writer = df.writeStream.option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True)
    if mode == "append" and not order:
        writer = writer.format("parquet").option("path", out)
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            rows = batch.orderBy(*order) if order else batch
            target = out if mode == "complete" else f"{out}/batch_id={batch_id}"
            rows.write.mode("overwrite").parquet(target)

        writer = writer.foreachBatch(sink)
    drops = _Drops()
    spark.streams.addListener(drops)
    try:
        for last in (False, True) if closing else (True,):
            q = writer.start()
            q.awaitTermination()
            if not drops.ended[str(q.runId)].wait(120):
                raise RuntimeError(f"{name}: no word of the query's end")
            if not last:
                for close in closing:
                    close()
    finally:
        spark.streams.removeListener(drops)
    if dropped := sum(drops.rows.values()):
        raise RuntimeError(f"{name}: {dropped} rows came later than the watermark allows; use a longer delay")
    return out
