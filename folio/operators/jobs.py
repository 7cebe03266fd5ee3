"""Crawl jobs.

Jobs form a forest through parent_job_id. Listing pages are bounded (a page
of parents), children are joined, never collected per parent, and the
subtree walk doubles the paths it covers every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.common import ts_lit
from folio.operators.documents import LIST_LIMIT, found_keys, keyed_rows, unmatched
from folio.session import checkpoint_dir


def _ids(spark: SparkSession, ids, name: str = "id") -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    return spark.createDataFrame([(i,) for i in ids], f"{name} string")


def get_jobs(jobs: DataFrame, ids) -> DataFrame:
    """Lookup by id with a ``found`` flag per requested id."""
    keys, hits = keyed_rows(jobs, "id", ids)
    out = keys.distinct().withColumnRenamed("requested", "requested_id").join(hits, F.col("requested_id") == hits["id"], "left")
    return out.withColumn("found", F.col("id").isNotNull())


def retryable_jobs(jobs: DataFrame) -> DataFrame:
    """Only failed jobs may be retried."""
    return jobs.filter(F.col("status") == "failed")


def unexpired(tracked: DataFrame, *, as_of) -> DataFrame:
    """Tracked requests still alive (as_of not after expires_at)."""
    return tracked.filter(~(ts_lit(as_of) > F.col("expires_at")))


def lookup_requests(tracked: DataFrame, jobs: DataFrame, ids) -> DataFrame:
    """R23 union form: a request id is looked up among tracked text requests
    first, then among jobs."""
    keys = _ids(jobs.sparkSession, ids, "requested_id")
    t = tracked.join(keys, tracked["id"] == keys["requested_id"], "left_semi").withColumn("kind", F.lit("text"))
    in_t = t.select(F.col("id").alias("requested_id"))
    rest = keys.join(in_t, "requested_id", "left_anti")
    j = jobs.join(rest, jobs["id"] == rest["requested_id"], "left_semi").withColumn("kind", F.lit("job"))
    return t.unionByName(j, allowMissingColumns=True)


def top_level_page(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Top-level jobs, newest first, one page."""
    parents = jobs.filter(F.col("parent_job_id").isNull()).orderBy(F.col("created_at").desc(), F.col("id").asc())
    if offset:
        parents = parents.offset(int(offset))
    return parents.limit(int(limit))


def jobs_with_children(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of top-level jobs (newest first) with their direct
    children (oldest first), one row per (parent, child); parents without
    children appear once with null child columns.

    The page holds at most ``limit`` parents; up to ``LIST_LIMIT`` it is
    broadcast to the jobs, so only the page's children are shuffled. They are
    joined and sorted globally (a parent with millions of children is spread
    over range partitions, never gathered into one list)."""
    page = top_level_page(jobs, limit, offset).select(
        F.col("id").alias("parent_id"), F.col("created_at").alias("parent_created_at"), F.col("url").alias("parent_url")
    )
    kids = jobs.filter(F.col("parent_job_id").isNotNull()).select(
        F.col("parent_job_id").alias("parent_id"),
        F.col("id").alias("child_id"),
        F.col("created_at").alias("child_created_at"),
        F.col("status").alias("child_status"),
    )
    ids = page.select("parent_id")
    kids = kids.join(F.broadcast(ids) if limit <= LIST_LIMIT else ids, "parent_id", "left_semi")
    return (
        page.join(kids, "parent_id", "left")
        .select("parent_id", "parent_created_at", "parent_url", "child_id", "child_created_at", "child_status")
        .orderBy(F.col("parent_created_at").desc(), "parent_id", "child_created_at", "child_id")
    )


def child_jobs(jobs: DataFrame, parent_ids) -> DataFrame:
    """Direct children of the given parents, oldest first."""
    keys = _ids(jobs.sparkSession, parent_ids, "parent_job_id")
    return jobs.join(keys, "parent_job_id", "left_semi").orderBy("created_at", "id")


def _levels(jobs: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """((id, level) of every job below or among the roots, rounds taken).

    Path doubling. Each job holds a pointer to the ancestor ``hops`` above it and
    its level below the nearest root met on the way there, if any. A round looks
    the pointer up among all jobs and takes over what that ancestor holds, so the
    paths covered double and a tree of depth d is done after log2(d) rounds. A job
    with a level, or whose path has passed the top, is settled; a path as long as
    there are jobs is a cycle without a root. Every round is one join of the
    unsettled jobs with all jobs on the id, checkpointed to the shared folder
    (which cuts lineage: a lost executor recomputes one round)."""
    marked = roots.withColumn("level", F.lit(0))
    state = jobs.select("id", F.col("parent_job_id").alias("up"), F.lit(1).cast("long").alias("hops")).join(marked, "id", "left").checkpoint()
    settled = F.col("level").isNotNull() | F.col("up").isNull()
    size, rounds, covered = None, 0, 1
    while True:
        left = state.filter(~settled).count()
        if size is None:
            size = left
        if not left or covered > size:
            return state.filter("level IS NOT NULL").select("id", F.col("level").cast("int").alias("level")), rounds
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next_up"), F.col("hops").alias("next_hops"), F.col("level").alias("next_level"))
        moved = state.filter(~settled).join(above, "up", "left").select(
            "id", F.col("next_up").alias("up"), (F.col("hops") + F.coalesce("next_hops", F.lit(0))).alias("hops"),
            (F.col("hops") + F.col("next_level")).alias("level"),
        )
        state = state.filter(settled).unionByName(moved).checkpoint()
        rounds, covered = rounds + 1, covered * 2


def job_descendants(jobs: DataFrame, root_ids, *, include_roots: bool = True) -> DataFrame:
    """The whole subtree under the roots (what the cascading foreign key
    deletes), with each job's level below its nearest root. Ids are unique, as
    everywhere in the table; cycles and pointers to missing jobs end the walk."""
    spark = jobs.sparkSession
    checkpoint_dir(spark)
    roots = found_keys(_ids(spark, root_ids, "id"), jobs, "id")
    found, _ = _levels(jobs, roots)
    return found if include_roots else found.filter(F.col("level") > 0)


def missing_jobs(jobs: DataFrame, ids) -> DataFrame:
    """Requested ids that no job has (R65, R67: the reference's "not found")."""
    wanted = _ids(jobs.sparkSession, ids, "id").distinct()
    return unmatched(wanted, jobs, "id")


def unmatched_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Job ids of events that no job has, with their number of events."""
    counted = events.groupBy("job_id").agg(F.count(F.lit(1)).alias("events"))
    return unmatched(counted, jobs, "id")


def delete_jobs(jobs: DataFrame, ids) -> DataFrame:
    """Jobs left after deleting the given jobs and all their descendants."""
    gone = job_descendants(jobs, ids).select("id")
    return jobs.join(gone, "id", "left_anti")


def jobs_with_results(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Each job with the document its result_request_id points to."""
    docs = documents.select(
        F.col("id").alias("result_request_id"),
        F.col("source_type").alias("result_source_type"),
        F.col("slug").alias("result_slug"),
        F.lit(True).alias("result_found"),
    )
    key = F.coalesce(F.col("result_request_id"), F.concat(F.lit("\u0000"), F.col("id")))
    j = jobs.withColumn("_k", key).join(docs.withColumnRenamed("result_request_id", "_k"), "_k", "left").drop("_k")
    return j.withColumn("result_found", F.coalesce("result_found", F.lit(False)))


# ---------------------------------------------------------------- R65 ----
STATUS_EVENTS = ("queued", "processing", "completed", "failed")


def apply_job_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Fold status events (job_id, ts, seq, event, result_request_id,
    message) into the job rows.

    * queued / processing / completed / failed set the status;
      completed_at = event time for completed/failed, else null;
      error_message = message for failed, else ''.
    * completed also sets result_request_id.
    * failed adds one retry.
    * retry turns a failed job back to queued (error cleared, retries kept)
      and does nothing otherwise.
    * task (with a ``task_id`` column) records the queue's task id.

    The fold is order-dependent only through 'retry', which acts iff the
    latest status event before it is 'failed'; so the final state is the
    latest status event plus whether a retry follows it — plain per-job
    aggregates (partial, map-side), no per-job sort.
    """
    order = F.struct("ts", "seq")
    is_status = F.col("event").isin(*STATUS_EVENTS)
    if "task_id" not in events.columns:
        events = events.withColumn("task_id", F.lit(None).cast("string"))
    agg = events.groupBy("job_id").agg(
        F.max(F.when(is_status, F.struct("ts", "seq", "event", "result_request_id", "message"))).alias("last"),
        F.max(F.when(F.col("event") == "retry", order)).alias("last_retry"),
        F.max(order).alias("last_any"),
        F.count_if(F.col("event") == "failed").alias("failures"),
        # 'task' events carry the queue's task id; the latest one is kept
        F.max(F.when((F.col("event") == "task") & F.col("task_id").isNotNull(), F.struct("ts", "seq", "task_id"))).alias("last_task"),
    )
    j = jobs.join(agg.withColumnRenamed("job_id", "id"), "id", "left")
    hit = F.col("last_any").isNotNull()
    last = F.col("last")
    retry_after = F.col("last_retry").isNotNull() & (last.isNull() | (F.col("last_retry") > F.struct(last["ts"], last["seq"])))
    base_status = F.coalesce(last["event"], F.col("status"))
    requeue = retry_after & (base_status == "failed")
    status = F.when(requeue, F.lit("queued")).otherwise(base_status)
    completed_at = (
        F.when(requeue, F.lit(None).cast("timestamp"))
        .when(last.isNotNull(), F.when(last["event"].isin("completed", "failed"), last["ts"]))
        .otherwise(F.col("completed_at"))
    )
    error = (
        F.when(requeue, F.lit(""))
        .when(last.isNotNull(), F.when(last["event"] == "failed", last["message"]).otherwise(F.lit("")))
        .otherwise(F.col("error_message"))
    )
    result = F.when(last["event"] == "completed", last["result_request_id"]).otherwise(F.col("result_request_id"))
    return j.select(
        *[
            F.when(hit, status).otherwise(F.col("status")).alias("status") if c == "status"
            else F.when(hit, completed_at).otherwise(F.col("completed_at")).alias("completed_at") if c == "completed_at"
            else F.when(hit, error).otherwise(F.col("error_message")).alias("error_message") if c == "error_message"
            else F.when(hit, result).otherwise(F.col("result_request_id")).alias("result_request_id") if c == "result_request_id"
            else (F.col("retries") + F.coalesce(F.col("failures"), F.lit(0))).cast("int").alias("retries") if c == "retries"
            else F.when(hit, F.col("last_any")["ts"]).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at"
            else F.coalesce(F.col("last_task")["task_id"], F.col("asynq_task_id")).alias("asynq_task_id") if c == "asynq_task_id"
            else F.col(c)
            for c in jobs.columns
        ]
    )
