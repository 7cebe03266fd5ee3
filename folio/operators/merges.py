"""Updates as keyed batch merges.

The reference updates one row per call; here each operator takes a table of
changes and returns ``Merged(documents, missing)``: the new snapshot (left
join on id, changed columns rebuilt only on matched rows) and the requested
keys that matched nothing (the reference's "not found"). The same plans can
feed ``DataFrame.mergeInto`` on a table format that supports it.

Joins are left joins keyed on the document id; the changes side is usually
small, and AQE turns the join into a broadcast when its measured size allows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import metadata as M
from folio.functions.common import micros, rfc3339, ts_lit
from folio.functions.tags import merge_tags, variant_strings
from folio.functions.visibility import first_trigger_tag, tombstone_at
from folio.operators.documents import found_keys, unmatched

DAY_US = 86_400_000_000


class Merged(NamedTuple):
    documents: DataFrame
    missing: DataFrame


def _days_after(as_of, days: int) -> Column:
    return F.timestamp_micros(F.lit(micros(as_of) + days * DAY_US))


def _missing(changes: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    return unmatched(changes.select(key).distinct(), documents, key)


def one_per_key(changes: DataFrame, key: str, cols: list[str], order: str | None = None) -> DataFrame:
    """One change per key. With an ``order`` column the last one counts (ties
    broken by content); without one, equal repeats collapse and different
    changes for one key fail the job. Aggregation, so a key that repeats in a
    large share of the rows is combined before the shuffle."""
    values = F.struct(*cols)
    if order is not None:
        picked = F.max_by(values, F.struct(order, F.to_json(F.struct(*cols)).alias("content")))
    else:
        differ = F.min(F.xxhash64(*cols)) != F.max(F.xxhash64(*cols))
        clash = F.raise_error(F.concat(F.lit("different changes for one key: "), F.col(key).cast("string")))
        picked = F.when(differ, clash.cast(changes.select(values.alias("v")).schema["v"].dataType)).otherwise(F.first(values))
    return changes.groupBy(key).agg(picked.alias("_change")).select(key, "_change.*")


def _keyed(changes: DataFrame, cols: dict[str, str], order: str | None = None) -> DataFrame:
    """Changes with prefixed value columns and a hit marker, one row per id."""
    single = one_per_key(changes, "id", list(cols), order)
    sel = [F.col("id")] + [F.col(src).alias(dst) for src, dst in cols.items()] + [F.lit(True).alias("_hit")]
    return single.select(*sel)


def _finish(joined: DataFrame, documents: DataFrame, **new_cols: Column) -> DataFrame:
    out = joined
    for name, c in new_cols.items():
        out = out.withColumn(name, c)
    return out.select(*documents.columns)


def HIT() -> Column:
    return F.col("_hit").isNotNull()


# ---------------------------------------------------------------- R61 ----
def replace_tags(documents: DataFrame, changes: DataFrame, *, trigger_tags=(), period_days: int = 90, as_of, order: str | None = None) -> Merged:
    """Replace tags wholly; when a trigger tag is present (first in tag
    order wins) set tombstone_datetime = as_of + period and the reason
    'auto-tombstone: <tag> tag', overwriting any earlier tombstone. Removing
    a trigger later does not clear it."""
    ch = _keyed(changes, {"tags": "chg_tags"}, order)
    j = documents.join(ch, "id", "left")
    hit = HIT()
    trig = first_trigger_tag("chg_tags", list(trigger_tags))
    fire = hit & trig.isNotNull()
    when_ts = _days_after(as_of, period_days)
    meta = M.to_text(
        M.overlay(
            "metadata",
            M.entry("tombstone_datetime", M.vtext(rfc3339(when_ts))),
            M.entry("tombstone_reason", M.vtext(F.concat(F.lit("auto-tombstone: "), trig, F.lit(" tag")))),
        )
    )
    snap = _finish(
        j,
        documents,
        tags=F.when(hit, F.col("chg_tags")).otherwise(F.col("tags")),
        metadata=F.when(fire, meta).otherwise(F.col("metadata")),
        tombstone_at=F.when(fire, when_ts).otherwise(F.col("tombstone_at")),
    )
    return Merged(snap, _missing(changes, documents))


# ---------------------------------------------------------------- R62 ----
def set_metadata(documents: DataFrame, changes: DataFrame, order: str | None = None) -> Merged:
    """Replace the whole metadata document (effective_date is not
    recomputed, as in the reference; the promoted tombstone is)."""
    ch = _keyed(changes, {"metadata": "chg_metadata"}, order)
    j = documents.join(ch, "id", "left")
    hit = HIT()
    new_meta = F.coalesce(F.col("chg_metadata"), F.lit("{}"))
    snap = _finish(
        j,
        documents,
        metadata=F.when(hit, new_meta).otherwise(F.col("metadata")),
        tombstone_at=F.when(hit, tombstone_at(new_meta)).otherwise(F.col("tombstone_at")),
    )
    return Merged(snap, _missing(changes, documents))


# ---------------------------------------------------------------- R63 ----
def set_seo(documents: DataFrame, changes: DataFrame, order: str | None = None) -> Merged:
    """Set seo_enabled."""
    ch = _keyed(changes, {"seo_enabled": "chg_seo"}, order)
    j = documents.join(ch, "id", "left")
    snap = _finish(j, documents, seo_enabled=F.when(HIT(), F.col("chg_seo")).otherwise(F.col("seo_enabled")))
    return Merged(snap, _missing(changes, documents))


# ---------------------------------------------------------------- R64 ----
def tombstone(documents: DataFrame, ids: DataFrame, *, period_days: int = 90, as_of) -> Merged:
    """Manual tombstone — sets tombstone_datetime only (no reason)."""
    ch = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("_hit", F.lit(True))
    j = documents.join(ch, "id", "left")
    when_ts = _days_after(as_of, period_days)
    meta = M.to_text(M.overlay("metadata", M.entry("tombstone_datetime", M.vtext(rfc3339(when_ts)))))
    snap = _finish(
        j,
        documents,
        metadata=F.when(HIT(), meta).otherwise(F.col("metadata")),
        tombstone_at=F.when(HIT(), when_ts).otherwise(F.col("tombstone_at")),
    )
    return Merged(snap, _missing(ch, documents))


def untombstone(documents: DataFrame, ids: DataFrame) -> Merged:
    """R64 undo: remove tombstone_datetime, leave tombstone_reason."""
    ch = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("_hit", F.lit(True))
    j = documents.join(ch, "id", "left")
    meta = M.to_text(M.drop_key(M.meta_map("metadata"), "tombstone_datetime"))
    snap = _finish(
        j,
        documents,
        metadata=F.when(HIT(), meta).otherwise(F.col("metadata")),
        tombstone_at=F.when(HIT(), F.lit(None).cast("timestamp")).otherwise(F.col("tombstone_at")),
    )
    return Merged(snap, _missing(ch, documents))


# ---------------------------------------------------------------- R34 ----
class Deleted(NamedTuple):
    documents: DataFrame
    jobs: DataFrame
    missing: DataFrame


def delete_documents(documents: DataFrame, jobs: DataFrame, ids: DataFrame) -> Deleted:
    """Remove documents (their tags go with the row); jobs pointing at
    them get result_request_id = null; ids not found are reported."""
    keys = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    kept = documents.join(keys, "id", "left_anti")
    gone = found_keys(keys, documents, "id").select(F.col("id").alias("gone_id"), F.lit(True).alias("_gone"))
    # jobs without a result get a key of their own, so they spread over partitions
    key = F.coalesce(F.col("result_request_id"), F.concat(F.lit("\u0000"), F.col("id")))
    j = jobs.withColumn("_k", key).join(gone.withColumnRenamed("gone_id", "_k"), "_k", "left")
    new_jobs = j.withColumn(
        "result_request_id", F.when(F.col("_gone").isNotNull(), F.lit(None).cast("string")).otherwise(F.col("result_request_id"))
    ).select(*jobs.columns)
    return Deleted(kept, new_jobs, unmatched(keys, documents, "id"))


# ------------------------------------------------------- R55 / R56 / R57 ----
SEVERE_BELOW = 0.25
STANDARD_BELOW = 0.35


def _tiers(score: Column, as_of):
    """(severe, standard, tombstone instant, reason) of the two-tier rule."""
    severe = (score > 0) & (score < SEVERE_BELOW)
    standard = (score >= SEVERE_BELOW) & (score < STANDARD_BELOW)
    when_ts = F.when(severe, _days_after(as_of, 7)).when(standard, _days_after(as_of, 30))
    reason = F.concat(F.lit("Low quality score: "), F.format_string("%.2f", score))
    return severe, standard, when_ts, reason


def _tier_meta(meta_map: Column, score: Column, as_of) -> Column:
    severe, standard, when_ts, reason = _tiers(score, as_of)
    tier = severe | standard
    return F.when(
        tier,
        F.map_concat(
            meta_map,
            M.entry("tombstone_datetime", M.vtext(rfc3339(when_ts))),
            M.entry("tombstone_reason", M.vtext(reason)),
        ),
    ).otherwise(meta_map)


def metadata_quality_score(metadata="metadata") -> Column:
    """quality_score.score when it is a JSON number inside an object, else 0."""
    v = F.try_parse_json(F.get_json_object(F.col(metadata) if isinstance(metadata, str) else metadata, "$.quality_score"))
    s = M.variant_at(v, "$.score")
    return F.when(M.is_object(v) & M.is_number(s), F.try_variant_get(v, "$.score", "double")).otherwise(F.lit(0.0))


def quality_tombstone(documents: DataFrame, *, as_of) -> DataFrame:
    """Two-tier tombstone from metadata.quality_score.score:
    0 < s < 0.25 → due in 7 days and seo off; 0.25 <= s < 0.35 → due in 30
    days and seo on (even if it was off); otherwise nothing."""
    scored = documents.withColumn("_score", metadata_quality_score("metadata"))
    score = F.col("_score")
    severe, standard, when_ts, _ = _tiers(score, as_of)
    tier = severe | standard
    meta = M.to_text(_tier_meta(M.meta_map("metadata"), score, as_of))
    return scored.select(
        *[
            F.when(tier, meta).otherwise(F.col("metadata")).alias(c) if c == "metadata"
            else F.when(severe, F.lit(False)).when(standard, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "seo_enabled"
            else F.when(tier, when_ts).otherwise(F.col(c)).alias(c) if c == "tombstone_at"
            else F.col(c)
            for c in documents.columns
        ]
    )


def _applicable() -> Column:
    """A result is applied only when completed and carrying an analysis
    object; otherwise the reference keeps polling."""
    return (F.col("status") == "completed") & M.is_object(F.try_parse_json(F.col("analysis")))


def first_results(results: DataFrame) -> DataFrame:
    """One result per job: the first usable one to arrive (ties broken by
    content); results that are not completed or carry no analysis object never
    stand in its way. Found by aggregation, so a job with many results never
    needs a sorted group."""
    best = F.min(F.struct("arrived_at", "status", "analysis")).alias("r")
    return results.filter(_applicable()).groupBy("job_id").agg(best).select("job_id", "r.arrived_at", "r.status", "r.analysis")


def _join_key(c: str) -> Column:
    """Join key that never matches and never collides for empty/null keys, so
    documents without an analysis job spread evenly instead of piling into
    one shuffle partition."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.concat(F.lit("\u0000"), F.col("id")))


# Analyser fields copied when present with the right JSON type.
ANALYZER_STRING_FIELDS = ("synopsis", "cleaned_text", "heuristic_cleaned_text", "editorial_analysis")


def _parsed(j: DataFrame, when: Column) -> DataFrame:
    """Parse the analysis (``_v``) and the metadata document (``_m``) once,
    and only on rows that ``when`` selects; the builders below read these
    columns instead of re-parsing per field."""
    return j.withColumn("_v", F.when(when, F.try_parse_json(F.col("res_analysis")))).withColumn(
        "_m", F.when(when, M.meta_map("metadata"))
    )


def _analysis_columns(j: DataFrame, as_of, trigger_tags, keep_tag_tombstone: bool, tag_period_days: int):
    """New (tags, metadata, seo_enabled, tombstone_at) for a row whose
    completed analysis is applied (R55, with the tiers of R56). Reads the
    parsed columns added by ``_parsed``."""
    v = F.col("_v")
    m = F.col("_m")
    tags_v = M.variant_at(v, "$.tags")
    qs_v = M.variant_at(v, "$.quality_score")
    old_am = F.coalesce(F.try_variant_get(m.getItem("analyzer_metadata"), "$", M.MAP_TYPE), M.empty_meta())
    am_parts = [M.maybe_entry(M.is_array(tags_v), "ai_tags", tags_v)]
    for k in ANALYZER_STRING_FIELDS:
        x = M.variant_at(v, f"$.{k}")
        am_parts.append(M.maybe_entry(M.is_string(x), k, x))
    det = M.variant_at(v, "$.ai_detection")
    am_parts.append(M.maybe_entry(M.is_object(det), "ai_detection", det))
    new_am = F.map_concat(old_am, *am_parts)
    base = F.map_concat(
        m,
        M.entry("analyzer_metadata", F.parse_json(F.to_json(new_am))),
        M.maybe_entry(M.is_object(qs_v), "quality_score", qs_v),
        M.entry("textanalyzer_status", M.vtext(F.lit("completed"))),
    )
    ai_strings = F.coalesce(variant_strings(v, "$.tags"), F.array().cast("array<string>"))
    merged = merge_tags("tags", ai_strings)
    tomb = F.col("tombstone_at")
    if keep_tag_tombstone and trigger_tags:
        trig = first_trigger_tag(merged, list(trigger_tags))
        tag_ts = _days_after(as_of, tag_period_days)
        base = F.when(
            trig.isNotNull(),
            F.map_concat(
                base,
                M.entry("tombstone_datetime", M.vtext(rfc3339(tag_ts))),
                M.entry("tombstone_reason", M.vtext(F.concat(F.lit("auto-tombstone: "), trig, F.lit(" tag")))),
            ),
        ).otherwise(base)
        tomb = F.when(trig.isNotNull(), tag_ts).otherwise(tomb)
    s = F.when(M.is_object(qs_v) & M.is_number(M.variant_at(qs_v, "$.score")), F.try_variant_get(qs_v, "$.score", "double")).otherwise(F.lit(0.0))
    severe, standard, when_ts, _ = _tiers(s, as_of)
    meta = M.to_text(_tier_meta(base, s, as_of))
    seo = F.when(severe, F.lit(False)).when(standard, F.lit(True)).otherwise(F.col("seo_enabled"))
    tomb = F.when(severe | standard, when_ts).otherwise(tomb)
    return merged, meta, seo, tomb


def apply_analysis(
    documents: DataFrame,
    results: DataFrame,
    *,
    as_of,
    trigger_tags=(),
    keep_tag_tombstone: bool = False,
    tag_period_days: int = 90,
) -> Merged:
    """Attach completed analysis results to their documents (matched on
    the analysis job id) with the quality tiers of R56. With
    ``keep_tag_tombstone`` a trigger tag among the merged tags tombstones the
    document (the reference loses that write; default keeps its behaviour)."""
    res = first_results(results).select(
        F.col("job_id").alias("res_job"), F.col("analysis").alias("res_analysis"), F.lit(True).alias("_hit")
    )
    j = _parsed(documents.join(res, _join_key("textanalyzer_uuid") == res["res_job"], "left"), HIT())
    hit = HIT()
    tags, meta, seo, tomb = _analysis_columns(j, as_of, trigger_tags, keep_tag_tombstone, tag_period_days)
    snap = _finish(
        j,
        documents,
        tags=F.when(hit, tags).otherwise(F.col("tags")),
        metadata=F.when(hit, meta).otherwise(F.col("metadata")),
        seo_enabled=F.when(hit, seo).otherwise(F.col("seo_enabled")),
        tombstone_at=F.when(hit, tomb).otherwise(F.col("tombstone_at")),
    )
    return Merged(snap, unmatched(res.select(F.col("res_job").alias("job_id")), documents, "textanalyzer_uuid"))


def _awaiting() -> Column:
    """Document waits for its analysis: status 'queued' in the metadata. A
    queued status is only ever written together with an analysis job id, so
    the JSON is read only for rows that have one (the cheap column test
    short-circuits the scan of every other document's metadata)."""
    has_job = F.coalesce(F.col("textanalyzer_uuid") != "", F.lit(False))
    queued = F.coalesce(F.get_json_object(F.col("metadata"), "$.textanalyzer_status") == "queued", F.lit(False))
    return F.when(has_job, queued).otherwise(F.lit(False))


def _timeout_meta(elapsed: Column, meta_map: Column | None = None) -> Column:
    base = meta_map if meta_map is not None else M.meta_map("metadata")
    return M.to_text(
        F.map_concat(
            base,
            M.entry("analysis_retrieval_timeout", F.lit(True).cast("variant")),
            M.entry("analysis_retrieval_elapsed_minutes", elapsed.cast("long").cast("variant")),
            M.entry("textanalyzer_status", M.vtext(F.lit("failed"))),
        )
    )


def enrich(
    documents: DataFrame,
    results: DataFrame,
    *,
    as_of,
    max_wait_minutes: int = 60,
    trigger_tags=(),
    keep_tag_tombstone: bool = False,
) -> DataFrame:
    """R33 (with R55-R57): for documents awaiting analysis
    (textanalyzer_status = 'queued'), the wait is checked before the result:

    * a completed result that arrived (by ``as_of``) within ``max_wait``
      minutes of the document's creation is applied (R55/R56);
    * otherwise, once more than ``max_wait`` minutes have passed — at the
      result's arrival, or at ``as_of`` if none arrived — the document gets
      the timeout record of R57 and a late result is ignored;
    * else it is still waiting and stays as it is.

    Returns the new snapshot with an ``enrich_outcome`` column
    ('applied' / 'timeout' / 'waiting', null when not awaiting analysis).
    """
    asof_ts = ts_lit(as_of)
    res = first_results(results.filter(F.col("arrived_at") <= asof_ts)).select(
        F.col("job_id").alias("res_job"),
        F.col("analysis").alias("res_analysis"),
        F.col("arrived_at").alias("res_arrived"),
        F.lit(True).alias("_hit"),
    )
    j = documents.join(res, _join_key("textanalyzer_uuid") == res["res_job"], "left")
    awaiting = _awaiting()
    wait_us = max_wait_minutes * 60_000_000
    created_us = F.unix_micros(F.col("created_at"))
    arrival = F.col("res_arrived")
    timely = arrival.isNotNull() & (F.unix_micros(arrival) - created_us <= F.lit(wait_us))
    probe_at = F.coalesce(arrival, asof_ts)
    late = ~F.coalesce(timely, F.lit(False)) & (F.unix_micros(probe_at) - created_us > F.lit(wait_us))
    elapsed = F.floor((F.unix_micros(probe_at) - created_us) / F.lit(60_000_000))
    outcome = (
        F.when(~awaiting, F.lit(None).cast("string"))
        .when(F.coalesce(timely, F.lit(False)), F.lit("applied"))
        .when(late, F.lit("timeout"))
        .otherwise(F.lit("waiting"))
    )
    j = j.withColumn("enrich_outcome", outcome)
    applied = F.col("enrich_outcome") == "applied"
    timed_out = F.col("enrich_outcome") == "timeout"
    j = _parsed(j, applied | timed_out)
    tags, meta, seo, tomb = _analysis_columns(j, as_of, trigger_tags, keep_tag_tombstone, 90)
    out = (
        j.withColumn("tags", F.when(applied, tags).otherwise(F.col("tags")))
        .withColumn(
            "metadata",
            F.when(applied, meta).when(timed_out, _timeout_meta(elapsed, F.col("_m"))).otherwise(F.col("metadata")),
        )
        .withColumn("seo_enabled", F.when(applied, seo).otherwise(F.col("seo_enabled")))
        .withColumn("tombstone_at", F.when(applied, tomb).otherwise(F.col("tombstone_at")))
    )
    return out.select(*documents.columns, "enrich_outcome")


def analysis_timeout(documents: DataFrame, *, as_of, max_wait_minutes: int = 60) -> DataFrame:
    """R57 alone: documents still awaiting analysis more than ``max_wait``
    minutes after creation get the timeout record."""
    awaiting = _awaiting()
    created_us = F.unix_micros(F.col("created_at"))
    waited = F.lit(micros(as_of)) - created_us
    late = awaiting & (waited > F.lit(max_wait_minutes * 60_000_000))
    elapsed = F.floor(waited / F.lit(60_000_000))
    return documents.withColumn("metadata", F.when(late, _timeout_meta(elapsed)).otherwise(F.col("metadata")))
