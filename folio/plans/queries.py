"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the driver's tables (through the fixture derivations), using the
library's operators. Oracles with the same keys live in ``oracles.py``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import (
    clean_author,
    effective_date,
    first_trigger_tag,
    merge_tags,
    normalize_tag,
    slug_source,
    slugify,
)
from folio.operators import crawl
from folio.operators import documents as D
from folio.operators import images as I  # noqa: E741
from folio.operators import jobs as J
from folio.operators import merges as MG
from folio.operators import publish as P
from folio.operators import rollup as R
from folio.operators import stats as S
from folio.operators import tag_index as TI
from folio.operators.timeline import tag_timeline, timeline_extent, timeline_stats
from folio.plans.common import AS_OF, CORPUS_END, CORPUS_START, TIMELINE_END, TIMELINE_START, fmt_ts, r6
from folio.session import materialised, scratch_path
from folio.sources import documents as SD
from folio.sources import fixtures as FX
from folio.sources import lookup as LU
from folio.sources.fixtures import corpus_documents, timeline_documents
from folio.sources.merge_on_read import DocumentLog
from folio.sources.tables import forget_plans, load_table, stream_table
from folio.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _timeline_out(flat: DataFrame) -> DataFrame:
    return flat.select(
        "bucket",
        fmt_ts("bucket_start").alias("bucket_start"),
        "duration_seconds",
        "tag",
        "doc_count",
        "rank",
        r6("popularity_score").alias("popularity_score"),
        r6("size_factor").alias("size_factor"),
    )


@register("tag_timeline")
def q_tag_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R35 flagship: events as documents, 1-day buckets over January 2024."""
    docs = timeline_documents(spark, sf_dir)
    return _timeline_out(
        tag_timeline(docs, TIMELINE_START, TIMELINE_END, as_of=AS_OF, bucket_seconds=86400, max_tags=20)
    )


@register("tag_timeline_stats")
def q_tag_timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = timeline_documents(spark, sf_dir)
    return timeline_stats(docs, TIMELINE_START, TIMELINE_END, as_of=AS_OF, bucket_seconds=86400, max_tags=20)


@register("corpus_tag_timeline")
def q_corpus_tag_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R35 on the corpus: automatic width (R41), visibility at as_of, top 5."""
    docs = corpus_documents(spark, sf_dir)
    return _timeline_out(tag_timeline(docs, CORPUS_START, CORPUS_END, as_of=AS_OF, max_tags=5))


@register("corpus_tag_timeline_stats")
def q_corpus_tag_timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_documents(spark, sf_dir)
    return timeline_stats(docs, CORPUS_START, CORPUS_END, as_of=AS_OF, max_tags=5)


def _changed_rollup(spark, sf_dir):
    """The corpus' rollup, maintained through three batches of changes: tags that
    bring a tombstone (due by now), seo switched, manual tombstones."""
    docs = corpus_documents(spark, sf_dir)
    text, url = F.col("source_type") == "text", F.col("source_type") == "url"
    earlier = AS_OF - dt.timedelta(days=100)
    tagged, switched, gone = text & (_k() % 11 == 0), url & (_k() % 4 == 0), url & (_k() % 6 == 0)
    # only changed documents are read again
    before = materialised(docs.filter(tagged | switched | gone), "changed-documents")
    tags = before.filter(tagged).select("id", F.concat("tags", F.array(F.lit("spam"))).alias("tags"))
    seo = before.filter(switched).select("id", (~F.col("seo_enabled")).alias("seo_enabled"))
    after = MG.replace_tags(before, tags, trigger_tags=TRIGGER_TAGS, as_of=earlier).documents
    after = MG.tombstone(MG.set_seo(after, seo).documents, before.filter(gone).select("id"), as_of=AS_OF).documents
    return R.merge_rollups(R.timeline_rollup(docs), R.rollup_changes(before, after))


@register("rollup_timeline")
def q_rollup_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R35 from the maintained rollup: buckets of six hours after R61, R63, R64."""
    rollup = _changed_rollup(spark, sf_dir)
    return _timeline_out(R.timeline_from_rollup(rollup, CORPUS_START, CORPUS_END, as_of=AS_OF, bucket_seconds=21_600, max_tags=5))


@register("rollup_timeline_stats")
def q_rollup_timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stats_from_rollup(_changed_rollup(spark, sf_dir), CORPUS_START, CORPUS_END, as_of=AS_OF, bucket_seconds=21_600, max_tags=5)


# ------------------------------------------------------------------ helpers

BASE_URL = "https://corpus.example.com"
IMAGE_BASE_URL = "https://scraper.example.com"
TRIGGER_TAGS = ("spam", "low-quality")


def _tags(c="tags"):
    return F.array_join(F.col(c), "|")


def _doc_out(df: DataFrame) -> DataFrame:
    return df.select("id", fmt_ts("effective_date").alias("effective_date"), "source_type", _tags().alias("tags"))


def _k(id_col="id"):
    """Numeric key of a fixture id ('p12' / 'd7' -> 12 / 7)."""
    return F.substring(F.col(id_col), 2, 20).cast("long")


def _scored_pages(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    return pages.select(
        "page_id", "url", "html",
        FX.gate_score(pid).alias("score"),
        F.lit("fixture").alias("reason"),
        FX._categories(pid).alias("categories"),
        (FX.gate_score(pid) >= 0.5).alias("is_recommended"),
        F.array().cast("array<string>").alias("malicious_indicators"),
    )


# ------------------------------------------------------------- stats / read
@register("timeline_extent")
def q_timeline_extent(spark, sf_dir):
    """R36."""
    return timeline_extent(corpus_documents(spark, sf_dir), as_of=AS_OF).select(fmt_ts("earliest").alias("earliest"))


@register("document_stats")
def q_document_stats(spark, sf_dir):
    """R37."""
    return S.document_stats(corpus_documents(spark, sf_dir), as_of=AS_OF)


@register("jobs_by_status")
def q_jobs_by_status(spark, sf_dir):
    """R38."""
    return S.jobs_by_status(FX.crawl_jobs(spark, sf_dir))


@register("explode_tags")
def q_explode_tags(spark, sf_dir):
    """R03."""
    return D.explode_tags(corpus_documents(spark, sf_dir))


@register("filter_documents")
def q_filter_documents(spark, sf_dir):
    """R12 (+R11, R14 exact, R18): tags, date range, paging."""
    import datetime as dt

    utc = dt.timezone.utc
    docs = corpus_documents(spark, sf_dir)
    out = D.filter_documents(
        docs, as_of=AS_OF, tags=["news", "en", "social_media"],
        date_start=dt.datetime(2024, 1, 5, tzinfo=utc), date_end=dt.datetime(2024, 1, 25, tzinfo=utc),
        limit=100, offset=10,
    )
    return _doc_out(out)


@register("filter_documents_fuzzy")
def q_filter_documents_fuzzy(spark, sf_dir):
    """R12 with fuzzy tags (R14 LIKE, user wildcards kept) and source type, no limit."""
    docs = corpus_documents(spark, sf_dir)
    out = D.filter_documents(docs, as_of=AS_OF, tags=["learn", "%ia_"], fuzzy=True, source_type="url", limit=0)
    return _doc_out(out)


@register("list_documents")
def q_list_documents(spark, sf_dir):
    """First page of 50."""
    return _doc_out(D.list_documents(corpus_documents(spark, sf_dir), as_of=AS_OF, limit=50, offset=0))


@register("search_by_tags")
def q_search_by_tags(spark, sf_dir):
    """R13 exact."""
    return D.search_by_tags(corpus_documents(spark, sf_dir), ["fr", "social_media"])


@register("search_by_tags_fuzzy")
def q_search_by_tags_fuzzy(spark, sf_dir):
    """R13 fuzzy."""
    return D.search_by_tags(corpus_documents(spark, sf_dir), ["edu", "mach"], fuzzy=True)


@register("documents_with_any_tag")
def q_documents_with_any_tag(spark, sf_dir):
    """R18."""
    return D.documents_with_any_tag(corpus_documents(spark, sf_dir), ["de", "es"]).select("id", "source_type")


def _tag_index(spark, sf_dir):
    path = scratch_path(spark, "tag-index")
    TI.build_tag_index(corpus_documents(spark, sf_dir), path)
    return path


@register("tag_index_search")
def q_tag_index_search(spark, sf_dir):
    """R13 from the index, exact and fuzzy, with documents changed (R61) or gone
    (R34) since it was built."""
    path = _tag_index(spark, sf_dir)
    text, k = F.col("source_type") == "text", _k()
    tags = F.when(k % 11 == 0, F.concat("tags", F.array(F.lit("education")))).when(k % 13 == 0, F.array(F.lit("moved")))
    changed = corpus_documents(spark, sf_dir).filter(text & ((k % 11 == 0) | (k % 13 == 0) | (k % 17 == 0))).select("id", tags.alias("tags"))
    exact = TI.search_by_index(spark, path, ["fr", "social_media", "moved"], changed=changed)
    fuzzy = TI.search_by_index(spark, path, ["edu", "mach"], fuzzy=True, changed=changed)
    return exact.select(F.lit("exact").alias("mode"), "id").unionByName(fuzzy.select(F.lit("fuzzy").alias("mode"), "id"))


@register("tag_index_counts")
def q_tag_index_counts(spark, sf_dir):
    """Documents per tag, from the dictionary."""
    return TI.indexed_tags(spark, _tag_index(spark, sf_dir))


@register("lookup_documents")
def q_lookup_documents(spark, sf_dir):
    """R15 on the table laid out for lookups: what completed jobs point to."""
    path = scratch_path(spark, "lookup")
    LU.write_lookup(corpus_documents(spark, sf_dir), path, buckets=32)
    ids = FX.crawl_jobs(spark, sf_dir).filter(F.col("status") == "completed").select("result_request_id").distinct()
    return LU.lookup_documents(spark, path, ids, buckets=32).select("requested_id", "found", "source_type")


@register("lookup_slugs")
def q_lookup_slugs(spark, sf_dir):
    """R16 (published only) on the table laid out for lookups."""
    path = scratch_path(spark, "lookup")
    LU.write_lookup(corpus_documents(spark, sf_dir), path, buckets=32)
    slugs = load_table(spark, sf_dir, "part").select(F.concat(F.lit("page-"), (F.col("p_partkey") % 300).cast("string")).alias("slug")).distinct()
    out = LU.lookup_slugs(spark, path, slugs, published_only=True, buckets=32)
    return out.select("requested_slug", "found", "id")


@register("get_documents")
def q_get_documents(spark, sf_dir):
    """Look up the documents completed jobs point to."""
    ids = FX.crawl_jobs(spark, sf_dir).filter(F.col("status") == "completed").select("result_request_id").distinct()
    out = D.get_documents(corpus_documents(spark, sf_dir), ids)
    return out.select("requested_id", "found", "source_type")


@register("get_by_slug")
def q_get_by_slug(spark, sf_dir):
    """R16 (published only)."""
    part = load_table(spark, sf_dir, "part")
    slugs = part.select(F.concat(F.lit("page-"), (F.col("p_partkey") % 300).cast("string")).alias("slug")).distinct()
    out = D.get_by_slug(corpus_documents(spark, sf_dir), slugs, published_only=True)
    return out.select("requested_slug", "found", "id")


@register("slug_conflicts")
def q_slug_conflicts(spark, sf_dir):
    """R77."""
    out = D.slug_conflicts(corpus_documents(spark, sf_dir))
    return out.select("id", "slug", fmt_ts("created_at").alias("created_at"), "kept_id")


# ------------------------------------------------------------- row rules
@register("url_rules")
def q_url_rules(spark, sf_dir):
    """R19, R20, R45, R51, R52 on page URLs."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    return crawl.url_rules(pages)


@register("link_rules")
def q_link_rules(spark, sf_dir):
    """R19, R20, R51, R52 on every extracted link."""
    links = crawl.page_links(load_table(spark, sf_dir, "pages")).select("page_id", "pos", F.col("link").alias("url"))
    return crawl.url_rules(links).drop("domain")


@register("page_links")
def q_page_links(spark, sf_dir):
    """R08."""
    return crawl.page_links(load_table(spark, sf_dir, "pages"))


@register("row_functions")
def q_row_functions(spark, sf_dir):
    """R17, R40, R44, R47, R53 over documents + labels."""
    t = FX.labelled_texts(spark, sf_dir)
    did = F.col("doc_id")
    tags = F.concat(
        F.array(F.col("lang"), F.col("source")),
        F.when(F.col("quality") == 0, F.array(F.lit("low-quality"))).otherwise(F.array().cast("array<string>")),
    )
    created = FX.fixture_time(did)
    # one publication-date shape per doc_id % 6, including malformed and non-string values
    d = F.date_format(FX.plus_micros(created, F.lit(-3 * 86_400_000_000)), "yyyy-MM-dd")
    hms = F.date_format(FX.plus_micros(created, F.lit(-2 * 86_400_000_000)), "yyyy-MM-dd HH:mm:ss")
    rfc = F.date_format(FX.plus_micros(created, F.lit(-1 * 86_400_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shape = did % 6
    meta = (
        F.when(shape == 0, F.concat(F.lit('{"scraper_metadata":{"publish_date":"'), rfc, F.lit('"}}')))
        .when(shape == 1, F.concat(F.lit('{"additional_metadata":{"date":"'), d, F.lit('"}}')))
        .when(shape == 2, F.concat(F.lit('{"additional_metadata":{"published_date":"'), hms, F.lit('"}}')))
        .when(shape == 3, F.concat(F.lit('{"scraper_metadata":{"publish_date":"2024-1-5"},"additional_metadata":{"date":"'), d, F.lit('"}}')))
        .when(shape == 4, F.lit('{"scraper_metadata":{"publish_date":20240105}}'))
        .otherwise(F.lit("{}"))
    )
    author = (
        F.when(did % 4 == 0, F.concat(F.lit("https://authors.example.com/"), did.cast("string")))
        .when(did % 4 == 1, F.concat(F.lit("  www.author"), did.cast("string")))
        .when(did % 4 == 2, F.concat(F.lit("Writer "), F.col("lang")))
        .otherwise(F.col("source"))
    )
    return t.select(
        did.alias("doc_id"),
        normalize_tag(F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit("-x"))).alias("normalized_tag"),
        F.array_join(merge_tags(tags, F.array(F.upper(F.col("lang")), F.concat(F.lit("Topic-"), (did % 7).cast("string")), F.concat(F.lit("topic-"), (did % 7).cast("string")))), "|").alias("merged_tags"),
        first_trigger_tag(tags, ["low-quality", "en"]).alias("trigger_tag"),
        clean_author(author).alias("author"),
        fmt_ts(effective_date(meta, created)).alias("effective_date"),
    )


@register("text_slugs")
def q_text_slugs(spark, sf_dir):
    """R49 + R50 on every document text."""
    docs = load_table(spark, sf_dir, "documents")
    return docs.select("doc_id", slugify(slug_source(F.lit(None).cast("string"), F.col("text"))).alias("slug"))


@register("score_gate")
def q_score_gate(spark, sf_dir):
    """R21 + R22."""
    scored = crawl.gate(_scored_pages(spark, sf_dir), 0.5)
    from folio.functions.scores import meets_threshold

    return scored.select(
        "url", "score", "decision", meets_threshold("score", 0.5).alias("meets_threshold"), F.lit(0.5).alias("threshold")
    )


# ------------------------------------------------------------- crawl side
def _scrapes(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    publish = F.when(
        pid % 3 == 0,
        F.concat(F.lit('{"publish_date":"'), F.date_format(FX.plus_micros(FX.fixture_time(pid), F.lit(-10 * 86_400_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}')),
    )
    return pages.select(
        "url",
        F.concat(F.lit("s"), pid.cast("string")).alias("scrape_id"),
        FX.page_title(F.col("html")).alias("title"),
        FX.page_content(F.col("html")).alias("content"),
        F.lit("").alias("raw_text"),
        publish.alias("page_metadata"),
        F.lit(None).cast("string").alias("page_score"),
        F.lit("").alias("slug"),
    )


@register("low_score_documents")
def q_low_score_documents(spark, sf_dir):
    """R58 from the gate's rejected URLs."""
    scored = crawl.gate(_scored_pages(spark, sf_dir), 0.5)
    docs = crawl.low_score_documents(scored.filter(F.col("decision") == "rejected"), threshold=0.5, as_of=AS_OF)
    return docs.select(
        "id", "source_url", _tags().alias("tags"), "seo_enabled", fmt_ts("tombstone_at").alias("tombstone_at"),
        F.get_json_object("metadata", "$.link_score.score").cast("double").alias("link_score"),
        F.get_json_object("metadata", "$.threshold").cast("double").alias("threshold"),
    )


@register("scraped_documents")
def q_scraped_documents(spark, sf_dir):
    """R59 from accepted and image URLs joined to the scrape output."""
    scored = crawl.gate(_scored_pages(spark, sf_dir).drop("html"), 0.5)
    docs = crawl.scraped_documents(scored.filter(F.col("decision") != "rejected"), _scrapes(spark, sf_dir), as_of=AS_OF)
    return docs.select("id", "slug", _tags().alias("tags"), "textanalyzer_uuid", fmt_ts("effective_date").alias("effective_date"))


def _texts(spark, sf_dir):
    conv = load_table(spark, sf_dir, "conversations")
    return conv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("text_id"),
        "conv_id", "turn", "text",
    )


@register("text_documents")
def q_text_documents(spark, sf_dir):
    """User turns as directly submitted texts with their analysis."""
    texts = _texts(spark, sf_dir)
    results = texts.select(
        "text_id",
        F.to_json(
            F.struct(
                F.array(F.concat(F.lit("Conversation-Turn-"), F.col("turn").cast("string")), F.lit("user")).alias("tags"),
                F.when(F.col("turn") % 2 == 0, F.regexp_extract(F.col("text"), r"^[^\n]*", 0)).alias("cleaned_text"),
            )
        ).alias("analysis"),
    )
    docs = crawl.text_documents(texts.select("text_id", "text"), results, as_of=AS_OF)
    return docs.select("id", "slug", _tags().alias("tags"))


@register("expand_frontier")
def q_expand_frontier(spark, sf_dir):
    """Next crawl level from jobs that have a page (job key = page id)."""
    jobs = FX.crawl_jobs(spark, sf_dir)
    pages = load_table(spark, sf_dir, "pages")
    parents = jobs.join(pages.select(F.col("page_id").cast("string").alias("id"), "page_id"), "id")
    links = crawl.page_links(pages)
    out = crawl.expand_frontier(parents.select("id", "depth", "extract_links", "page_id"), links, max_depth=2)
    return out.select("id", "url", "extract_links", "depth", "parent_job_id", "status")


@register("crawl")
def q_crawl(spark, sf_dir):
    """R66 + R32 + R21 over four levels: every 25th page submitted, of which every
    third was seen lately; the pages' own links, and links between pages (p to 2p+1,
    2p+2 and back to p-1, with a tracking parameter)."""
    pages = _scored_pages(spark, sf_dir)
    pid = F.col("page_id")
    marked = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), F.lit("&utm_source=l")).otherwise(F.lit("?utm_source=l")))
    target = pages.select(pid.alias("to"), marked.alias("link"))
    between = pages.select("page_id", F.explode(F.array(2 * pid + 1, 2 * pid + 2, pid - 1)).alias("to")).join(target, "to")
    links = crawl.page_links(pages).select("page_id", "link").unionByName(between.select("page_id", "link"))
    seen = pages.filter(pid % 75 == 0).select("url", F.lit("s").alias("scraper_uuid"), FX.plus_micros(F.lit(AS_OF), F.lit(-3 * 86_400_000_000)).alias("seen_at"))
    found = crawl.crawl(pages.filter(pid % 25 == 0), pages, links, seen, as_of=AS_OF, max_depth=3)
    return found.select("url_key", "depth", "outcome", "page_id")


def _new_urls(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    base = F.regexp_replace(F.col("url"), "#.*$", "")
    return pages.select(
        F.concat(base, F.when(base.contains("?"), F.lit("&utm_medium=mail")).otherwise(F.lit("?utm_medium=mail"))).alias("url")
    )


def _seen(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    return pages.select("url", F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("scraper_uuid"),
                        FX.fixture_time(F.col("page_id")).alias("seen_at"))


@register("seen_url_split")
def q_seen_url_split(spark, sf_dir):
    """New URLs (tracking variants of the pages) against URLs seen in the last 30 days."""
    out = crawl.seen_url_split(_new_urls(spark, sf_dir), _seen(spark, sf_dir), as_of=AS_OF)
    return out.select("url", "url_key", "cached", "cached_scraper_uuid")


@register("request_outcomes")
def q_request_outcomes(spark, sf_dir):
    """R39 (requests): outcome of each new URL: cached, accepted or error."""
    from folio.functions.urls import is_scrapable_url

    split = crawl.seen_url_split(_new_urls(spark, sf_dir), _seen(spark, sf_dir), as_of=AS_OF)
    outcome = F.when(F.col("cached"), F.lit("cached")).when(is_scrapable_url("url"), F.lit("accepted")).otherwise(F.lit("error"))
    return S.request_outcomes(split.select(outcome.alias("outcome")))


# ------------------------------------------------------------- merges
def _results(spark, sf_dir):
    return FX.analysis_results(spark, sf_dir)


def _merge_columns() -> list:
    return [
        "id", _tags().alias("tags"), "seo_enabled", fmt_ts("tombstone_at").alias("tombstone_at"),
        F.get_json_object("metadata", "$.tombstone_reason").alias("tombstone_reason"),
        F.get_json_object("metadata", "$.textanalyzer_status").alias("textanalyzer_status"),
    ]


def _merge_out(df: DataFrame) -> DataFrame:
    return df.select(*_merge_columns())


@register("apply_analysis")
def q_apply_analysis(spark, sf_dir):
    """R55 + R56: every completed result applied (no wait limit)."""
    merged = MG.apply_analysis(corpus_documents(spark, sf_dir), _results(spark, sf_dir), as_of=AS_OF)
    return merged.documents.select(
        "id", _tags().alias("tags"), "seo_enabled", fmt_ts("tombstone_at").alias("tombstone_at"),
        F.get_json_object("metadata", "$.tombstone_reason").alias("tombstone_reason"),
        F.get_json_object("metadata", "$.textanalyzer_status").alias("textanalyzer_status"),
        F.get_json_object("metadata", "$.quality_score.score").cast("double").alias("quality_score"),
    )


@register("enrich")
def q_enrich(spark, sf_dir):
    """R33 + R57: results applied only when they arrive within 60 minutes."""
    out = MG.enrich(corpus_documents(spark, sf_dir), _results(spark, sf_dir), as_of=AS_OF, max_wait_minutes=60)
    elapsed = F.get_json_object("metadata", "$.analysis_retrieval_elapsed_minutes").cast("long").alias("elapsed_minutes")
    return out.select(*_merge_columns(), "enrich_outcome", elapsed)


@register("analysis_timeout")
def q_analysis_timeout(spark, sf_dir):
    """R57 alone: documents still waiting more than 60 minutes at as_of."""
    out = MG.analysis_timeout(corpus_documents(spark, sf_dir), as_of=AS_OF)
    return out.select(
        "id",
        F.get_json_object("metadata", "$.textanalyzer_status").alias("textanalyzer_status"),
        F.get_json_object("metadata", "$.analysis_retrieval_elapsed_minutes").cast("long").alias("elapsed_minutes"),
    )


def _tag_changes(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("source_type") == "text") & (_k() % 11 == 0)).select(
        "id", F.concat(F.col("tags"), F.array(F.lit("spam"))).alias("tags")
    )


@register("replace_tags")
def q_replace_tags(spark, sf_dir):
    """Text documents with key % 11 = 0 get a 'spam' tag appended."""
    docs = corpus_documents(spark, sf_dir)
    merged = MG.replace_tags(docs, _tag_changes(docs), trigger_tags=TRIGGER_TAGS, period_days=90, as_of=AS_OF)
    return _merge_out(merged.documents).drop("textanalyzer_status")


@register("set_seo")
def q_set_seo(spark, sf_dir):
    """Url documents with key % 4 = 0 flip seo_enabled."""
    docs = corpus_documents(spark, sf_dir)
    ch = docs.filter((F.col("source_type") == "url") & (_k() % 4 == 0)).select("id", (~F.col("seo_enabled")).alias("seo_enabled"))
    return MG.set_seo(docs, ch).documents.select("id", "seo_enabled")


@register("set_metadata")
def q_set_metadata(spark, sf_dir):
    """Text documents with key % 13 = 0 get a new metadata document."""
    docs = corpus_documents(spark, sf_dir)
    ch = docs.filter((F.col("source_type") == "text") & (_k() % 13 == 0)).select(
        "id",
        F.to_json(F.struct(F.concat(F.lit("replaced "), F.col("id")).alias("note"),
                           F.lit("2024-01-25T00:00:00Z").alias("tombstone_datetime"))).alias("metadata"),
    )
    out = MG.set_metadata(docs, ch).documents
    return out.select("id", fmt_ts("tombstone_at").alias("tombstone_at"), F.get_json_object("metadata", "$.note").alias("note"))


@register("tombstone_manual")
def q_tombstone_manual(spark, sf_dir):
    """Url documents with key % 6 = 0 tombstoned, then key % 12 = 0 untombstoned."""
    docs = corpus_documents(spark, sf_dir)
    urls = docs.filter(F.col("source_type") == "url")
    t = MG.tombstone(docs, urls.filter(_k() % 6 == 0).select("id"), period_days=90, as_of=AS_OF).documents
    u = MG.untombstone(t, urls.filter(_k() % 12 == 0).select("id")).documents
    return u.select(
        "id", fmt_ts("tombstone_at").alias("tombstone_at"),
        F.get_json_object("metadata", "$.tombstone_datetime").alias("tombstone_datetime"),
    )


@register("merge_on_read")
def q_merge_on_read(spark, sf_dir):
    """R61-R64 and R34 as a change log over a base, read after a compaction and
    further changes."""
    docs = corpus_documents(spark, sf_dir)
    folder = scratch_path(spark, "document-log")
    log = DocumentLog(spark, folder.rsplit("/", 1)[-1].replace("-", "_"), folder, buckets=16).create(docs)
    text, url, k = F.col("source_type") == "text", F.col("source_type") == "url", _k()
    log.replace_tags(_tag_changes(docs), seq=1, trigger_tags=TRIGGER_TAGS, as_of=AS_OF)
    log.set_seo(docs.filter(url & (k % 4 == 0)).select("id", (~F.col("seo_enabled")).alias("seo_enabled")), seq=2)
    log.tombstone(docs.filter(url & (k % 6 == 0)), seq=3, as_of=AS_OF)
    note = F.to_json(F.struct(F.concat(F.lit("replaced "), F.col("id")).alias("note"), F.lit("2024-01-25T00:00:00Z").alias("tombstone_datetime")))
    log.set_metadata(docs.filter(text & (k % 13 == 0)).select("id", note.alias("metadata")), seq=4)
    after = log.compact()
    after.untombstone(docs.filter(url & (k % 12 == 0)), seq=5)
    after.delete(docs.filter(text & (k % 9 == 0)), seq=6)
    return after.read().select(
        "id", _tags().alias("tags"), "seo_enabled", fmt_ts("tombstone_at").alias("tombstone_at"),
        F.get_json_object("metadata", "$.tombstone_datetime").isNotNull().alias("has_datetime"),
        F.get_json_object("metadata", "$.tombstone_reason").alias("tombstone_reason"),
        F.get_json_object("metadata", "$.note").alias("note"),
    )


@register("delete_documents")
def q_delete_documents(spark, sf_dir):
    """Text documents with key % 9 = 0 deleted; jobs lose a result that is gone."""
    docs = corpus_documents(spark, sf_dir)
    jobs = FX.crawl_jobs(spark, sf_dir)
    ids = docs.filter((F.col("source_type") == "text") & (_k() % 9 == 0)).select("id")
    res = MG.delete_documents(docs, jobs, ids)
    return res.jobs.select("id", "result_request_id")


@register("tombstone_report")
def q_tombstone_report(spark, sf_dir):
    """Tombstones created by the low-score gate, tag triggers and manual requests."""
    docs = corpus_documents(spark, sf_dir)
    scored = crawl.gate(_scored_pages(spark, sf_dir).drop("html"), 0.5)
    low = scored.filter(F.col("decision") == "rejected").select(
        F.lit("low-score").alias("reason"), F.lit("none").alias("tag"), F.lit(30).alias("period_days")
    )
    ch = _tag_changes(docs)
    fired = ch.select(first_trigger_tag("tags", list(TRIGGER_TAGS)).alias("tag")).filter(F.col("tag").isNotNull())
    tag_based = fired.select(F.lit("tag-based").alias("reason"), "tag", F.lit(90).alias("period_days"))
    manual = docs.filter((F.col("source_type") == "url") & (_k() % 6 == 0)).select(
        F.lit("manual").alias("reason"), F.lit("none").alias("tag"), F.lit(90).alias("period_days")
    )
    return S.tombstone_report(low.unionByName(tag_based).unionByName(manual))


# ------------------------------------------------------------- jobs
def _jobs(spark, sf_dir):
    return FX.crawl_jobs(spark, sf_dir)


@register("jobs_with_children")
def q_jobs_with_children(spark, sf_dir):
    """First page of top-level jobs with their direct children."""
    out = J.jobs_with_children(_jobs(spark, sf_dir), limit=50)
    return out.select(
        "parent_id", fmt_ts("parent_created_at").alias("parent_created_at"), "child_id",
        fmt_ts("child_created_at").alias("child_created_at"), "child_status",
    )


@register("child_jobs")
def q_child_jobs(spark, sf_dir):
    """Children of the failed depth-1 jobs."""
    jobs = _jobs(spark, sf_dir)
    parents = jobs.filter((F.col("depth") == 1) & (F.col("status") == "failed")).select("id")
    return J.child_jobs(jobs, parents).select("id", "parent_job_id", fmt_ts("created_at").alias("created_at"))


@register("job_descendants")
def q_job_descendants(spark, sf_dir):
    """Subtrees under the odd-numbered top-level jobs."""
    jobs = _jobs(spark, sf_dir)
    roots = jobs.filter(F.col("parent_job_id").isNull() & (F.col("id").cast("long") % 2 == 1)).select("id")
    return J.job_descendants(jobs, roots)


@register("delete_jobs")
def q_delete_jobs(spark, sf_dir):
    """Depth-1 jobs with key % 7 = 0 deleted with their subtrees."""
    jobs = _jobs(spark, sf_dir)
    ids = jobs.filter((F.col("depth") == 1) & (F.col("id").cast("long") % 7 == 0)).select("id")
    return J.delete_jobs(jobs, ids).select("id")


@register("jobs_with_results")
def q_jobs_with_results(spark, sf_dir):
    """R30."""
    out = J.jobs_with_results(_jobs(spark, sf_dir), corpus_documents(spark, sf_dir))
    return out.select("id", "result_request_id", "result_found", "result_source_type")


@register("apply_job_events")
def q_apply_job_events(spark, sf_dir):
    """User events folded into the jobs with the same id."""
    out = J.apply_job_events(_jobs(spark, sf_dir), FX.job_events(spark, sf_dir))
    return out.select(
        "id", "status", "retries", fmt_ts("completed_at").alias("completed_at"), "error_message",
        "result_request_id", fmt_ts("updated_at").alias("updated_at"),
    )


@register("retryable_jobs")
def q_retryable_jobs(spark, sf_dir):
    """R23 (retry subset)."""
    return J.retryable_jobs(_jobs(spark, sf_dir)).select("id", "retries")


@register("get_jobs")
def q_get_jobs(spark, sf_dir):
    """R23 (lookup): customer keys looked up as job ids."""
    ids = load_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    out = J.get_jobs(_jobs(spark, sf_dir), ids)
    return out.select("requested_id", "found", "status")


def _tracked(spark, sf_dir):
    conv = load_table(spark, sf_dir, "conversations")
    created = FX.fixture_time(F.col("conv_id"))
    return conv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.lit("text").alias("source_type"),
        created.alias("created_at"),
        FX.plus_micros(created, F.lit(86_400_000_000)).alias("expires_at"),
    )


@register("unexpired")
def q_unexpired(spark, sf_dir):
    """Tracked text requests still alive at as_of."""
    return J.unexpired(_tracked(spark, sf_dir), as_of=AS_OF).select("id", fmt_ts("expires_at").alias("expires_at"))


@register("lookup_requests")
def q_lookup_requests(spark, sf_dir):
    """R23 union: conversation keys looked up among tracked requests, then jobs."""
    conv = load_table(spark, sf_dir, "conversations")
    ids = conv.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id")).unionByName(
        conv.select(F.col("conv_id").cast("string").alias("id"))
    ).distinct()
    return J.lookup_requests(_tracked(spark, sf_dir), _jobs(spark, sf_dir), ids).select("id", "kind")


# ------------------------------------------------------------- images / publish
def _images(spark, sf_dir):
    return FX.images_fixture(spark, sf_dir)


@register("document_images")
def q_document_images(spark, sf_dir):
    """R31."""
    return I.document_images(corpus_documents(spark, sf_dir), _images(spark, sf_dir)).select("document_id", "image_id", "slug")


@register("best_images")
def q_best_images(spark, sf_dir):
    """R54 (table form)."""
    return I.best_images(corpus_documents(spark, sf_dir), _images(spark, sf_dir))


@register("image_sitemap_entries")
def q_image_sitemap_entries(spark, sf_dir):
    """R07."""
    out = I.image_sitemap_entries(_images(spark, sf_dir), BASE_URL)
    return out.select(
        "slug", "loc", F.size("images").alias("n_images"),
        F.array_join(F.transform("images", lambda i: i["loc"]), "|").alias("image_locs"),
        F.array_join(F.transform("images", lambda i: F.coalesce(i["title"], F.lit(""))), "|").alias("titles"),
    )


@register("search_images")
def q_search_images(spark, sf_dir):
    """R79."""
    return I.search_images(_images(spark, sf_dir), ["RED", "wid"]).select("id", _tags().alias("tags"))


@register("image_updates")
def q_image_updates(spark, sf_dir):
    """Every tenth part gets one change, cycling through the four actions."""
    imgs = _images(spark, sf_dir)
    part = load_table(spark, sf_dir, "part").filter(F.col("p_partkey") % 10 == 0)
    actions = F.element_at(F.array(*[F.lit(a) for a in ("replace_tags", "tombstone", "untombstone", "delete")]),
                           (F.floor(F.col("p_partkey") / 10) % 4 + 1).cast("int"))
    ch = part.select(F.col("p_partkey").cast("string").alias("id"), actions.alias("action"), F.array(F.col("p_brand")).alias("tags"))
    out, _ = I.image_updates(imgs, ch, as_of=AS_OF, period_days=30)
    return out.select("id", _tags().alias("tags"), fmt_ts("tombstone_datetime").alias("tombstone_datetime"))


@register("sitemap_entries")
def q_sitemap_entries(spark, sf_dir):
    """R06."""
    return P.sitemap_entries(corpus_documents(spark, sf_dir), BASE_URL, as_of=AS_OF).select(
        "loc", "lastmod", "changefreq", "priority"
    )


@register("article_export")
def q_article_export(spark, sf_dir):
    """R74 + R75 + R76: published documents with body HTML and JSON-LD."""
    docs = corpus_documents(spark, sf_dir)
    best = I.best_images(docs, _images(spark, sf_dir))
    out = P.article_export(docs, BASE_URL, IMAGE_BASE_URL, best)
    return out.select(
        "id", "title", "canonical_url", "image_url", F.md5("body_html").alias("body_md5"),
        F.get_json_object("jsonld", "$.headline").alias("ld_headline"),
        F.get_json_object("jsonld", "$.datePublished").alias("ld_published"),
        F.get_json_object("jsonld", "$.image[0]").alias("ld_image"),
        F.get_json_object("jsonld", "$.keywords[0]").alias("ld_first_keyword"),
    )


# ------------------------------------------------------------- streaming


@register("enrich_stream")
def q_enrich_stream(spark, sf_dir):
    """Documents and analysis results as two streams, joined within the wait;
    one answer per document inside the stream."""
    docs = stream_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("job_id"),
        FX.fixture_time(F.col("doc_id")).alias("created_at"),
    )
    labels = load_table(spark, sf_dir, "labels")
    raw = stream_table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    did = F.col("doc_id")
    score = FX.text_score(F.col("quality"), F.col("toxic"))
    results = raw.select(
        F.concat(F.lit("a"), did.cast("string")).alias("job_id"),
        F.when(did % 4 != 0, F.lit("completed")).otherwise(F.lit("processing")).alias("status"),
        F.to_json(F.struct(F.when(score.isNotNull(), F.struct(score.alias("score"))).alias("quality_score"))).alias("analysis"),
        FX.plus_micros(FX.fixture_time(did), (did % 120) * 60_000_000).alias("arrived_at"),
    )
    docs, close_docs = ST.closing_mark(docs, "created_at", "id")
    results, close_results = ST.closing_mark(results, "arrived_at", "job_id", status="completed")
    # event times are in no order over a month: the delay covers that
    out = ST.run_available(ST.enrich_once(docs, results, delay="40 days"), "enrich_stream", closing=(close_docs, close_results))
    answers = spark.read.schema(ST.ENRICHED).parquet(out)
    return answers.select("id", "job_id", fmt_ts("created_at").alias("created_at"), "outcome", "elapsed_minutes")


@register("dedupe_url_stream")
def q_dedupe_url_stream(spark, sf_dir):
    """Extracted links as a stream, once per normalised URL."""
    pages = stream_table(spark, sf_dir, "pages")
    links = crawl.page_links(pages).select(
        F.col("link").alias("url"), FX.fixture_time(F.col("page_id")).alias("seen_at")
    )
    out = ST.run_available(ST.dedupe_url_stream(links, ttl="40 days"), "dedupe_url_stream")
    return spark.read.parquet(out).select("url_key")


@register("scrape_stream")
def q_scrape_stream(spark, sf_dir):
    """R71 with renewal: links of every fourth page are scraped as children (and
    renew their key), all others are submitted; TTL of five days."""
    links = crawl.page_links(stream_table(spark, sf_dir, "pages")).select(
        F.col("link").alias("url"), FX.fixture_time(F.col("page_id")).alias("seen_at"), (F.col("page_id") % 4 == 0).alias("child")
    )
    out = ST.run_available(ST.scrape_stream(links, ttl="5 days", delay="40 days"), "scrape_stream")
    return spark.read.parquet(out).select("url_key", "child", fmt_ts("seen_at").alias("seen_at"))


def _lifecycle(df: DataFrame) -> DataFrame:
    statuses = F.array(*[F.lit(s) for s in ST.LIFECYCLE_STATUSES])
    return df.select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("request_id"),
        F.element_at(statuses, (F.col("event_id") % len(ST.LIFECYCLE_STATUSES) + 1).cast("int")).alias("status"),
        F.col("event_type").alias("stage"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
    )


@register("status_feed")
def q_status_feed(spark, sf_dir):
    """Lifecycle events of watched documents and their latest status."""
    events = _lifecycle(stream_table(spark, sf_dir, "events"))
    watched = load_table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == 0).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id")
    )
    feed = ST.status_feed(events, watched)
    out = ST.run_available(ST.latest_status(feed), "status_feed", mode="update")
    # each micro-batch wrote the documents it changed; the last one counts
    rows = F.struct("batch_id", "status", "last_event_at", "events")
    last = spark.read.parquet(out).groupBy("request_id").agg(F.max(rows).alias("s"))
    return last.select("request_id", "s.status", fmt_ts("s.last_event_at").alias("last_event_at"), "s.events")


@register("status_feed_bounded")
def q_status_feed_bounded(spark, sf_dir):
    """R72 with state that ends: the latest status of the watched documents, whose
    state goes a week after their terminal event."""
    events = _lifecycle(stream_table(spark, sf_dir, "events"))
    watched = load_table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == 0).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id")
    )
    feed = ST.latest_status_bounded(ST.status_feed(events, watched), delay="40 days")
    out = ST.run_available(feed, "status_feed_bounded", mode="update")
    rows = F.struct("batch_id", "status", "last_event_at", "events")
    last = spark.read.parquet(out).groupBy("request_id").agg(F.max(rows).alias("s"))
    return last.select("request_id", "s.status", fmt_ts("s.last_event_at").alias("last_event_at"), "s.events")


@register("queue_waits_bounded")
def q_queue_waits_bounded(spark, sf_dir):
    """R73 (wait) with state that ends a week after a job was taken up."""
    ev = stream_table(spark, sf_dir, "events")
    mapping = F.create_map(*[F.lit(x) for pair in FX.EVENT_STATUS for x in pair])
    job_events = ev.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts"), F.element_at(mapping, F.col("event_type")).alias("event")
    )
    out = ST.run_available(ST.queue_waits_bounded(job_events, delay="40 days"), "queue_waits_bounded", mode="update")
    latest = spark.read.parquet(out).groupBy("job_id").agg(F.max(F.struct("batch_id", "queued_at", "processing_at", "wait_seconds")).alias("w"))
    return latest.select(
        "job_id", fmt_ts("w.queued_at").alias("queued_at"), fmt_ts("w.processing_at").alias("processing_at"),
        F.round("w.wait_seconds", 6).alias("wait_seconds"),
    )


def _snapshot(spark, sf_dir):
    """Documents and jobs as the tables are now."""
    forget_plans()
    return corpus_documents(spark, sf_dir), FX.crawl_jobs(spark, sf_dir)


@register("live_metrics")
def q_live_metrics(spark, sf_dir):
    """Queue wait per job from the job-event stream, refreshed per beat
    together with the document and job figures."""
    from folio.session import scratch_path

    ev = stream_table(spark, sf_dir, "events")
    mapping = F.create_map(*[F.lit(x) for pair in FX.EVENT_STATUS for x in pair])
    job_events = ev.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts"), F.element_at(mapping, F.col("event_type")).alias("event")
    )
    base = scratch_path(spark, "live_metrics")
    q = ST.live_metrics(
        job_events,
        lambda: _snapshot(spark, sf_dir),
        f"{base}/out",
        as_of=AS_OF,
        checkpoint=f"{base}/checkpoint",
        available_now=True,
    )
    q.awaitTermination()
    waits = spark.read.parquet(f"{base}/out/waits")
    latest = waits.groupBy("job_id").agg(F.max(F.struct("batch_id", "queued_at", "processing_at", "wait_seconds")).alias("w"))
    return latest.select(
        "job_id", fmt_ts("w.queued_at").alias("queued_at"), fmt_ts("w.processing_at").alias("processing_at"),
        F.round("w.wait_seconds", 6).alias("wait_seconds"),
    )


# ------------------------------------------------------------- storage


@register("ingest_read_documents")
def q_ingest_read_documents(spark, sf_dir):
    """R02 then R01: the corpus written as a month-partitioned table in the
    shared folder and read back with the fixed schema."""
    from folio.session import scratch_path

    path = scratch_path(spark, "documents-table")
    SD.ingest_documents(corpus_documents(spark, sf_dir), path, batch_id="corpus")
    back = SD.read_ingested(spark, path)
    return back.select(
        "id", fmt_ts("effective_date").alias("effective_date"), fmt_ts("tombstone_at").alias("tombstone_at"),
        _tags().alias("tags"), "seo_enabled", "slug",
    )


@register("ingest_second_batch")
def q_ingest_second_batch(spark, sf_dir):
    """R02 + R77 on insert: a first batch of two thirds of the corpus, then a
    second one that repeats some of its ids, clashes with its slugs and has rows
    without an id. What became of every row of the second."""
    from folio.session import scratch_path

    path = scratch_path(spark, "documents-batches")
    docs = corpus_documents(spark, sf_dir)
    SD.ingest_documents(docs.filter(_k() % 3 != 0), path, batch_id="first", unique_slugs=True)
    second = docs.filter(_k() % 2 == 0).withColumn("id", F.when(_k() % 10 != 0, F.col("id")))
    done = SD.ingest_documents(second, path, batch_id="second", unique_slugs=True)
    none = F.lit(None).cast("string")
    parts = (
        (done.documents, "stored", none, none), (done.duplicates, "duplicate", F.col("kept_in"), none),
        (done.conflicts, "conflict", none, F.col("kept_id")), (done.rejected, "rejected", none, none),
    )
    rows = [
        df.select("id", "slug", fmt_ts("created_at").alias("created_at"), F.lit(outcome).alias("outcome"), kept_in.alias("kept_in"), kept_id.alias("kept_id"))
        for df, outcome, kept_in, kept_id in parts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@register("backfill_effective_date")
def q_backfill_effective_date(spark, sf_dir):
    """Documents with an even key lose effective_date; the backfill
    restores it from the metadata paths, else created_at."""
    docs = corpus_documents(spark, sf_dir)
    blanked = docs.withColumn(
        "effective_date", F.when(_k() % 2 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("effective_date"))
    )
    return SD.backfill_effective_date(blanked).select("id", fmt_ts("effective_date").alias("effective_date"))


@register("image_jsonld")
def q_image_jsonld(spark, sf_dir):
    """R76 (image and breadcrumb forms) for every image."""
    imgs = _images(spark, sf_dir)
    part = load_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size")
    j = imgs.join(part, "id")
    crumbs = F.array(
        F.struct(F.lit(1).alias("position"), F.lit("Images").alias("name"), F.lit(f"{BASE_URL}/images").alias("item")),
        F.struct(F.lit(2).alias("position"), F.col("alt_text").alias("name"), F.lit("").alias("item")),
    )
    return j.select(
        "id",
        P.image_object_jsonld(F.col("url"), F.col("summary"), F.col("alt_text"), F.col("p_size"), F.lit(0)).alias("image_ld"),
        P.breadcrumb_jsonld(crumbs).alias("breadcrumb_ld"),
    )


@register("status_feed_events")
def q_status_feed_events(spark, sf_dir):
    """R72 (feed): every lifecycle event of the watched documents, as a stream."""
    events = _lifecycle(stream_table(spark, sf_dir, "events"))
    watched = load_table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == 0).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id")
    )
    out = ST.run_available(ST.status_feed(events, watched), "status_feed_events", order=("ts", "seq"))
    return spark.read.parquet(out).select("request_id", "status", "stage", "message", fmt_ts("ts").alias("ts"), "seq")


@register("live_metrics_figures")
def q_live_metrics_figures(spark, sf_dir):
    """R73 (figures): document statistics and job status counts written by
    the last beat of the metrics stream."""
    from folio.session import scratch_path

    ev = stream_table(spark, sf_dir, "events")
    mapping = F.create_map(*[F.lit(x) for pair in FX.EVENT_STATUS for x in pair])
    job_events = ev.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts"), F.element_at(mapping, F.col("event_type")).alias("event")
    )
    base = scratch_path(spark, "live_metrics_figures")
    q = ST.live_metrics(
        job_events,
        lambda: _snapshot(spark, sf_dir),
        f"{base}/out",
        as_of=AS_OF,
        checkpoint=f"{base}/checkpoint",
        available_now=True,
    )
    q.awaitTermination()
    figures = spark.read.parquet(f"{base}/out/figures")
    last = figures.agg(F.max("batch_id").alias("b"))
    return figures.join(last, figures["batch_id"] == last["b"], "left_semi").select("metric", "key", "value")
