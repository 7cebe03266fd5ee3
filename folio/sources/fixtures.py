"""Corpus relations derived from the driver's tables (FIXTURES.md §3).

Every derivation is integer arithmetic over the source keys, so a SQL engine
can reproduce it exactly; the oracles in ``folio.plans.oracles`` do.

D1 documents   pages (url branch) + documents/labels (text branch)
D2 timeline    events as tagged documents
D3 jobs        orders as a 10-ary crawl tree
D4 images      part
D5 links       pages.html through ``page_links``
D6 job events  events by user
D7 results     analysis results for the text documents
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.common import rfc3339
from folio.functions.dates import effective_date
from folio.functions.tags import assemble_tags, empty_tags
from folio.functions.text import slug_source, slugify, slugify_or
from folio.sources.tables import load_table, per_session

# Fixed values of the fixture rules.
BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z
AS_OF = _dt.datetime(2024, 1, 20, tzinfo=_dt.timezone.utc)
CATEGORIES = (
    ("technical", "education"),
    ("social_media",),
    ("machine-learning-model",),
    ("image", "media"),
    ("news",),
)

DOC_COLUMNS = (
    "id", "created_at", "effective_date", "source_type", "source_url", "scraper_uuid",
    "textanalyzer_uuid", "tags", "metadata", "slug", "seo_enabled", "tombstone_at",
)


def fixture_time(x: Column) -> Column:
    """M(x) minutes after 2024-01-01: (x * 7919) % 43200."""
    return F.timestamp_seconds(F.lit(BASE_EPOCH) + F.lit(60) * ((x * 7919) % 43200))


def plus_micros(ts: Column, us: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + us)


def _tombstone_text(key: Column, created: Column) -> Column:
    hours = (key % 72).cast("long")
    return F.when(key % 7 == 0, rfc3339(plus_micros(created, hours * 3_600_000_000)))


def _categories(key: Column) -> Column:
    table = F.array(*[F.array(*[F.lit(c) for c in cats]) for cats in CATEGORIES])
    return F.element_at(table, (key % 5 + 1).cast("int"))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def page_content(html: Column) -> Column:
    """Visible text of a page, one blank-line separated piece per text node."""
    s = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", "")
    s = F.regexp_replace(s, r"(?s)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(s, r"<[^>]*>", "\n\n")


def gate_score(page_id: Column) -> Column:
    return ((page_id * 37) % 100).cast("double") / 100.0


def url_documents(pages: DataFrame) -> DataFrame:
    """D1 url branch: one scraped document per page."""
    pid = F.col("page_id")
    created = fixture_time(pid)
    score = gate_score(pid)
    cats = _categories(pid)
    publish = F.when(pid % 3 == 0, rfc3339(plus_micros(created, F.lit(-10 * 86_400_000_000))))
    metadata = F.to_json(
        F.struct(
            F.struct(
                page_title(F.col("html")).alias("title"),
                page_content(F.col("html")).alias("content"),
                F.col("url").alias("url"),
                publish.alias("publish_date"),
            ).alias("scraper_metadata"),
            F.struct(
                score.alias("score"),
                F.lit("fixture").alias("reason"),
                cats.alias("categories"),
                (score >= 0.5).alias("is_recommended"),
                empty_tags().alias("malicious_indicators"),
            ).alias("link_score"),
            _tombstone_text(pid, created).alias("tombstone_datetime"),
        )
    )
    # promoted columns from the same values the metadata holds, so that
    # queries not reading metadata never build or scan it (R40 runs on a
    # small document with just the date paths)
    tomb_text = _tombstone_text(pid, created)
    date_doc = F.to_json(F.struct(F.struct(publish.alias("publish_date")).alias("scraper_metadata")))
    return pages.select(
        F.concat(F.lit("p"), pid.cast("string")).alias("id"),
        created.alias("created_at"),
        effective_date(date_doc, created).alias("effective_date"),
        F.lit("url").alias("source_type"),
        F.col("url").alias("source_url"),
        F.concat(F.lit("s"), pid.cast("string")).alias("scraper_uuid"),
        F.lit("").alias("textanalyzer_uuid"),
        assemble_tags(cats, F.col("url")).alias("tags"),
        metadata.alias("metadata"),
        slugify(F.concat(F.lit("page "), pid.cast("string"))).alias("slug"),
        (pid % 10 != 0).alias("seo_enabled"),
        tomb_text.cast("timestamp").alias("tombstone_at"),
    )


def text_score(quality: Column, toxic: Column) -> Column:
    return (
        F.when(toxic == 1, F.lit(0.2))
        .when(quality == 0, F.lit(0.3))
        .when(quality == 1, F.lit(0.8))
    )


@per_session
def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def text_documents_fixture(texts: DataFrame) -> DataFrame:
    """D1 text branch. Documents with doc_id % 50 = 1 take their slug from
    document 1's text, which yields slug clashes on purpose."""
    did = F.col("doc_id")
    created = fixture_time(did)
    # slug source of document 1 as a scalar subquery: one value (the min over
    # however many copies of that id exist), computed once and shared by
    # every row, with no join
    first = texts.filter(did == 1).select(F.min(slug_source(F.lit(None).cast("string"), F.col("text")))).scalar()
    src = F.when(did % 50 == 1, first).otherwise(slug_source(F.lit(None).cast("string"), F.col("text")))
    tags = F.concat(
        F.array(F.col("lang"), F.col("source")),
        F.when(F.col("quality") == 0, F.array(F.lit("low-quality"))).otherwise(empty_tags()),
    )
    metadata = F.to_json(
        F.struct(
            F.col("text").alias("original_text"),
            F.concat(F.lit("a"), did.cast("string")).alias("textanalyzer_job_id"),
            F.lit("queued").alias("textanalyzer_status"),
            _tombstone_text(did, created).alias("tombstone_datetime"),
        )
    )
    return texts.select(
        F.concat(F.lit("d"), did.cast("string")).alias("id"),
        created.alias("created_at"),
        created.alias("effective_date"),  # text documents carry no publication date
        F.lit("text").alias("source_type"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("scraper_uuid"),
        F.concat(F.lit("a"), did.cast("string")).alias("textanalyzer_uuid"),
        tags.alias("tags"),
        metadata.alias("metadata"),
        slugify_or(src, F.concat(F.lit("d"), did.cast("string"))).alias("slug"),
        (did % 10 != 0).alias("seo_enabled"),
        _tombstone_text(did, created).cast("timestamp").alias("tombstone_at"),
    )


@per_session
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document corpus (url + text branches)."""
    pages = load_table(spark, sf_dir, "pages")
    url_docs = url_documents(pages)
    text_docs = text_documents_fixture(labelled_texts(spark, sf_dir))
    return url_docs.unionByName(text_docs).select(*DOC_COLUMNS)


@per_session
def timeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents tagged (event_type, 'u' || user_id % 20)."""
    ev = load_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("effective_date"),
        F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"))).alias("tags"),
        F.lit(True).alias("seo_enabled"),
        F.lit(None).cast("timestamp").alias("tombstone_at"),
    )


JOB_STATUS = {"O": "queued", "P": "processing"}


@per_session
def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: orders as a 10-ary job tree (parent = key div 10 for keys >= 10)."""
    o = load_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "O", F.lit("queued"))
        .when(F.col("o_orderstatus") == "P", F.lit("processing"))
        .when(key % 3 == 0, F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    created = F.col("o_orderdate")
    return o.select(
        key.cast("string").alias("id"),
        F.concat(F.lit("http://h"), (key % 97).cast("string"), F.lit(".example.com/"), key.cast("string")).alias("url"),
        (key % 2 == 0).alias("extract_links"),
        status.alias("status"),
        F.lit(0).alias("retries"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(status.isin("completed", "failed"), created).alias("completed_at"),
        F.when(status == "failed", F.lit("fixture failure")).alias("error_message"),
        F.when(status == "completed", F.concat(F.lit("d"), (key % 1000).cast("string"))).alias("result_request_id"),
        F.lit(None).cast("string").alias("asynq_task_id"),
        F.when(key >= 10, F.floor(key / 10).cast("long").cast("string")).alias("parent_job_id"),
        (F.length(key.cast("string")) - 1).alias("depth"),
    )


@per_session
def images_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as images."""
    p = load_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.cast("string").alias("id"),
        F.concat(F.lit("http://img.example.com/"), key.cast("string"), F.lit(".png")).alias("url"),
        F.col("p_name").alias("alt_text"),
        F.col("p_type").alias("summary"),
        F.split(F.col("p_name"), " ").alias("tags"),
        F.concat(F.lit("s"), (key % 250).cast("string")).alias("scraper_uuid"),
        F.lit(None).cast("timestamp").alias("tombstone_datetime"),
        F.lit(None).cast("string").alias("file_path"),
        F.when(key % 9 != 0, F.concat(F.lit("img-"), key.cast("string"))).alias("slug"),
        (F.col("p_size").cast("double") / 50.0).alias("relevance_score"),
    )


# Event type -> job status event.
EVENT_STATUS = (
    ("signup", "queued"),
    ("view", "processing"),
    ("purchase", "completed"),
    ("error", "failed"),
    ("click", "retry"),
)


@per_session
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user as job status events (job id = user id)."""
    ev = load_table(spark, sf_dir, "events")
    mapping = F.create_map(*[F.lit(x) for pair in EVENT_STATUS for x in pair])
    return ev.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        F.element_at(mapping, F.col("event_type")).alias("event"),
        F.concat(F.lit("d"), (F.col("event_id") % 1000).cast("string")).alias("result_request_id"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
    )


@per_session
def analysis_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis result per text document."""
    t = labelled_texts(spark, sf_dir)
    did = F.col("doc_id")
    created = fixture_time(did)
    score = text_score(F.col("quality"), F.col("toxic"))
    tags = F.array(F.upper(F.col("lang")), F.concat(F.lit("topic-"), (did % 13).cast("string")))
    cleaned = F.when(did % 2 == 0, F.regexp_extract(F.col("text"), r"^[^\n]*", 0))
    analysis = F.to_json(
        F.struct(
            tags.alias("tags"),
            F.concat(F.col("lang"), F.lit(" synopsis "), did.cast("string")).alias("synopsis"),
            cleaned.alias("cleaned_text"),
            F.when(score.isNotNull(), F.struct(score.alias("score"))).alias("quality_score"),
        )
    )
    return t.select(
        F.concat(F.lit("a"), did.cast("string")).alias("job_id"),
        F.concat(F.lit("d"), did.cast("string")).alias("request_id"),
        F.when(did % 4 != 0, F.lit("completed")).otherwise(F.lit("processing")).alias("status"),
        analysis.alias("analysis"),
        created.alias("enqueued_at"),
        plus_micros(created, (did % 120) * 60_000_000).alias("arrived_at"),
    )
