"""Read-side document operators.

Document ids are the primary key: every operator relies on one row per id
(``ingest_documents`` sets repeated ids aside), which is what lets tag search skip a DISTINCT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.common import ts_lit
from folio.functions.visibility import has_any_tag, is_live


def explode_tags(documents: DataFrame) -> DataFrame:
    """One (request_id, tag) row per tag occurrence, duplicates kept."""
    return documents.select(F.col("id").alias("request_id"), F.explode("tags").alias("tag"))


def visible(documents: DataFrame, as_of) -> DataFrame:
    """Seo enabled and live at ``as_of``."""
    return documents.filter(F.col("seo_enabled") & is_live("tombstone_at", as_of))


def documents_with_any_tag(documents: DataFrame, tags, fuzzy: bool = False) -> DataFrame:
    """Documents having any of the tags — an array predicate, no join and
    no DISTINCT over wide rows."""
    return documents.filter(has_any_tag("tags", tags, fuzzy))


def search_by_tags(documents: DataFrame, tags, fuzzy: bool = False) -> DataFrame:
    """Ids of documents having any of the tags, sorted; no visibility
    filter; an empty tag list gives no rows."""
    return documents_with_any_tag(documents, tags, fuzzy).select("id").orderBy("id")


def _page(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    ordered = df.orderBy(F.col("effective_date").desc(), F.col("id").asc())
    if offset:
        ordered = ordered.offset(int(offset))
    if limit is not None and limit > 0:
        ordered = ordered.limit(int(limit))
    return ordered


def filter_documents(
    documents: DataFrame,
    *,
    as_of,
    tags=None,
    fuzzy: bool = False,
    date_start=None,
    date_end=None,
    source_type: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """Visible documents matching every given criterion, newest first.

    ``limit <= 0`` means no limit. ``after=(effective_date, id)`` pages by key
    instead of by offset, which stays cheap for deep pages.
    """
    df = visible(documents, as_of)
    if date_start is not None:
        df = df.filter(F.col("effective_date") >= ts_lit(date_start))
    if date_end is not None:
        df = df.filter(F.col("effective_date") <= ts_lit(date_end))
    if source_type:
        df = df.filter(F.col("source_type") == source_type)
    if tags:
        df = documents_with_any_tag(df, tags, fuzzy)
    if after is not None:
        eff, last_id = after
        e = ts_lit(eff)
        df = df.filter((F.col("effective_date") < e) | ((F.col("effective_date") == e) & (F.col("id") > last_id)))
    return _page(df, limit, offset)


def list_documents(documents: DataFrame, *, as_of, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Visible documents, newest first, one page."""
    return filter_documents(documents, as_of=as_of, limit=limit, offset=offset)


#: Driver-side key lists up to this length become a pushed-down IN filter.
LIST_LIMIT = 10_000


def keyed_rows(table: DataFrame, column: str, keys) -> tuple[DataFrame, DataFrame]:
    """(requested keys, rows of ``table`` having one of them). A short list is
    an IN filter, which reaches the scan, so only matching rows are joined
    afterwards. A long list or a table of keys is semi-joined; Spark broadcasts
    the keys if their measured size allows."""
    spark = table.sparkSession
    if isinstance(keys, DataFrame):
        frame = keys.select(F.col(keys.columns[0]).alias("requested"))
    else:
        keys = list(keys)
        frame = spark.createDataFrame([(k,) for k in keys], "requested string")
        if len(keys) <= LIST_LIMIT:
            return frame, table.filter(F.col(column).isin([k for k in keys if k is not None]))
    wanted = frame.select(F.col("requested").alias(column)).distinct()
    return frame, table.join(wanted, column, "left_semi")


def found_keys(keys: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The distinct ``keys`` (one column) that ``table`` has in ``column``. The
    table is the streamed side: a few keys are broadcast to it and only its
    matching rows are shuffled."""
    key = keys.columns[0]
    return table.select(F.col(column).alias(key)).join(keys.select(key).distinct(), key, "left_semi").distinct()


def unmatched(keys: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Rows of ``keys`` (its first column) that ``table`` has not in ``column``: the
    reference's "not found". The keys found come first, since an anti-join of the
    keys with the table itself would shuffle every row of the table."""
    key = keys.columns[0]
    return keys.join(found_keys(keys, table, column), key, "left_anti")


def get_documents(documents: DataFrame, ids) -> DataFrame:
    """Lookup by id; every requested id comes back, with ``found``."""
    keys, hits = keyed_rows(documents, "id", ids)
    out = keys.withColumnRenamed("requested", "requested_id").join(hits, F.col("requested_id") == hits["id"], "left")
    return out.withColumn("found", F.col("id").isNotNull())


def get_by_slug(documents: DataFrame, slugs, published_only: bool = False) -> DataFrame:
    """Lookup by slug; with ``published_only`` also requires seo_enabled
    (but not liveness, as in the reference)."""
    docs = documents.filter(F.col("slug").isNotNull())
    if published_only:
        docs = docs.filter(F.col("seo_enabled"))
    keys, hits = keyed_rows(docs, "slug", slugs)
    out = keys.withColumnRenamed("requested", "requested_slug").join(hits, F.col("requested_slug") == hits["slug"], "left")
    return out.withColumn("found", F.col("id").isNotNull())


def slug_conflicts(documents: DataFrame) -> DataFrame:
    """Rows that would break slug uniqueness. Per slug the first row by
    (created_at, id) is kept; all later rows are reported with the kept id.

    Aggregation (partial, map-side) finds the keeper, so a slug shared by a
    huge share of rows never lands in a single task as a window would.
    """
    with_slug = documents.filter(F.col("slug").isNotNull())
    keepers = with_slug.groupBy("slug").agg(
        F.min(F.struct("created_at", "id"))["id"].alias("kept_id")
    )
    return (
        with_slug.join(keepers, "slug")
        .filter(F.col("id") != F.col("kept_id"))
        .select("id", "slug", "created_at", "kept_id")
    )
