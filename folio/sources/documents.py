"""Document tables at rest.

At rest: parquet partitioned by the month of effective_date, with tags as
ARRAY<STRING>, metadata as JSON text and the promoted tombstone column, so
date-range and visibility predicates prune partitions and skip row groups.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from folio.functions.common import ts_lit
from folio.functions.dates import date_objects, effective_date, effective_date_strict
from folio.functions.visibility import tombstone_at
from folio.session import materialised
from folio.sources import registry
from folio.sources.fixtures import DOC_COLUMNS

DOCUMENT_SCHEMA = StructType(
    [
        StructField("id", StringType(), False),
        StructField("created_at", TimestampType(), True),
        StructField("effective_date", TimestampType(), True),
        StructField("source_type", StringType(), True),
        StructField("source_url", StringType(), True),
        StructField("scraper_uuid", StringType(), True),
        StructField("textanalyzer_uuid", StringType(), True),
        StructField("tags", ArrayType(StringType()), True),
        StructField("metadata", StringType(), True),
        StructField("slug", StringType(), True),
        StructField("seo_enabled", BooleanType(), True),
        StructField("tombstone_at", TimestampType(), True),
    ]
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Load documents with a fixed schema (no inference). Tables written
    elsewhere may carry tags as JSON text (``tags_json``) and lack the
    promoted columns; both are normalised here."""
    raw = spark.read.parquet(path)
    cols = set(raw.columns)
    df = raw
    if "tags" not in cols and "tags_json" in cols:
        df = df.withColumn("tags", F.from_json("tags_json", "array<string>"))
    if "metadata" not in cols and "metadata_json" in cols:
        df = df.withColumn("metadata", F.col("metadata_json"))
    df = df.withColumn("metadata", F.coalesce(F.col("metadata"), F.lit("{}")))
    if "effective_date" not in cols:
        df = df.withColumn("_dates", date_objects("metadata")).withColumn(
            "effective_date", effective_date("metadata", "created_at", objects=F.col("_dates"))
        )
    if "tombstone_at" not in cols:
        df = df.withColumn("tombstone_at", tombstone_at("metadata"))
    if "seo_enabled" not in cols:
        df = df.withColumn("seo_enabled", F.lit(True))
    for f in DOCUMENT_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENT_SCHEMA.fields])


def prepare_ingest(new_docs: DataFrame) -> DataFrame:
    """R02 row rules: metadata defaults to {}, effective_date filled from
    metadata when unset (R40), tombstone promoted, month partition column."""
    df = new_docs.withColumn("metadata", F.coalesce(F.col("metadata"), F.lit("{}")))
    # the date objects are parsed once per document, not once per date path
    derived = effective_date("metadata", "created_at", objects=F.col("_dates"))
    if "effective_date" in df.columns:
        df = df.withColumn("_dates", F.when(F.col("effective_date").isNull(), date_objects("metadata")))
        df = df.withColumn("effective_date", F.coalesce(F.col("effective_date"), derived))
    else:
        df = df.withColumn("_dates", date_objects("metadata")).withColumn("effective_date", derived)
    df = df.withColumn("tombstone_at", tombstone_at("metadata"))
    for f in DOCUMENT_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    # the column's default: a document is published unless it says otherwise
    df = df.withColumn("seo_enabled", F.coalesce("seo_enabled", F.lit(True)))
    df = df.select(*DOC_COLUMNS)
    return df.withColumn("eff_month", F.date_format("effective_date", "yyyy-MM"))


#: Columns of the table at ``ingest_documents``' path: the document and its partitions.
TABLE_SCHEMA = StructType([*DOCUMENT_SCHEMA.fields, StructField("eff_month", StringType()), StructField("ingest_batch", StringType())])


def read_ingested(spark: SparkSession, path: str, *, date_start=None, date_end=None) -> DataFrame:
    """R01 for tables written by ``ingest_documents``: explicit schema; a date
    range prunes month partitions before it filters rows."""
    df = spark.read.schema(TABLE_SCHEMA).parquet(path)
    if date_start is not None:
        df = df.filter((F.col("eff_month") >= f"{date_start:%Y-%m}") & (F.col("effective_date") >= ts_lit(date_start)))
    if date_end is not None:
        df = df.filter((F.col("eff_month") <= f"{date_end:%Y-%m}") & (F.col("effective_date") <= ts_lit(date_end)))
    return df


class Ingested(NamedTuple):
    documents: DataFrame  # what the batch stored
    duplicates: DataFrame  # ids held already, with ``kept_in``, the batch that holds them
    conflicts: DataFrame  # slugs taken already, with ``kept_id``, the document that has them
    rejected: DataFrame  # rows without an id


#: Rows that a batch did not store, at ``<path>/_refused/ingest_batch=…``.
REFUSED_SCHEMA = StructType(
    [
        *[StructField(f.name, f.dataType) for f in DOCUMENT_SCHEMA.fields],
        StructField("reason", StringType()),
        StructField("kept_in", StringType()),
        StructField("kept_id", StringType()),
        StructField("ingest_batch", StringType()),
    ]
)


def ingest_documents(
    new_docs: DataFrame, path: str, *, batch_id: str, unique_slugs: bool = False, files_per_month: int = 8,
    max_records_per_file: int = 5_000_000, key_buckets: int = registry.KEY_BUCKETS,
) -> Ingested:
    """Add a batch of documents to the table at ``path``; tags travel in
    the row (the tag index is derived, R03), so one write keeps both
    consistent.

    Every row of the batch ends in exactly one of four tables (rows equal in all
    columns count as one). Rows without an id
    are ``rejected``. Ids are unique: of rows repeating an id in the batch the
    first by (created_at, content) is kept, and ids that another batch holds are
    not added again; all others are ``duplicates``. With ``unique_slugs`` (R77 on
    insert) a slug has one document: one that another batch's document has, or an
    earlier one of the batch by (created_at, id), makes the row a ``conflict``.
    The rest is stored.

    Ids and slugs held are looked up in the key registry beside the table
    (``sources.registry``), of which only the buckets that the batch's keys fall
    into are read; the table itself is not. ``key_buckets`` counts when the
    registry is made, with the first batch.

    Files land under ``eff_month=…/ingest_batch=<batch_id>/`` and the write
    replaces only the partitions of this batch (dynamic partition overwrite);
    months that an earlier run of the batch wrote and this one does not are
    removed. So a re-run of ``batch_id`` after a failure replaces its own files,
    its claims in the registry (written before the documents, so that no other
    batch can store the keys meanwhile) and its refused rows. Rows are dealt out
    by month and a salt before the write, which bounds the files per month."""
    spark = new_docs.sparkSession
    keys = registry.open_registry(spark, path, key_buckets, lambda: stored_keys(spark, path))
    prepared = prepare_ingest(new_docs).withColumn("_row", F.xxhash64(*DOC_COLUMNS))
    # one narrow row per id of the batch, the first; whether it may stay is decided on these
    first = prepared.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("created_at", "_row", "slug")).alias("_first"))
    mine = materialised(first.select("id", "_first.*"), "ingest-keys")
    ids = mine.select(F.lit("id").alias("kind"), F.col("id").alias("key"))
    held = keys.holders(ids, batch_id).select(F.col("key").alias("id"), F.col("ingest_batch").alias("kept_in"))
    verdict = mine.join(held, "id", "left")
    if unique_slugs:
        wanting = verdict.filter("kept_in IS NULL AND slug IS NOT NULL")
        slugs = wanting.select(F.lit("slug").alias("kind"), F.col("slug").alias("key"))
        taken = keys.holders(slugs, batch_id).select(F.col("key").alias("slug"), F.col("id").alias("taken_by"))
        earliest = wanting.groupBy("slug").agg(F.min(F.struct("created_at", "id"))["id"].alias("earliest"))
        owner = earliest.join(taken, "slug", "left").select("slug", F.coalesce("taken_by", "earliest").alias("owner"))
        # documents without a slug, or out already, get a key of their own: they spread over partitions
        spread = F.when(F.col("kept_in").isNull() & F.col("slug").isNotNull(), F.col("slug")).otherwise(F.concat(F.lit("\u0000"), F.col("id")))
        verdict = verdict.withColumn("_k", spread).join(owner.withColumnRenamed("slug", "_k"), "_k", "left").drop("_k")
        verdict = verdict.withColumn("kept_id", F.when(F.col("owner") != F.col("id"), F.col("owner"))).drop("owner")
    else:
        verdict = verdict.withColumn("kept_id", F.lit(None).cast("string"))
    verdict = materialised(verdict, "ingest-verdict")
    claimed = verdict.filter("kept_in IS NULL AND kept_id IS NULL")
    claims = claimed.select(F.explode(F.array(
        F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")), F.struct(F.lit("slug").alias("kind"), F.col("slug").alias("key"))
    )).alias("c"), "id", "created_at").select("c.*", "id", "created_at").filter("key IS NOT NULL")
    keys.claim(claims, batch_id)

    # the batch's rows, each with what became of it; equal rows: one of them is kept
    known = verdict.select(F.col("id").alias("_id"), F.col("created_at").alias("_at"), F.col("_row").alias("_kept_row"), "kept_in", "kept_id")
    marked = prepared.withColumn("_k", F.coalesce("id", F.concat(F.lit("\u0000"), F.col("_row").cast("string"))))
    marked = marked.join(known, F.col("_k") == F.col("_id"), "left")
    is_first = (F.col("_row") == F.col("_kept_row")) & F.col("created_at").eqNullSafe(F.col("_at"))
    reason = (
        F.when(F.col("_id").isNull(), F.lit("rejected")).when(F.col("kept_in").isNotNull() | ~is_first, F.lit("duplicate"))
        .when(F.col("kept_id").isNotNull(), F.lit("conflict")).otherwise(F.lit("stored"))
    )
    marked = marked.withColumn("reason", reason).select(
        "_k", *DOC_COLUMNS, "eff_month", "reason",
        F.when(F.col("reason") == "duplicate", F.coalesce("kept_in", F.lit(batch_id))).alias("kept_in"),
        F.when(F.col("reason") == "conflict", F.col("kept_id")).alias("kept_id"),
    )
    # the join dealt the rows by this key, so equal rows meet without another shuffle
    winners = marked.filter("reason = 'stored'").dropDuplicates(["_k"])
    out = winners.select(*DOC_COLUMNS, "eff_month").withColumn("ingest_batch", F.lit(batch_id))
    refused = marked.filter("reason <> 'stored'").drop("_k", "eff_month")
    refused = refused.withColumn("ingest_batch", F.lit(batch_id))
    folder = f"{path}/_refused"
    refused.select(*[f.name for f in REFUSED_SCHEMA.fields]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch", "reason").parquet(folder)

    fs, at = registry.filesystem(spark, path)
    earlier = [x.getPath() for x in fs.globStatus(at(f"{path}/eff_month=*/ingest_batch={batch_id}")) or []]
    # each task writes its rows clustered by month and date, so row groups
    # carry tight min/max statistics on effective_date for date-range skipping
    (
        out.repartition("eff_month", F.pmod(F.xxhash64("id"), F.lit(files_per_month)))
        .sortWithinPartitions("eff_month", "effective_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("eff_month", "ingest_batch")
        .parquet(path)
    )
    if earlier:  # a re-run: months that it no longer touches
        months = {r[0] for r in out.select("eff_month").distinct().collect()}  # one row per month
        for month_folder in earlier:
            month = month_folder.getParent().getName().partition("=")[2]
            if (None if month == "__HIVE_DEFAULT_PARTITION__" else month) not in months:
                fs.delete(month_folder, True)
    left = spark.read.schema(REFUSED_SCHEMA).parquet(folder).filter(F.col("ingest_batch") == batch_id)

    def of(kind: str, *extra: str) -> DataFrame:
        return left.filter(F.col("reason") == kind).select(*DOC_COLUMNS, *extra)

    written = read_ingested(spark, path).filter(F.col("ingest_batch") == batch_id)
    return Ingested(written, of("duplicate", "kept_in"), of("conflict", "kept_id"), of("rejected"))


def stored_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """The keys of a table that has no registry yet: its ids and slugs, or None
    if nothing is stored there."""
    fs, at = registry.filesystem(spark, path)
    if not fs.globStatus(at(f"{path}/eff_month=*")):
        return None
    held = spark.read.schema(TABLE_SCHEMA).parquet(path)
    kinds = F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")), F.struct(F.lit("slug").alias("kind"), F.col("slug").alias("key")))
    return held.select(F.explode(kinds).alias("c"), "id", "created_at", "ingest_batch").select("c.*", "id", "created_at", "ingest_batch").filter("key IS NOT NULL")


def backfill_effective_date(documents: DataFrame) -> DataFrame:
    """Fill effective_date where null from the metadata paths then
    created_at, with the strict SQL cast (malformed text fails the job)."""
    return documents.withColumn(
        "effective_date", F.coalesce(F.col("effective_date"), effective_date_strict("metadata", "created_at"))
    )
