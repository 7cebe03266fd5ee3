"""Documents laid out for point lookups.

A copy of the table partitioned by the hash of the id and sorted by id within its
files, with Parquet bloom filters on id and slug. A lookup by id knows the
partitions of its ids beforehand, so other files are not opened, and within a file
the ids' range skips row groups. Slugs have a small table of their own (slug, id,
seo_enabled), laid out by the slug's hash, which leads to the ids.

Choose ``buckets`` so that a partition is a file or a few (some 10**5 documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.documents import get_documents, keyed_rows

BUCKETS = 256


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _laid_out(rows: DataFrame, key: str, path: str, buckets: int, row_group_bytes: int) -> None:
    placed = rows.withColumn("key_bucket", _bucket(key, buckets))
    writer = placed.repartition(buckets, "key_bucket").sortWithinPartitions("key_bucket", key).write.mode("overwrite")
    writer = writer.option("parquet.block.size", row_group_bytes)
    for name in {key, "slug"} & set(rows.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy("key_bucket").parquet(path)


def write_lookup(documents: DataFrame, path: str, *, buckets: int = BUCKETS, row_group_bytes: int = 16 << 20) -> None:
    """Write ``documents`` to ``path`` for lookups by id and by slug. Rows without
    an id or a slug cannot be looked up by it, so they are left out there."""
    _laid_out(documents.filter(F.col("id").isNotNull()), "id", f"{path}/by-id-{buckets}", buckets, row_group_bytes)
    slugs = documents.filter(F.col("slug").isNotNull()).select("slug", "id", "seo_enabled")
    _laid_out(slugs, "slug", f"{path}/by-slug-{buckets}", buckets, row_group_bytes)


def _rows_of(spark: SparkSession, path: str, key: str, keys, buckets: int) -> DataFrame:
    """Rows having one of the ``keys`` (a list, or a table of them). The partitions
    touched are found first: at most ``buckets`` numbers come to the driver."""
    frame = keys.select(F.col(keys.columns[0]).alias(key)) if isinstance(keys, DataFrame) else spark.createDataFrame([(k,) for k in keys], f"{key} string")
    frame = frame.filter(F.col(key).isNotNull())
    touched = sorted(r[0] for r in frame.select(_bucket(key, buckets).alias("b")).distinct().collect())
    rows = spark.read.parquet(path).filter(F.col("key_bucket").isin(touched) if touched else F.lit(False))
    return keyed_rows(rows, key, keys)[1].drop("key_bucket")


def lookup_documents(spark: SparkSession, path: str, ids, *, buckets: int = BUCKETS) -> DataFrame:
    """Every requested id comes back, with ``found``."""
    return get_documents(_rows_of(spark, f"{path}/by-id-{buckets}", "id", ids, buckets), ids)


def lookup_slugs(spark: SparkSession, path: str, slugs, published_only: bool = False, *, buckets: int = BUCKETS) -> DataFrame:
    """Every requested slug comes back, with ``found`` and its document."""
    keys = slugs.select(F.col(slugs.columns[0]).alias("requested_slug")) if isinstance(slugs, DataFrame) else spark.createDataFrame([(s,) for s in slugs], "requested_slug string")
    held = _rows_of(spark, f"{path}/by-slug-{buckets}", "slug", slugs, buckets)
    if published_only:
        held = held.filter("seo_enabled")
    held = held.select(F.col("slug").alias("requested_slug"), F.col("id"))
    docs = _rows_of(spark, f"{path}/by-id-{buckets}", "id", held.select("id"), buckets)
    found = held.join(docs, "id").withColumn("found", F.lit(True))
    return keys.join(found, "requested_slug", "left").withColumn("found", F.coalesce("found", F.lit(False)))
