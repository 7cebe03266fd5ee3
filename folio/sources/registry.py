"""Registry of unique keys beside a document table.

At ``<path>/_keys-<buckets>/key_bucket=…/ingest_batch=…`` (a name that a read of
the table does not see), one row per key held: its kind (id or slug), the key, the
document that has it and the batch that stored it. A batch is checked against the
buckets its own keys fall into, not against the table; within a bucket files are
sorted by key, so row groups carry tight minimum and maximum keys.

Choose the number of buckets with the first batch, so that one bucket is a task's
work when the table is full (64 suit some 10**8 documents; take 4096 for 10**10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType

KEY_BUCKETS = 64

KEY_SCHEMA = StructType(
    [
        StructField("kind", StringType()),
        StructField("key", StringType()),
        StructField("id", StringType()),
        StructField("created_at", TimestampType()),
        StructField("key_bucket", IntegerType()),
        StructField("ingest_batch", StringType()),
    ]
)


def filesystem(spark: SparkSession, path: str):
    """Spark's file system for ``path``, and its path constructor."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


class Registry:
    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def bucket(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that the keys fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(KEY_SCHEMA).parquet(self.folder)
        return rows if buckets is None else rows.filter(F.col("key_bucket").isin(buckets))

    def holders(self, keys: DataFrame, batch_id: str) -> DataFrame:
        """(kind, key, id, ingest_batch) of the given (kind, key) rows that another
        batch holds. Only the buckets touched are read."""
        buckets = self.touched(keys)
        rows = self.read(buckets).filter(F.col("ingest_batch") != batch_id) if buckets else self.read().filter("false")
        found = rows.join(keys.distinct(), ["kind", "key"], "left_semi")
        # one holder per key; several only where a table without a registry had repeats
        least = F.min(F.struct("created_at", "id", "ingest_batch")).alias("h")
        return found.groupBy("kind", "key").agg(least).select("kind", "key", "h.id", "h.ingest_batch")

    def claim(self, claims: DataFrame, batch_id: str) -> None:
        """Write a batch's (kind, key, id, created_at) rows, in place of what an
        earlier run of the batch claimed."""
        fs, at = filesystem(self.spark, self.folder)
        earlier = [x.getPath() for x in fs.globStatus(at(f"{self.folder}/key_bucket=*/ingest_batch={batch_id}")) or []]
        buckets = set(self.touched(claims)) if earlier else set()
        self._write(claims.withColumn("ingest_batch", F.lit(batch_id)))
        for path in earlier:  # buckets that the batch no longer touches
            if int(path.getParent().getName().partition("=")[2]) not in buckets:
                fs.delete(path, True)

    def _write(self, rows: DataFrame) -> None:
        (
            rows.withColumn("key_bucket", self.bucket())
            .select(*[f.name for f in KEY_SCHEMA.fields])
            .repartition("key_bucket")
            .sortWithinPartitions("key_bucket", "ingest_batch", "kind", "key")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("key_bucket", "ingest_batch")
            .parquet(self.folder)
        )


def open_registry(spark: SparkSession, path: str, buckets: int, stored: Callable[[], DataFrame | None]) -> Registry:
    """The table's registry. Where there is none it is made, from the keys that
    ``stored`` finds in the table (one read of it)."""
    fs, at = filesystem(spark, path)
    there = [x.getPath().getName() for x in fs.globStatus(at(f"{path}/_keys-*")) or []]
    if there:
        return Registry(spark, f"{path}/{there[0]}", int(there[0].partition("-")[2]))
    new = Registry(spark, f"{path}/_keys-{buckets}", buckets)
    rows = stored()
    if rows is not None:
        new._write(rows)
    else:
        fs.mkdirs(at(new.folder))
    return new
