"""Tag index: a dictionary of tags and bitmap postings.

Documents are numbered: their ids hash into buckets of some 16,000 documents, and
within a bucket the id's rank is the document's position in bitmaps of 32,768 bits
(a fuller bucket goes on in a further part). At rest, below one folder:

* ``ids``: bucket, part, position, id;
* ``postings``: tag, bucket, part, bitmap of the documents that carry the tag;
* ``tags``: tag, number of documents.

A search matches its tags against the dictionary (the only thing a fuzzy LIKE
reads), ORs the postings of the tags found and reads the ids of the bits set. The
documents are not read. Building shuffles (id, tags) once per table: numbers and
postings of a bucket come from the same partition, so no bitmap is shuffled, and a
tag that a third of all documents carry is one bitmap per bucket.

Changes since the index was built are given to a search as ``changed`` (id, tags;
null tags: the document is gone): their ids are taken from the index' answer and
judged by their new tags. Null tags of a document are not indexed, as no search
matches them; a tag that a document repeats counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from folio.functions.visibility import has_any_tag, tag_predicate

#: Bits of a bitmap (what Spark's bitmap functions build) and documents aimed at per bucket.
BITS = 32_768
PER_BUCKET = 16_384


def _numbered(documents: DataFrame, buckets: int) -> DataFrame:
    """(bucket, part, position, id, tags): the rank of the id in its bucket."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    ranked = documents.select("id", "tags", bucket.alias("bucket")).withColumn("rank", rank)
    part, position = F.floor(F.col("rank") / BITS).cast("int"), (F.col("rank") % BITS).cast("long")
    return ranked.select("bucket", part.alias("part"), position.alias("position"), "id", "tags")


def build_tag_index(documents: DataFrame, path: str, *, buckets: int | None = None) -> None:
    """Write the index of ``documents`` (id, tags), one row per id, to ``path``.
    The number of buckets follows from the number of documents."""
    if buckets is None:
        buckets = max(1, -(-documents.count() // PER_BUCKET))
    numbered = _numbered(documents, buckets)
    numbered.select("bucket", "part", "position", "id").write.mode("overwrite").parquet(f"{path}/ids")
    each = numbered.select("bucket", "part", "position", F.explode(F.array_distinct("tags")).alias("tag"))
    bitmaps = each.filter(F.col("tag").isNotNull()).groupBy("bucket", "part", "tag").agg(
        F.bitmap_construct_agg("position").alias("bitmap")
    )
    # files sorted by tag: a search skips the row groups of other tags
    postings = bitmaps.select("tag", "bucket", "part", "bitmap").sortWithinPartitions("tag", "bucket", "part")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    counts = documents.sparkSession.read.parquet(f"{path}/postings").groupBy("tag").agg(
        F.sum(F.bitmap_count("bitmap")).alias("n_docs")
    )
    counts.sort("tag").write.mode("overwrite").parquet(f"{path}/tags")


def indexed_tags(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary: (tag, n_docs)."""
    return spark.read.parquet(f"{path}/tags")


def positions(bitmap) -> Column:
    """Array of the positions of the bits set, in no order. A bitmap is read in words of four
    bytes; its first byte holds positions 0 to 7, the lowest bit first."""
    words = F.transform(
        F.sequence(F.lit(0), F.lit(BITS // 32 - 1)),
        lambda i: F.struct(i.alias("i"), F.conv(F.hex(F.substring(bitmap, i * 4 + 1, F.lit(4))), 16, 10).cast("long").alias("w")),
    )
    # bit b of the big-endian word is bit b % 8 of byte 3 - b // 8
    bits = F.transform(
        F.filter(words, lambda x: x["w"] != 0),
        lambda x: F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.getbit(x["w"], b) == 1),
            lambda b: (x["i"] * 32 + b.bitwiseXOR(F.lit(24))).cast("long"),
        ),
    )
    return F.flatten(bits)


def matched_postings(spark: SparkSession, path: str, tags, fuzzy: bool = False) -> DataFrame:
    """(bucket, part, bitmap) of the documents that carry any tag given: one bitmap
    per bucket and part, without reading an id."""
    postings = spark.read.parquet(f"{path}/postings")
    if fuzzy:
        found = indexed_tags(spark, path).filter(tag_predicate("tag", tags, True)).select("tag")
        postings = postings.join(found, "tag", "left_semi")
    else:
        postings = postings.filter(tag_predicate("tag", tags))
    return postings.groupBy("bucket", "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count_by_index(spark: SparkSession, path: str, tags, fuzzy: bool = False) -> DataFrame:
    """(n_docs): documents that carry any of the tags, from the postings alone."""
    n = F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0).cast("long"))
    return matched_postings(spark, path, tags, fuzzy).agg(n.alias("n_docs"))


def search_by_index(spark: SparkSession, path: str, tags, fuzzy: bool = False, *, changed: DataFrame | None = None) -> DataFrame:
    """R13 from the index: ids of the documents having any of the tags, sorted.
    ``changed`` holds what the index does not know yet, one row per id."""
    hits = matched_postings(spark, path, tags, fuzzy).select("bucket", "part", F.explode(positions(F.col("bitmap"))).alias("position"))
    ids = spark.read.parquet(f"{path}/ids").join(hits, ["bucket", "part", "position"], "left_semi").select("id")
    if changed is not None:
        now = changed.filter(F.col("tags").isNotNull() & has_any_tag("tags", tags, fuzzy)).select("id")
        ids = ids.join(changed.select("id"), "id", "left_anti").unionByName(now)
    return ids.orderBy("id")
