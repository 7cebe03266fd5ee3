"""Sources and sinks: table round trip, sitemap XML."""

import datetime as dt
import glob
import os
import tempfile

from pyspark.sql import functions as F

from folio.operators import images as I, publish as P
from folio.sources import documents as SD

UTC = dt.timezone.utc
AS_OF = dt.datetime(2025, 6, 1, tzinfo=UTC)


def test_ingest_and_read_back(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="folio-docs-"), "t")
    meta = '{"scraper_metadata":{"publish_date":"2024-04-01"},"tombstone_datetime":"2024-06-01T00:00:00Z"}'
    rows = [("a", dt.datetime(2024, 5, 1), meta, ["x"]), ("b", dt.datetime(2024, 5, 2), None, []),
            ("b", dt.datetime(2024, 5, 3), None, ["later"]), ("b", dt.datetime(2024, 5, 2), None, [])]
    schema = "id string, created_at timestamp, metadata string, tags array<string>"
    src = spark.createDataFrame(rows, schema)
    done = SD.ingest_documents(src, path, batch_id="b1")
    assert [(r.id, list(r.tags), r.kept_in) for r in done.duplicates.collect()] == [("b", ["later"], "b1")]
    assert sorted(os.path.basename(p) for p in glob.glob(path + "/eff_month=*")) == ["eff_month=2024-04", "eff_month=2024-05"]
    SD.ingest_documents(src, path, batch_id="b1")  # a replayed batch replaces itself
    assert SD.read_documents(spark, path).count() == 2
    # another batch adds new ids only
    more = spark.createDataFrame([("a", dt.datetime(2024, 7, 1), None, []), ("c", dt.datetime(2024, 7, 1), None, [])], schema)
    again = SD.ingest_documents(more, path, batch_id="b2")
    assert [(r.id, r.kept_in) for r in again.duplicates.collect()] == [("a", "b1")]
    back = {r.id: r for r in SD.read_ingested(spark, path).collect()}
    assert set(back) == {"a", "b", "c"} and all(r.seo_enabled for r in back.values())
    assert back["a"].effective_date == dt.datetime(2024, 4, 1) and back["a"].tombstone_at == dt.datetime(2024, 6, 1)
    assert back["b"].metadata == "{}" and back["b"].effective_date == dt.datetime(2024, 5, 2)
    # a replay that leaves a month removes the month's old files
    SD.ingest_documents(src.filter("id = 'a'"), path, batch_id="b1")
    assert {r.id for r in SD.read_ingested(spark, path).collect()} == {"a", "c"}


def test_date_ranges_prune_months_and_instants_carry_statistics(spark):
    import pyarrow.parquet as pq

    path = os.path.join(tempfile.mkdtemp(prefix="folio-docs-"), "t")
    src = spark.createDataFrame([(str(i), dt.datetime(2024, 1 + i % 12, 3)) for i in range(48)], "id string, created_at timestamp").withColumn("metadata", F.lit("{}"))
    SD.ingest_documents(src, path, batch_id="b")
    day = SD.read_ingested(spark, path, date_start=dt.datetime(2024, 5, 1), date_end=dt.datetime(2024, 5, 9))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(eff_month" in plan and day.count() == 4
    one = glob.glob(path + "/eff_month=2024-05/*/*.parquet")[0]
    kinds = {c.name: c.physical_type for c in (pq.ParquetFile(one).schema.column(i) for i in range(11))}
    assert kinds["effective_date"] == kinds["created_at"] == "INT64"


def test_backfill_is_strict(spark):
    import pytest

    df = spark.createDataFrame([("a", None, '{"additional_metadata":{"date":"not a date"}}', dt.datetime(2024, 1, 1))],
                               "id string, effective_date timestamp, metadata string, created_at timestamp")
    with pytest.raises(Exception):
        SD.backfill_effective_date(df).collect()


def test_sitemap_xml(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", dt.datetime(2024, 1, 1 + i), dt.datetime(2024, 1, 1 + i), f"slug-{i}" if i != 2 else None, True, None)
         for i in range(4)],
        "id string, created_at timestamp, effective_date timestamp, slug string, seo_enabled boolean, tombstone_at timestamp",
    )
    entries = P.sitemap_entries(docs, "https://ex.com", as_of=AS_OF)
    assert [r.loc for r in entries.orderBy("loc").collect()] == [f"https://ex.com/content/slug-{i}" for i in (0, 1, 3)]
    out = os.path.join(tempfile.mkdtemp(prefix="folio-sitemap-"), "s")
    P.write_sitemap(entries, out)
    xml = "".join(open(p).read() for p in glob.glob(out + "/*.xml"))
    assert 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"' in xml
    assert "<loc>https://ex.com/content/slug-3</loc>" in xml and "<changefreq>weekly</changefreq>" in xml
    assert "<lastmod>2024-01-04</lastmod>" in xml and "<priority>0.5</priority>" in xml


def test_image_sitemap(spark):
    imgs = spark.createDataFrame(
        [("1", "a", "cap", "title", ["t"]), ("2", "a", "", "t2", ["t"]), ("3", None, "x", "y", [])],
        "id string, slug string, summary string, alt_text string, tags array<string>",
    )
    entries = I.image_sitemap_entries(imgs, "https://ex.com").collect()
    assert len(entries) == 1 and entries[0].loc == "https://ex.com/content/a" and len(entries[0].images) == 2
    assert {(i.caption, i.title) for i in entries[0].images} == {(None, "t2"), ("cap", "title")}
    out = os.path.join(tempfile.mkdtemp(prefix="folio-isitemap-"), "s")
    P.write_image_sitemap(I.image_sitemap_entries(imgs, "https://ex.com"), out)
    files = glob.glob(out + "/shard=*/*.txt")
    assert len(files) == 1
    xml = open(files[0]).read()
    assert xml.startswith('<?xml version="1.0" encoding="UTF-8"?>') and xml.rstrip().endswith("</urlset>")
    assert "<image:loc>https://ex.com/images/a</image:loc>" in xml and "<image:caption>cap</image:caption>" in xml
    assert 'xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"' in xml


def test_search_images_refuses_empty(spark):
    import pytest

    imgs = spark.createDataFrame([("1", ["Red", "x"])], "id string, tags array<string>")
    with pytest.raises(ValueError):
        I.search_images(imgs, [])
    assert [r.id for r in I.search_images(imgs, ["RED"]).collect()] == ["1"]


def test_size_partitions(spark):
    from folio.session import size_partitions

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_partitions(spark, 100 * 1024**4) == 200_000
        assert size_partitions(spark, 10 * 1024**3) == 40
        assert size_partitions(spark, 1) == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))


def test_sitemap_beyond_its_default_and_large_image_groups(spark):
    docs = spark.range(2500).select(
        F.concat(F.lit("d"), F.col("id")).alias("id"), F.timestamp_seconds(F.col("id")).alias("created_at"),
        F.timestamp_seconds(F.col("id")).alias("effective_date"), F.concat(F.lit("s"), F.col("id")).alias("slug"),
        F.lit(True).alias("seo_enabled"), F.lit(None).cast("timestamp").alias("tombstone_at"))
    assert P.sitemap_entries(docs, "http://x", as_of=AS_OF).count() == 1000
    assert P.sitemap_entries(docs, "http://x", as_of=AS_OF, limit=None).count() == 2500
    images = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("one").alias("slug"), F.lit("").alias("summary"), F.lit("").alias("alt_text"))
    sizes = [len(r.images) for r in I.image_sitemap_entries(images, "http://x").collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 1000
    assert [len(r.images) for r in I.image_sitemap_entries(images, "http://x", max_images=None).collect()] == [20_000]


INGEST_ROWS = "id string, created_at timestamp, source_type string, tags array<string>, metadata string, slug string"


def _rows(spark, *rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(days=day), "text", ["t"], "{}", slug) for i, day, slug in rows], INGEST_ROWS)


def test_every_row_is_stored_or_reported(spark):
    """Null ids, repeated ids and rows, slugs taken in the batch and before it."""
    path = os.path.join(tempfile.mkdtemp(prefix="folio-reg-"), "docs")
    one = SD.ingest_documents(
        _rows(spark, (None, 1, "a"), (None, 1, None), ("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x"), ("c", 4, None), ("d", 0, "")),
        path, batch_id="b1", unique_slugs=True)
    assert sorted(r.id for r in one.documents.collect()) == ["a", "c", "d"]
    assert sorted((r.id, r.slug, r.kept_in) for r in one.duplicates.collect()) == [("a", "y", "b1")]
    assert [(r.id, r.kept_id) for r in one.conflicts.collect()] == [("b", "a")]
    assert sorted(r.slug or "" for r in one.rejected.collect()) == ["", "a"]

    two = SD.ingest_documents(
        _rows(spark, ("a", 0, "new"), ("b", 9, "y"), ("e", 9, "x"), ("f", 9, "z"), ("g", 8, "z"), ("h", 9, "new")), path, batch_id="b2", unique_slugs=True)
    assert sorted(r.id for r in two.documents.collect()) == ["b", "g", "h"]  # slugs of refused rows stay free
    assert [(r.id, r.kept_in) for r in two.duplicates.collect()] == [("a", "b1")]
    assert sorted((r.id, r.kept_id) for r in two.conflicts.collect()) == [("e", "a"), ("f", "g")]
    assert two.rejected.count() == 0
    assert sorted(r.id for r in one.documents.collect()) == ["a", "c", "d"]  # what the batch wrote, also later
    assert SD.read_ingested(spark, path).count() == 6

    # a re-run with other rows gives up the claims that the first run made
    SD.ingest_documents(_rows(spark, ("g", 8, "zz")), path, batch_id="b2", unique_slugs=True)
    three = SD.ingest_documents(_rows(spark, ("b", 9, "y"), ("k", 9, "z"), ("m", 9, "zz")), path, batch_id="b3", unique_slugs=True)
    assert sorted(r.id for r in three.documents.collect()) == ["b", "k"] and [r.kept_id for r in three.conflicts.collect()] == ["g"]


def test_registry_reads_only_the_touched_buckets(spark):
    from folio.sources import registry

    path = os.path.join(tempfile.mkdtemp(prefix="folio-reg-"), "docs")
    docs = spark.range(2000).select(
        F.concat(F.lit("d"), F.col("id")).alias("id"), F.timestamp_seconds(F.col("id")).alias("created_at"), F.lit("text").alias("source_type"),
        F.array(F.lit("t")).alias("tags"), F.lit("{}").alias("metadata"), F.concat(F.lit("s"), F.col("id")).alias("slug"))
    SD.ingest_documents(docs, path, batch_id="b1", key_buckets=16)
    keys = registry.open_registry(spark, path, 64, lambda: None)
    assert keys.buckets == 16 and keys.read().count() == 4000
    few = spark.createDataFrame([("id", "d7"), ("id", "nobody")], "kind string, key string")
    held = keys.holders(few, "b2")
    assert [(r.key, r.id, r.ingest_batch) for r in held.collect()] == [("d7", "d7", "b1")]
    buckets = keys.touched(few)
    assert len(buckets) == 2
    files = {f.rsplit("key_bucket=", 1)[1].split("/")[0] for f in keys.read(buckets).inputFiles()}
    assert len(files) == 16  # all of the table's files, of which the scan keeps the partitions below
    text = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "key_bucket" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    second = SD.ingest_documents(docs.limit(5), path, batch_id="b2")
    assert second.documents.count() == 0 and {r.kept_in for r in second.duplicates.collect()} == {"b1"}


def test_registry_of_a_table_written_without_one(spark):
    import shutil

    path = os.path.join(tempfile.mkdtemp(prefix="folio-reg-"), "docs")
    SD.ingest_documents(_rows(spark, ("a", 1, "x"), ("b", 2, None)), path, batch_id="b1")
    shutil.move(glob.glob(f"{path}/_keys-*")[0], path + "-elsewhere")
    two = SD.ingest_documents(_rows(spark, ("a", 5, "q"), ("c", 5, "x")), path, batch_id="b2", unique_slugs=True)
    assert [r.kept_in for r in two.duplicates.collect()] == ["b1"] and [r.kept_id for r in two.conflicts.collect()] == ["a"]
