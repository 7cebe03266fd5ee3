"""Images (R07, R31, R54 table form, R68, R79)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.common import micros
from folio.operators.documents import unmatched
from folio.operators.merges import one_per_key

DAY_US = 86_400_000_000
SITEMAP_IMAGES_PER_URL = 1000


def document_images(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Images of each document through the scraper id (inner join;
    null keys never match and are filtered before the shuffle)."""
    d = documents.select(F.col("id").alias("document_id"), "scraper_uuid").filter(F.col("scraper_uuid").isNotNull())
    return d.join(images.withColumnRenamed("id", "image_id"), "scraper_uuid")


def best_images(documents: DataFrame, images: DataFrame) -> DataFrame:
    """R54 over tables: per document, the slug of its image with the highest
    relevance (0.5 when unset), images without slug skipped, ties to the
    smallest image id. One partial aggregate per document."""
    di = document_images(documents, images).filter(F.col("slug").isNotNull() & (F.col("slug") != ""))
    score = F.coalesce(F.col("relevance_score"), F.lit(0.5))
    di = di.filter(score > -1)
    return di.groupBy("document_id").agg(
        F.min(F.struct((-score).alias("neg_score"), F.col("image_id"), F.col("slug")))["slug"].alias("best_image_slug")
    )


def image_sitemap_entries(images: DataFrame, base_url: str, *, max_images: int | None = SITEMAP_IMAGES_PER_URL) -> DataFrame:
    """Images grouped by slug: page loc base/content/slug, image loc
    base/images/slug, caption and title omitted when empty.

    One row per (slug, chunk) with the image list. ``max_images`` is the
    sitemap protocol's bound per entry: a slug with more is cut into chunks of
    at most that many, by hashed salt and rank within it, so that no task
    gathers a whole slug. None keeps each slug in one entry."""
    imgs = images.filter(F.col("slug").isNotNull() & (F.col("slug") != ""))
    if max_images is None:
        chunked = imgs.withColumn("chunk", F.lit(0).cast("long"))
    else:
        counts = imgs.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
        salted = imgs.join(counts, "slug").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / max_images).cast("long")))
        rank = F.row_number().over(Window.partitionBy("slug", "salt").orderBy("id"))
        part = F.floor((rank - 1) / max_images).cast("long")
        chunked = salted.withColumn("chunk", F.col("salt") + part * F.ceil(F.col("n") / max_images).cast("long"))
    img = F.struct(
        F.concat(F.lit(f"{base_url}/images/"), F.col("slug")).alias("loc"),
        F.when(F.col("summary") != "", F.col("summary")).alias("caption"),
        F.when(F.col("alt_text") != "", F.col("alt_text")).alias("title"),
    )
    return chunked.groupBy("slug", "chunk").agg(
        F.concat(F.lit(f"{base_url}/content/"), F.first("slug")).alias("loc"),
        F.sort_array(F.collect_list(img)).alias("images"),
    )


def search_images(images: DataFrame, terms) -> DataFrame:
    """Images having a tag that contains any term, case-insensitively.
    An empty term list is refused."""
    terms = [t for t in (terms or [])]
    if not terms:
        raise ValueError("at least one search term is required")
    lowered = [t.lower() for t in terms]

    def hit(t):
        lt = F.lower(t)
        out = F.lit(False)
        for x in lowered:
            out = out | (F.instr(lt, F.lit(x)) > 0)
        return out

    return images.filter(F.exists(F.coalesce("tags", F.array().cast("array<string>")), hit))


def image_updates(images: DataFrame, changes: DataFrame, *, as_of, period_days: int = 30, order: str | None = None):
    """Batch of image changes (id, action, tags) with action in
    {replace_tags, tombstone, untombstone, delete}; of several changes for one id
    the last by ``order`` counts, and without an order they must be equal.
    Returns (new images, missing ids)."""
    single = one_per_key(changes, "id", ["action", "tags"], order)
    ch = single.select("id", F.col("action").alias("chg_action"), F.col("tags").alias("chg_tags"), F.lit(True).alias("_hit"))
    j = images.join(ch, "id", "left")
    act = F.col("chg_action")
    when_ts = F.timestamp_micros(F.lit(micros(as_of) + period_days * DAY_US))
    out = (
        j.filter(F.coalesce(act, F.lit("")) != "delete")
        .withColumn("tags", F.when(act == "replace_tags", F.col("chg_tags")).otherwise(F.col("tags")))
        .withColumn(
            "tombstone_datetime",
            F.when(act == "tombstone", when_ts)
            .when(act == "untombstone", F.lit(None).cast("timestamp"))
            .otherwise(F.col("tombstone_datetime")),
        )
        .select(*images.columns)
    )
    return out, unmatched(changes.select("id").distinct(), images, "id")
