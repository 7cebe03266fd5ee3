"""Publishing (R06, R74, R75, R76) and the sitemap writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.common import rfc3339
from folio.functions.text import clean_author, insert_image, paragraph_html
from folio.operators.documents import list_documents

SITEMAP_LIMIT = 1000
# Fixed value: URLs a sitemap file may hold; shards aim below it.
SITEMAP_MAX_URLS = 50_000
SITEMAP_SHARD_URLS = 45_000
# Fixed values of the sitemap protocol and the article schema.
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
IMAGE_NS = "http://www.google.com/schemas/sitemap-image/1.1"
CHANGE_FREQ = "weekly"
PRIORITY = 0.5


def sitemap_entries(documents: DataFrame, base_url: str, *, as_of, limit: int | None = SITEMAP_LIMIT) -> DataFrame:
    """The newest ``limit`` visible documents are taken first (1000 by
    default, as in the reference; None takes all), then those without a slug
    dropped; loc, lastmod (created date), changefreq, priority."""
    page = list_documents(documents, as_of=as_of, limit=limit)
    kept = page.filter(F.col("slug").isNotNull() & (F.col("slug") != "") & F.col("seo_enabled"))
    return kept.select(
        F.concat(F.lit(f"{base_url}/content/"), F.col("slug")).alias("loc"),
        F.date_format("created_at", "yyyy-MM-dd").alias("lastmod"),
        F.lit(CHANGE_FREQ).alias("changefreq"),
        F.lit(PRIORITY).alias("priority"),
        F.col("effective_date"),
        F.col("id"),
    )


def write_sitemap(entries: DataFrame, path: str) -> None:
    """Write <urlset><url>…</url></urlset> XML, as many files as the protocol's
    bound per file needs; rows are dealt out by hash, so no task gets them all."""
    rows = entries.select("loc", "lastmod", "changefreq", "priority")
    files = max(1, -(-rows.count() // SITEMAP_SHARD_URLS))
    (
        rows.repartition(files, F.xxhash64("loc"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", SITEMAP_MAX_URLS)
        .format("xml")
        .option("rootTag", f'urlset xmlns="{SITEMAP_NS}"')
        .option("rowTag", "url")
        .save(path)
    )


def xml_escape(c) -> Column:
    """Escape text for XML character data the way the reference's encoder
    does (&, <, >, quotes, tab and line breaks as character references)."""
    out = F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    # Character references of the reference's XML encoder.
    for ch, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"),
                    ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(ch), F.lit(ref))
    return out


def image_sitemap_xml(entries: DataFrame) -> DataFrame:
    """One ``<url>`` element (with its ``image:image`` children) per entry row."""
    def tag(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), xml_escape(value), F.lit(f"</{name}>"))).otherwise(F.lit(""))

    images = F.array_join(
        F.transform(
            "images",
            lambda i: F.concat(
                F.lit("<image:image>"), tag("image:loc", i["loc"]), tag("image:caption", i["caption"]),
                tag("image:title", i["title"]), F.lit("</image:image>"),
            ),
        ),
        "",
    )
    return entries.select(F.concat(F.lit("<url>"), tag("loc", F.col("loc")), images, F.lit("</url>")).alias("xml"))


XML_HEADER = '<?xml version="1.0" encoding="UTF-8"?>'
URLS_PER_FILE = 45_000  # under the protocol's 50 000 URLs per sitemap file


def write_xml_shards(fragments: DataFrame, path: str, root_open: str, root_close: str, per_file: int = URLS_PER_FILE) -> int:
    """Write XML fragments as sitemap files of at most ~``per_file`` entries:
    fragments are hash-sharded, each shard gets the header and root element
    around its rows, one file per shard folder. Returns the shard count
    (from one count over the fragments; no row passes through the driver)."""
    import math

    spark = fragments.sparkSession
    n = fragments.count()
    shards = max(1, math.ceil(n / per_file))
    body = fragments.select(F.pmod(F.xxhash64("xml"), F.lit(shards)).alias("shard"), F.lit(1).alias("o"), "xml")
    spine = spark.range(shards).select(F.col("id").alias("shard"))
    head = spine.select("shard", F.lit(0).alias("o"), F.lit(XML_HEADER + "\n" + root_open).alias("xml"))
    tail = spine.select("shard", F.lit(2).alias("o"), F.lit(root_close).alias("xml"))
    rows = body.unionByName(head).unionByName(tail).repartition(shards, "shard").sortWithinPartitions("shard", "o")
    rows.select("shard", "xml").write.mode("overwrite").partitionBy("shard").text(path)
    return shards


def write_image_sitemap(entries: DataFrame, path: str, per_file: int = URLS_PER_FILE) -> int:
    """Write the image sitemap (R07): ``<urlset>`` with the image namespace,
    sharded by ``write_xml_shards``."""
    root = f'<urlset xmlns="{SITEMAP_NS}" xmlns:image="{IMAGE_NS}">'
    return write_xml_shards(image_sitemap_xml(entries), path, root, "</urlset>", per_file)


def _variant_string(doc: Column, path: str) -> Column:
    """String at a path of a parsed (VARIANT) document; null when absent or
    not a string."""
    v = F.try_variant_get(doc, path, "variant")
    is_str = F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    return F.when(is_str, F.variant_get(v, "$", "string"))


def _meta_string(doc: Column, path: str, default: str) -> Column:
    """String at a path, ``default`` when absent or not a string."""
    return F.coalesce(_variant_string(doc, path), F.lit(default))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def article_jsonld(
    title: Column, description: Column, author: Column, published: Column, images: Column, keywords: Column,
    body: Column, url: Column,
) -> Column:
    """Schema.org Article JSON; empty optional fields omitted (to_json
    drops nulls), author as a Person object when non-empty, RFC 3339 dates."""
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("Article").alias("@type"),
            title.alias("headline"),
            _nonempty(description).alias("description"),
            F.when(author != "", F.struct(F.lit("Person").alias("@type"), author.alias("name"))).alias("author"),
            rfc3339(published).alias("datePublished"),
            rfc3339(published).alias("dateModified"),
            F.when(F.size(images) > 0, images).alias("image"),
            F.when(F.size(keywords) > 0, keywords).alias("keywords"),
            _nonempty(body).alias("articleBody"),
            _nonempty(url).alias("url"),
        )
    )


def article_export(
    documents: DataFrame, base_url: str, image_base_url: str, best_images: DataFrame | None = None
) -> DataFrame:
    """One row per published document (slug present, seo on): title
    (default 'Untitled'), description, body HTML (R75, with the best image
    placed mid-article), cleaned author, keywords, canonical URL, image URL,
    published date, source URL and the JSON-LD (R76).

    ``best_images`` (document_id, best_image_slug) comes from
    ``images.best_images``; without it the metadata's image list is used."""
    docs = documents.filter(F.col("slug").isNotNull() & (F.col("slug") != "") & F.col("seo_enabled"))
    # parse only the two metadata objects an article reads; the parser skips
    # every other key (the original text above all) without building it
    docs = docs.withColumn(
        "_meta", F.from_json("metadata", "struct<scraper_metadata: variant, text_analysis: variant>")
    )
    sm = F.col("_meta.scraper_metadata")
    ta = F.col("_meta.text_analysis")
    # narrow the rows to the article's fields before any join: the shuffle
    # then carries the content, not the whole metadata document
    fields = [
        F.col("id"),
        F.col("slug"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("keywords"),
        F.col("created_at").alias("published_at"),
        F.coalesce(F.col("source_url"), F.lit("")).alias("source_url"),
        _meta_string(sm, "$.title", "Untitled").alias("title"),
        _meta_string(sm, "$.description", "").alias("description"),
        F.coalesce(_variant_string(ta, "$.content"), _meta_string(sm, "$.content", "")).alias("raw"),
        clean_author(_meta_string(sm, "$.author", "")).alias("author"),
    ]
    if best_images is not None:
        narrow = docs.select(*fields).join(best_images.withColumnRenamed("document_id", "id"), "id", "left")
    else:
        from folio.functions.scores import best_image

        imgs = F.try_variant_get(sm, "$.images", "array<struct<slug:string,relevance_score:double>>")
        narrow = docs.select(*fields, best_image(imgs).alias("best_image_slug"))
    img_slug = F.col("best_image_slug")
    has_img = img_slug.isNotNull() & (img_slug != "")
    html = paragraph_html(F.col("raw"))
    body = F.when(has_img, insert_image(html, F.lit(image_base_url), img_slug)).otherwise(html)
    out = narrow.select(
        "id",
        "slug",
        "title",
        "description",
        body.alias("body_html"),
        "author",
        "keywords",
        F.concat(F.lit(f"{base_url}/content/"), F.col("slug")).alias("canonical_url"),
        F.when(has_img, F.concat(F.lit(f"{image_base_url}/images/"), img_slug)).alias("image_url"),
        "published_at",
        "source_url",
    )
    return out.withColumn(
        "jsonld",
        article_jsonld(
            F.col("title"), F.col("description"), F.col("author"), F.col("published_at"),
            F.when(F.col("image_url").isNotNull(), F.array(F.col("image_url"))).otherwise(F.array().cast("array<string>")),
            F.col("keywords"), F.col("body_html"), F.col("canonical_url"),
        ),
    )


def image_object_jsonld(url: Column, description: Column, title: Column, width: Column, height: Column) -> Column:
    """R76 (image form): schema.org ImageObject; description and name omitted
    when empty, width and height omitted when 0."""
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("ImageObject").alias("@type"),
            F.coalesce(url, F.lit("")).alias("contentUrl"),
            _nonempty(description).alias("description"),
            _nonempty(title).alias("name"),
            F.when(width != 0, width.cast("int")).alias("width"),
            F.when(height != 0, height.cast("int")).alias("height"),
        )
    )


def web_page_jsonld(title: Column, description: Column, url: Column, published: Column, modified: Column) -> Column:
    """R76 (web-page form): schema.org WebPage; description and url omitted
    when empty, dates omitted when unset, RFC 3339 otherwise."""
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("WebPage").alias("@type"),
            F.coalesce(title, F.lit("")).alias("name"),
            _nonempty(description).alias("description"),
            _nonempty(url).alias("url"),
            rfc3339(published).alias("datePublished"),
            rfc3339(modified).alias("dateModified"),
        )
    )


def breadcrumb_jsonld(items: Column) -> Column:
    """R76 (breadcrumb form): schema.org BreadcrumbList of
    ``array<struct<position:int, name:string, item:string>>``; every element
    typed ListItem, ``item`` omitted when empty."""
    elements = F.transform(
        F.coalesce(items, F.array().cast("array<struct<position:int,name:string,item:string>>")),
        lambda e: F.struct(
            F.lit("ListItem").alias("@type"),
            e["position"].cast("int").alias("position"),
            F.coalesce(e["name"], F.lit("")).alias("name"),
            _nonempty(e["item"]).alias("item"),
        ),
    )
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("BreadcrumbList").alias("@type"),
            elements.alias("itemListElement"),
        )
    )
