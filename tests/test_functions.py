"""Tags, slugs, dates, article HTML on small cases."""

import datetime as dt

from conftest import evaluate
from pyspark.sql import functions as F

from folio.functions import (
    analyzer_tags,
    assemble_tags,
    bucket_width,
    clean_author,
    effective_date,
    first_trigger_tag,
    insert_image,
    merge_tags,
    normalize_tag,
    paragraph_html,
    slug_source,
    slugify,
    slugify_or,
)
from folio.functions.scores import best_image, score_gate, size_factor

TAG_CASES = [
    ("plain", "plain"), ("Mixed Case", "Mixed Case"), ("two-parts", "two-parts"), ("three-part-name", "three-part"),
    ("a-b-c-d", "a-b"), ("", ""), ("--", "-"),
]

MERGE_CASES = [
    (["x", "y"], [], ["x", "y"]),
    ([], ["p", "q"], ["p", "q"]),
    (["x"], ["y", "x", "z"], ["x", "y", "z"]),  # known ones are not repeated, order stays
    (["Xx"], ["xX", "YY"], ["Xx", "YY"]),  # whatever the case, the first spelling stays
    (["x"], ["new", "NEW", "New"], ["x", "new"]),
]

PARAGRAPH_CASES = [
    ("", ""),
    ("one", "<p>one</p>\n"),
    ("one\n\ntwo", "<p>one</p>\n<p>two</p>\n"),
    ("a\nb\nc", "<p>a<br>b<br>c</p>\n"),
    (" \n\n x \n\n\n\n\n y", "<p>x</p>\n<p>y</p>\n"),
]


def test_normalize_tag(spark):
    assert evaluate(spark, normalize_tag, [c[0] for c in TAG_CASES]) == [c[1] for c in TAG_CASES]


def test_merge_tags(spark):
    df = spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(MERGE_CASES)], "i int, e array<string>, a array<string>")
    got = [r[0] for r in df.select(merge_tags("e", "a")).collect()]
    assert got == [c[2] for c in MERGE_CASES]


def test_merge_tags_idempotent(spark):
    df = spark.createDataFrame([(e, a) for e, a, _ in MERGE_CASES], "e array<string>, a array<string>")
    once = df.select(merge_tags("e", "a").alias("m"), "a")
    twice = once.select(F.col("m"), merge_tags("m", "a").alias("m2")).collect()
    assert all(r["m"] == r["m2"] for r in twice)


def test_assemble_tags(spark):
    df = spark.createDataFrame(
        [(["Machine-Learning-Model", "news"], "https://www.example.com/a"), (None, "mailto:x@y"), ([], "http://h.io")],
        "c array<string>, u string",
    )
    got = [r[0] for r in df.select(assemble_tags("c", "u")).collect()]
    assert got == [["Machine-Learning", "news", "example.com", "scrape"], ["scrape"], ["h.io", "scrape"]]


def test_analyzer_tags(spark):
    cases = [
        ('{"tags": ["a-b-c", 5, "x", null, {"k": 1}]}', ["a-b", "x"]),
        ('{"tags": "not-an-array"}', []),
        ("{}", []),
        (None, []),
    ]
    assert evaluate(spark, analyzer_tags, [c[0] for c in cases]) == [c[1] for c in cases]


def test_first_trigger_tag(spark):
    df = spark.createDataFrame([(["normal", "Spam", "spam", "nsfw"],), (["Low-Quality"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(first_trigger_tag("t", ["nsfw", "spam"])).collect()]
    assert got == ["spam", None, None]


def test_slugify(spark):
    cases = [
        ("Hello World", "hello-world"),
        ("Café déjà vu", "cafe-deja-vu"),
        ("  --Multiple___spaces  and--dashes--  ", "multiple-spaces-and-dashes"),
        ("Straße Æther ñandú", "strae-ther-nandu"),
        ("tab\there\nnewline", "tabherenewline"),
        ("!!!", ""),
        ("a" * 99 + " bcd", "a" * 99),
        ("Ǆemal ḱ ǅ İstanbul", "emal-k-istanbul"),
        (None, ""),
    ]
    assert evaluate(spark, slugify, [c[0] for c in cases]) == [c[1] for c in cases]


def test_slugify_matches_nfd_rule(spark):
    import unicodedata

    samples = ["Ŝŧŕåñğē Ŵøřđš", "Ωμέγα", "ĀāĂăĄą ǍǎǞǟ", "Việt Nam ỹ", "Ǻǻ ǽ Ḉḉ"]

    def ref(s):
        s = s.lower()
        s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
        import re

        s = s.replace(" ", "-").replace("_", "-")
        s = re.sub("[^a-z0-9-]+", "", s)
        s = re.sub("-+", "-", s).strip("-")
        return s[:100].rstrip("-")

    assert evaluate(spark, slugify, samples) == [ref(s) for s in samples]


def test_slugify_or(spark):
    df = spark.createDataFrame([("###", "Fallback Id"), ("Title", "x")], "t string, f string")
    assert [r[0] for r in df.select(slugify_or("t", "f")).collect()] == ["fallback-id", "title"]


def test_slug_source_cuts_at_100_bytes(spark):
    text = "é" * 60  # 120 bytes
    df = spark.createDataFrame([(None, text), ("", "plain text"), ("Cleaned", "orig")], "c string, t string")
    got = [r[0] for r in df.select(slug_source("c", "t")).collect()]
    assert got[0].startswith("é" * 50) and len(got[0].encode()) <= 103
    assert got[1:] == ["plain text", "Cleaned"]
    assert [r[0] for r in df.select(slugify(slug_source("c", "t"))).collect()][0] == "e" * 50


def test_clean_author(spark):
    cases = [("https://x.com/me", ""), ("http://a", ""), ("  www.site.com", ""), ("ftp://x", ""),
             ("Jane Doe", "Jane Doe"), (None, "")]
    assert evaluate(spark, clean_author, [c[0] for c in cases]) == [c[1] for c in cases]


def test_paragraph_html(spark):
    assert evaluate(spark, paragraph_html, [c[0] for c in PARAGRAPH_CASES]) == [c[1] for c in PARAGRAPH_CASES]


def test_insert_image(spark):
    """The figure needs a slug and three pieces (what stands between closing tags
    of paragraphs) that are not blank."""
    harbour = "<p>Ships left.</p>\n<p>Gulls stayed.</p>\n<p>Night fell.</p>\n"
    cases = [
        (harbour, "img-1", True),
        ("", "img-1", False),
        ("<p>No slug.</p>\n" * 4, "", False),
        ("<p>Alone</p>", "img-1", False),
        ("<p>A pair:</p>\n<p>of two</p>", "img-1", False),
    ]
    df = spark.createDataFrame([(i, h, s) for i, (h, s, _) in enumerate(cases)], "i int, h string, s string")
    got = [r[0] for r in df.orderBy("i").select(insert_image("h", F.lit("https://img.example"), "s")).collect()]
    for (html, slug, want), out in zip(cases, got):
        if want:
            assert '<figure class="article-image"' in out and "https://img.example/images/img-1" in out
            assert 'loading="lazy"' in out and out.count("</p>") >= html.count("</p>")
            # figure sits after the middle piece: 4 pieces -> after index 2 (second-to-last paragraph)
            assert out.index("<figure") > out.index("Gulls stayed.</p>")
        else:
            assert out == html


def test_effective_date_precedence(spark):
    cases = [
        ('{"scraper_metadata":{"publish_date":"2024-03-01T10:00:00Z"},"additional_metadata":{"date":"2024-01-15"}}',
         dt.datetime(2024, 3, 1, 10)),
        ('{"scraper_metadata":{"publish_date":"bad"},"additional_metadata":{"date":"2024-01-15"}}', dt.datetime(2024, 1, 15)),
        ('{"additional_metadata":{"published_date":"2024-02-02 03:04:05"}}', dt.datetime(2024, 2, 2, 3, 4, 5)),
        ('{"scraper_metadata":{"published_date":"2024-02-02T03:04:05.123456+02:00"}}', dt.datetime(2024, 2, 2, 1, 4, 5, 123456)),
        ('{"scraper_metadata":{"publish_date":"2024"}}', dt.datetime(2024, 4, 1)),
        ('{"scraper_metadata":{"publish_date":"2024-1-5"}}', dt.datetime(2024, 4, 1)),
        ('{"scraper_metadata":{"publish_date":20240105}}', dt.datetime(2024, 4, 1)),
        ('{"scraper_metadata":{"publish_date":"2024-02-30"}}', dt.datetime(2024, 4, 1)),
        ('{"scraper_metadata":{"publish_date":"2024-02-02t03:04:05Z"}}', dt.datetime(2024, 4, 1)),
        ('{"scraper_metadata":"x"}', dt.datetime(2024, 4, 1)),
        ("{}", dt.datetime(2024, 4, 1)),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string").withColumn(
        "c", F.to_timestamp(F.lit("2024-04-01 00:00:00"))
    )
    got = [r[0] for r in df.orderBy("i").select(F.date_format(effective_date("m", "c"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()]
    assert got == [w.strftime("%Y-%m-%d %H:%M:%S.%f") for _, w in cases]
    from folio.functions.dates import date_objects

    once = df.withColumn("o", date_objects("m")).orderBy("i").select(
        F.date_format(effective_date("m", "c", objects=F.col("o")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert [r[0] for r in once.collect()] == got


def test_bucket_width():
    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    assert [bucket_width(t0, t0 + d) for d in (h * 5, h * 24, h * 24 * 6, h * 24 * 7, h * 24 * 29, h * 24 * 30, h * 24 * 89, h * 24 * 90)] == [
        3600, 10800, 10800, 21600, 21600, 86400, 86400, 172800
    ]


def test_score_gate_and_size(spark):
    df = spark.createDataFrame(
        [(0.8, ["technical", "education"]), (0.3, ["social_media"]), (0.0, ["image", "media"]), (0.5, None)],
        "s double, c array<string>",
    )
    assert [r[0] for r in df.select(score_gate("s", "c")).collect()] == ["accepted", "rejected", "image", "accepted"]
    assert list(spark.range(1).select(size_factor(F.lit(0.0)), size_factor(F.lit(1.0))).collect()[0]) == [0.5, 2.0]


def test_best_image(spark):
    df = spark.createDataFrame(
        [([("a", 0.2), ("b", None), ("c", 0.9), ("d", 0.9), (None, 5.0), ("", 7.0)],), ([],), (None,)],
        "imgs array<struct<slug:string,relevance_score:double>>",
    )
    assert [r[0] for r in df.select(best_image("imgs")).collect()] == ["c", None, None]


def test_jsonld_builders(spark):
    import json

    from folio.operators.publish import article_jsonld, breadcrumb_jsonld, web_page_jsonld

    df = spark.createDataFrame(
        [("T", "", "https://x/c/a", dt.datetime(2024, 5, 1, 12, 0), "", ["k"]), ("U", "d", "", None, "Ann", [])],
        "t string, d string, u string, p timestamp, a string, k array<string>",
    )
    pages = [json.loads(r[0]) for r in df.select(web_page_jsonld(F.col("t"), F.col("d"), F.col("u"), F.col("p"), F.col("p"))).collect()]
    assert pages[0] == {"@context": "https://schema.org", "@type": "WebPage", "name": "T", "url": "https://x/c/a",
                        "datePublished": "2024-05-01T12:00:00Z", "dateModified": "2024-05-01T12:00:00Z"}
    assert pages[1] == {"@context": "https://schema.org", "@type": "WebPage", "name": "U", "description": "d"}
    arts = [json.loads(r[0]) for r in df.select(article_jsonld(F.col("t"), F.col("d"), F.col("a"), F.col("p"),
                                                               F.array().cast("array<string>"), F.col("k"), F.lit(""), F.col("u"))).collect()]
    assert "author" not in arts[0] and arts[0]["keywords"] == ["k"] and "articleBody" not in arts[0] and "image" not in arts[0]
    assert arts[1]["author"] == {"@type": "Person", "name": "Ann"} and "keywords" not in arts[1] and "datePublished" not in arts[1]
    crumbs = spark.createDataFrame([([(1, "Home", "https://x"), (2, "Here", "")],)],
                                   "i array<struct<position:int,name:string,item:string>>")
    b = json.loads(crumbs.select(breadcrumb_jsonld(F.col("i"))).collect()[0][0])
    assert b["itemListElement"] == [{"@type": "ListItem", "position": 1, "name": "Home", "item": "https://x"},
                                    {"@type": "ListItem", "position": 2, "name": "Here"}]


def test_slugify_fuzz_against_nfd_model(spark):
    """Random strings over Latin, Latin-extended, combining marks, Greek,
    Cyrillic and case-mapping oddities: the translate table must agree with
    lower → NFD → drop nonspacing marks → NFC → keep [a-z0-9-]."""
    import random
    import re
    import unicodedata

    rng = random.Random(7)
    pools = [range(0x20, 0x7F), range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0x300, 0x370),
             range(0x370, 0x400), range(0x400, 0x460), [0x2126, 0x212A, 0x212B, 0x130, 0xDF], [0x20, 0x5F, 0x2D, 0x9]]
    samples = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 130))) for _ in range(600)]

    def model(s):
        s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s.lower())
                                                  if unicodedata.category(c) != "Mn"))
        s = re.sub("-+", "-", re.sub("[^a-z0-9-]+", "", s.replace(" ", "-").replace("_", "-"))).strip("-")
        return s[:100].rstrip("-") if len(s) > 100 else s

    assert evaluate(spark, slugify, samples) == [model(s) for s in samples]
