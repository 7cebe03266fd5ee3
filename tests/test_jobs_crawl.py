"""Jobs (R27-R30, R65-R67) and crawl steps."""

import datetime as dt
import json

from pyspark.sql import functions as F

from folio.operators import crawl, jobs as J

UTC = dt.timezone.utc
T0 = dt.datetime(2025, 1, 1)
JOB_SCHEMA = (
    "id string, url string, extract_links boolean, status string, retries int, created_at timestamp, "
    "updated_at timestamp, completed_at timestamp, error_message string, result_request_id string, "
    "asynq_task_id string, parent_job_id string, depth int"
)


def job(i, parent=None, depth=0, status="queued", minutes=0):
    t = T0 + dt.timedelta(minutes=minutes)
    return (i, f"http://x/{i}", True, status, 0, t, t, None, None, None, None, parent, depth)


def tree(spark):
    rows = [job("p1", minutes=1), job("p2", minutes=2), job("c1", "p1", 1, minutes=5), job("c2", "p1", 1, minutes=3),
            job("g1", "c1", 2, "failed", minutes=9)]
    return spark.createDataFrame(rows, JOB_SCHEMA)


def test_jobs_with_children(spark):
    out = J.jobs_with_children(tree(spark), limit=50).collect()
    assert [(r.parent_id, r.child_id) for r in out] == [("p2", None), ("p1", "c2"), ("p1", "c1")]


def test_child_jobs_and_descendants(spark):
    jobs = tree(spark)
    assert [r.id for r in J.child_jobs(jobs, ["p1"]).collect()] == ["c2", "c1"]
    desc = {r.id: r.level for r in J.job_descendants(jobs, ["p1"]).collect()}
    assert desc == {"p1": 0, "c1": 1, "c2": 1, "g1": 2}
    assert sorted(r.id for r in J.delete_jobs(jobs, ["c1"]).collect()) == ["c2", "p1", "p2"]
    assert [r.id for r in J.retryable_jobs(jobs).collect()] == ["g1"]


def test_apply_job_events(spark):
    jobs = spark.createDataFrame([job("a"), job("b"), job("c", status="failed"), job("d")], JOB_SCHEMA)
    t = lambda m: T0 + dt.timedelta(minutes=m)
    ev = spark.createDataFrame([
        ("a", t(1), 1, "processing", None, ""), ("a", t(2), 2, "failed", None, "boom"), ("a", t(3), 3, "retry", None, ""),
        ("b", t(1), 1, "processing", None, ""), ("b", t(2), 2, "completed", "doc-9", ""), ("b", t(3), 3, "retry", None, ""),
        ("c", t(1), 1, "retry", None, ""),
        ("d", t(1), 1, "failed", None, "x"), ("d", t(2), 2, "failed", None, "y"),
    ], "job_id string, ts timestamp, seq long, event string, result_request_id string, message string")
    out = {r.id: r for r in J.apply_job_events(jobs, ev).collect()}
    tasks = ev.withColumn("task_id", F.lit(None).cast("string")).unionByName(
        spark.createDataFrame([("d", t(5), 5, "task", None, "", "task-7")],
                              "job_id string, ts timestamp, seq long, event string, result_request_id string, message string, task_id string"))
    with_task = {r.id: r for r in J.apply_job_events(jobs, tasks).collect()}
    assert with_task["d"].asynq_task_id == "task-7" and with_task["d"].status == "failed" and with_task["a"].asynq_task_id is None
    assert (out["a"].status, out["a"].retries, out["a"].error_message, out["a"].completed_at) == ("queued", 1, "", None)
    assert (out["b"].status, out["b"].result_request_id, out["b"].completed_at) == ("completed", "doc-9", t(2))
    assert (out["c"].status, out["c"].retries) == ("queued", 0)
    assert (out["d"].status, out["d"].retries, out["d"].error_message) == ("failed", 2, "y")


def test_expand_frontier_depth_rule(spark):
    # (depth, max, extract) -> child extract flag, from the reference's cases
    cases = [(0, 1, True, True), (1, 1, True, None), (0, 2, True, True), (1, 2, True, True), (2, 2, True, None), (0, 1, False, None)]
    for depth, mx, extract, expect_children in cases:
        parents = spark.createDataFrame([("p", depth, extract, 1)], "id string, depth int, extract_links boolean, page_id long")
        links = spark.createDataFrame([(1, 0, "https://a.example/x"), (1, 1, "mailto:x@y"), (1, 2, "https://a.example/i.png")],
                                      "page_id long, pos int, link string")
        out = crawl.expand_frontier(parents, links, max_depth=mx).collect()
        if expect_children is None:
            assert out == []
        else:
            assert len(out) == 1 and out[0].depth == depth + 1 and out[0].extract_links == (depth + 1 < mx)


def test_page_links(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.example/dir/page.html?q=1", '<a href="/abs">x</a><a href="rel/x">y</a><a href="//cdn.example/z">z</a><a href="mailto:a@b">m</a>')],
        "page_id long, url string, html string",
    )
    out = [r.link for r in crawl.page_links(pages).orderBy("pos").collect()]
    assert out == ["https://h.example/abs", "https://h.example/dir/rel/x", "https://cdn.example/z", "mailto:a@b"]


def test_seen_url_split(spark):
    as_of = dt.datetime(2025, 2, 1, tzinfo=UTC)
    new = spark.createDataFrame([("https://E.com/a/?utm_source=x",), ("https://e.com/b",), ("bad url",)], "url string")
    seen = spark.createDataFrame([
        ("https://e.com/a", "s-old", dt.datetime(2025, 1, 10)), ("https://e.com/a#f", "s-new", dt.datetime(2025, 1, 20)),
        ("https://e.com/b", "s-expired", dt.datetime(2024, 12, 1)),
    ], "url string, scraper_uuid string, seen_at timestamp")
    out = {r.url: (r.cached, r.cached_scraper_uuid) for r in crawl.seen_url_split(new, seen, as_of=as_of).collect()}
    assert out == {"https://E.com/a/?utm_source=x": (True, "s-new"), "https://e.com/b": (False, None), "bad url": (False, None)}


def test_low_score_and_text_documents(spark):
    as_of = dt.datetime(2025, 2, 1, tzinfo=UTC)
    rej = spark.createDataFrame([("https://www.x.com/p", 0.3, "meh", ["social_media", "a-b-c"], False, [])],
                                "url string, score double, reason string, categories array<string>, is_recommended boolean, malicious_indicators array<string>")
    d = crawl.low_score_documents(rej, threshold=0.5, as_of=as_of).collect()[0]
    m = json.loads(d.metadata)
    assert d.tags == ["social_media", "a-b", "x.com", "scrape"] and d.seo_enabled is False and d.slug is None
    assert m["below_threshold"] is True and m["threshold"] == 0.5 and m["tombstone_datetime"] == "2025-03-03T00:00:00Z"
    texts = spark.createDataFrame([("t1", "Héllo wörld, this is text")], "text_id string, text string")
    res = spark.createDataFrame([("t1", json.dumps({"tags": ["News-Today-Now", 3], "cleaned_text": ""}))], "text_id string, analysis string")
    td = crawl.text_documents(texts, res, as_of=as_of).collect()[0]
    assert td.tags == ["News-Today"] and td.slug == "hello-world-this-is-text"
    assert json.loads(td.metadata)["original_text"] == "Héllo wörld, this is text"


def test_crawl_step(spark):
    as_of = dt.datetime(2025, 2, 1, tzinfo=UTC)
    new = spark.createDataFrame([("https://a.example/x",), ("https://a.example/y",), ("https://b.example/cached",),
                                 ("https://c.example/pic.png",), ("https://d.example/clash",)], "url string")
    scores = spark.createDataFrame([
        ("https://a.example/x", 0.9, "good", ["news"], True, []),
        ("https://a.example/y", 0.1, "bad", ["spam-farm-x"], False, []),
        ("https://c.example/pic.png", 0.0, "img", ["image"], False, []),
        ("https://d.example/clash", 0.8, "ok", ["tech"], True, []),
    ], "url string, score double, reason string, categories array<string>, is_recommended boolean, malicious_indicators array<string>")
    scrapes = spark.createDataFrame([
        ("https://a.example/x", "s1", "Hello World", "body", "", None, None, ""),
        ("https://c.example/pic.png", "s2", "", "", "", None, None, "pic-slug"),
        ("https://d.example/clash", "s3", "Taken Title", "", "", None, None, ""),
    ], "url string, scrape_id string, title string, content string, raw_text string, page_metadata string, page_score string, slug string")
    seen = spark.createDataFrame([("https://b.example/cached", "s0", dt.datetime(2025, 1, 25))],
                                 "url string, scraper_uuid string, seen_at timestamp")
    existing = spark.createDataFrame([("old", "taken-title", dt.datetime(2024, 1, 1))], "id string, slug string, created_at timestamp")
    step = crawl.crawl_step(new, scores, scrapes, seen, existing, as_of=as_of)
    docs = {r.source_url: r for r in step.documents.collect()}
    assert set(docs) == {"https://a.example/x", "https://a.example/y", "https://c.example/pic.png"}
    assert docs["https://a.example/x"].slug == "hello-world" and docs["https://a.example/x"].seo_enabled
    assert docs["https://a.example/y"].seo_enabled is False and docs["https://a.example/y"].tags == ["spam-farm", "a.example", "scrape"]
    assert docs["https://c.example/pic.png"].slug == "pic-slug" and docs["https://c.example/pic.png"].textanalyzer_uuid == ""
    assert [r.source_url for r in step.conflicts.collect()] == ["https://d.example/clash"]
    outcomes = {r.url: r.outcome for r in step.outcomes.collect()}
    assert outcomes["https://b.example/cached"] == "cached" and outcomes["https://a.example/x"] == "accepted"


def test_page_links_of_any_tag_length(spark):
    """Long tags, unclosed tags and unclosed quotes: no recursion, linear time."""
    long = "".join(f' data-{i}="{"v" * 90}"' for i in range(1000))
    html = [
        f"<a{long} href=/long>x</a> <a href='/next'>",
        "<a " * 10_000 + "<b href=/not> <a href=/after>",
        "<a x" * 10_000,
        "<a title='" + "y" * 100_000 + " <a href=/in-unclosed-quote>",
        "<A\nTITLE=\"a > b href=/quoted\" HREF = /bare>t</A><a data-href=/no><a href=>",
        "<a href=/one <a href=/two>",
        "<a " + "z" * 200_000 + " href=\"/wide\">",
    ]
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id int, url string, html string")
    got = {}
    for r in crawl.page_links(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.pos, r.href))
    assert got == {
        0: [(0, "/long"), (1, "/next")], 1: [(0, "/not"), (1, "/after")], 3: [(0, "/in-unclosed-quote")], 4: [(0, "/bare")],
        5: [(0, "/one"), (1, "/two")], 6: [(0, "/wide")],
    }


def test_seen_urls_need_a_scrape_id(spark):
    seen = spark.createDataFrame(
        [("http://h/a", "s1", T0 - dt.timedelta(days=5)), ("http://h/a", None, T0 - dt.timedelta(days=2)), ("http://h/a", "", T0 - dt.timedelta(days=1)),
         ("http://h/b", "", T0 - dt.timedelta(days=1)), ("http://h/c", None, T0 - dt.timedelta(days=1)), ("http://h/d", "old", T0 - dt.timedelta(days=40))],
        "url string, scraper_uuid string, seen_at timestamp")
    new = spark.createDataFrame([(f"http://h/{x}",) for x in "abcd"], "url string")
    out = crawl.seen_url_split(new, seen, as_of=T0.replace(tzinfo=UTC)).collect()
    assert {r.url[-1]: (r.cached, r.cached_scraper_uuid) for r in out} == {"a": (True, "s1"), "b": (False, None), "c": (False, None), "d": (False, None)}


def test_deep_trees_and_cycles(spark):
    """A chain of 10,000 jobs in at most 16 rounds; cycles and pointers to
    missing jobs end the walk."""
    chain = [(str(i), str(i - 1) if i else None) for i in range(10_000)]
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    rows = chain + ring + [("lost", "nowhere"), ("below", "lost"), ("self", "self"), ("s1", "self")]
    jobs = spark.createDataFrame(rows, "id string, parent_job_id string").repartition(4)
    found, rounds = J._levels(jobs, spark.createDataFrame([("9",), ("r2",), ("lost",)], "id string"))
    assert rounds <= 16
    got = {r.id: r.level for r in found.collect()}
    want = {str(i): i - 9 for i in range(9, 10_000)} | {f"r{i}": (2 - i) % 7 for i in range(7)} | {"lost": 0, "below": 1}
    assert got == want
    nested = {r.id: r.level for r in J.job_descendants(jobs, ["9990", "9995", "no such job"], include_roots=False).collect()}
    assert nested == {str(i): i - (9995 if i > 9995 else 9990) for i in range(9991, 10_000) if i != 9995}


def test_crawl_to_depth(spark):
    """Each cache key once, on the first level that meets it; cycles end; cached
    and rejected pages are not expanded; spellings of one key are one URL."""
    pages = spark.createDataFrame(
        [(i, f"http://h/{n}", 0.1 if n == "bad" else 0.9, ["image"] if n == "pic" else []) for i, n in enumerate(["a", "b", "c", "d", "bad", "pic", "old", "e"])],
        "page_id long, url string, score double, categories array<string>")
    at = {r.url[9:]: r.page_id for r in pages.collect()}
    edges = [("a", "http://h/b?utm_source=x"), ("a", "http://H/b#top"), ("a", "http://h/bad"), ("b", "http://h/a"), ("b", "http://h/c"), ("c", "http://h/d"),
             ("bad", "http://h/e"), ("old", "http://h/e"), ("a", "http://h/pic"), ("pic", "http://h/c/"), ("a", "mailto:x"), ("a", "http://h/x.png"), ("b", "http://h/gone")]
    links = spark.createDataFrame([(at[p], link) for p, link in edges], "page_id long, link string")
    seeds = spark.createDataFrame([("http://h/a",), ("http://h/a#again",), ("http://h/old",), ("ftp://h/a",), ("nothing",)], "url string")
    seen = spark.createDataFrame([("http://h/old", "s", T0 - dt.timedelta(days=1)), ("http://h/b", "s", T0 - dt.timedelta(days=1))], "url string, scraper_uuid string, seen_at timestamp")
    for depth, deep in ((2, {}), (3, {"d": (3, "accepted")}), (9, {"d": (3, "accepted")})):
        found = crawl.crawl(seeds, pages, links, seen, as_of=T0.replace(tzinfo=UTC), max_depth=depth).collect()
        got = {r.url.split("/")[-1].split("?")[0].split("#")[0] if r.outcome != "error" else r.url: (r.depth, r.outcome) for r in found}
        want = {"a": (0, "accepted"), "old": (0, "cached"), "ftp://h/a": (0, "error"), "nothing": (0, "error"), "b": (1, "accepted"), "bad": (1, "rejected"),
                "pic": (1, "image"), "gone": (2, "failed")}
        assert {k: v for k, v in got.items() if k not in ("c", "")} == want | deep
        assert len(found) == len(want | deep) + 1 and [r.depth for r in found if r.page_id == at["c"]] == [2]


def test_crawl_step_scrapes_a_cache_key_once(spark):
    """Of two spellings of one key the second finds it cached."""
    new = spark.createDataFrame([("http://h/a",), ("http://H/a?utm_source=x",), ("http://h/b",)], "url string")
    names = "url string, score double, reason string, categories array<string>, is_recommended boolean, malicious_indicators array<string>"
    scores = spark.createDataFrame([(u, 0.9, "", [], True, []) for u in ("http://h/a", "http://H/a?utm_source=x", "http://h/b")], names)
    scrapes = spark.createDataFrame(
        [(u, f"s{i}", "t", "c", "", None, None, f"slug-{i}") for i, u in enumerate(("http://h/a", "http://H/a?utm_source=x", "http://h/b"))],
        "url string, scrape_id string, title string, content string, raw_text string, page_metadata string, page_score string, slug string")
    seen = spark.createDataFrame([], "url string, scraper_uuid string, seen_at timestamp")
    step = crawl.crawl_step(new, scores, scrapes, seen, as_of=T0.replace(tzinfo=UTC))
    assert sorted(r.source_url for r in step.documents.collect()) == ["http://H/a?utm_source=x", "http://h/b"]
    assert {r.url: r.outcome for r in step.outcomes.collect()} == {"http://H/a?utm_source=x": "accepted", "http://h/a": "cached", "http://h/b": "accepted"}
