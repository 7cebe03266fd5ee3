"""Batch merges (R55-R57, R61-R64, R34) on small tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from folio.operators import merges as MG
from folio.sources.fixtures import DOC_COLUMNS

UTC = dt.timezone.utc
AS_OF = dt.datetime(2025, 11, 1, tzinfo=UTC)
T0 = dt.datetime(2025, 10, 31, 12, 0)
SCHEMA = (
    "id string, created_at timestamp, effective_date timestamp, source_type string, source_url string, "
    "scraper_uuid string, textanalyzer_uuid string, tags array<string>, metadata string, slug string, "
    "seo_enabled boolean, tombstone_at timestamp"
)


def make_docs(spark, rows):
    full = []
    for r in rows:
        d = dict(created_at=T0, effective_date=T0, source_type="url", source_url=None, scraper_uuid=None,
                 textanalyzer_uuid="", tags=[], metadata="{}", slug=None, seo_enabled=True, tombstone_at=None)
        d.update(r)
        full.append(tuple(d[c] for c in DOC_COLUMNS))
    return spark.createDataFrame(full, SCHEMA)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_replace_tags_trigger(spark):
    meta = json.dumps({"nested": {"k": [1, 2]}, "num": 1.5, "keep": "yes"})
    docs = make_docs(spark, [dict(id="a", metadata=meta), dict(id="b"), dict(id="c", metadata=meta)])
    ch = spark.createDataFrame([("a", ["spam", "normal-tag"]), ("b", ["Low-Quality"]), ("zz", ["x"])], "id string, tags array<string>")
    res = MG.replace_tags(docs, ch, trigger_tags=["spam", "low-quality"], period_days=60, as_of=AS_OF)
    out = by_id(res.documents)
    m = json.loads(out["a"]["metadata"])
    assert m["tombstone_reason"] == "auto-tombstone: spam tag"
    assert m["tombstone_datetime"] == "2025-12-31T00:00:00Z"
    assert m["nested"] == {"k": [1, 2]} and m["num"] == 1.5 and m["keep"] == "yes"
    assert out["a"]["tombstone_at"] == dt.datetime(2025, 12, 31)
    assert out["b"]["tags"] == ["Low-Quality"] and json.loads(out["b"]["metadata"]) == {}
    assert out["c"]["metadata"] == meta and out["c"]["tags"] == []
    assert [r.id for r in res.missing.collect()] == ["zz"]


def test_trigger_removal_keeps_tombstone(spark):
    docs = make_docs(spark, [dict(id="a")])
    first = MG.replace_tags(docs, spark.createDataFrame([("a", ["spam"])], "id string, tags array<string>"),
                            trigger_tags=["spam"], as_of=AS_OF).documents
    second = MG.replace_tags(first, spark.createDataFrame([("a", ["clean"])], "id string, tags array<string>"),
                             trigger_tags=["spam"], as_of=AS_OF).documents
    r = second.collect()[0]
    assert r.tags == ["clean"] and json.loads(r.metadata)["tombstone_reason"] == "auto-tombstone: spam tag"


def test_tombstone_untombstone(spark):
    docs = make_docs(spark, [dict(id="a", metadata='{"tombstone_reason":"r","x":1}'), dict(id="b")])
    t = MG.tombstone(docs, spark.createDataFrame([("a",), ("missing",)], "id string"), period_days=90, as_of=AS_OF)
    assert [r.id for r in t.missing.collect()] == ["missing"]
    a = by_id(t.documents)["a"]
    assert json.loads(a.metadata) == {"tombstone_reason": "r", "x": 1, "tombstone_datetime": "2026-01-30T00:00:00Z"}
    u = MG.untombstone(t.documents, spark.createDataFrame([("a",)], "id string")).documents
    a2 = by_id(u)["a"]
    assert json.loads(a2.metadata) == {"tombstone_reason": "r", "x": 1} and a2.tombstone_at is None


def test_set_seo_and_metadata(spark):
    docs = make_docs(spark, [dict(id="a"), dict(id="b")])
    s = MG.set_seo(docs, spark.createDataFrame([("a", False)], "id string, seo_enabled boolean")).documents
    assert {r.id: r.seo_enabled for r in s.collect()} == {"a": False, "b": True}
    m = MG.set_metadata(docs, spark.createDataFrame([("b", '{"tombstone_datetime":"2025-11-02T00:00:00Z"}')], "id string, metadata string")).documents
    assert by_id(m)["b"].tombstone_at == dt.datetime(2025, 11, 2)


def _result(job, status, analysis, arrived):
    return (job, status, json.dumps(analysis), arrived)


RES_SCHEMA = "job_id string, status string, analysis string, arrived_at timestamp"


def test_apply_analysis_fields_and_tiers(spark):
    docs = make_docs(spark, [
        dict(id="sev", textanalyzer_uuid="j1", tags=["scrape", "Technology"],
             metadata=json.dumps({"analyzer_metadata": {"old": 1}, "scraper_metadata": {"title": "t"}})),
        dict(id="std", textanalyzer_uuid="j2", seo_enabled=False),
        dict(id="ok", textanalyzer_uuid="j3"),
        dict(id="pending", textanalyzer_uuid="j4"),
        dict(id="none"),
        dict(id="empty", textanalyzer_uuid="j5"),
    ])
    results = spark.createDataFrame([
        _result("j1", "completed", {"tags": ["technology", "golang", 7], "synopsis": "S", "cleaned_text": "C",
                                    "heuristic_cleaned_text": "H", "editorial_analysis": 5, "ai_detection": {"p": 0.1},
                                    "quality_score": {"score": 0.2}}, T0),
        _result("j2", "completed", {"quality_score": {"score": 0.3}}, T0),
        _result("j3", "completed", {"quality_score": {"score": "0.1"}}, T0),
        _result("j4", "processing", {}, T0),
        ("j5", "completed", "null", T0),
    ], RES_SCHEMA)
    out = by_id(MG.apply_analysis(docs, results, as_of=AS_OF).documents)
    sev = json.loads(out["sev"].metadata)
    am = sev["analyzer_metadata"]
    assert am == {"old": 1, "ai_tags": ["technology", "golang", 7], "synopsis": "S", "cleaned_text": "C",
                  "heuristic_cleaned_text": "H", "ai_detection": {"p": 0.1}}
    assert sev["quality_score"] == {"score": 0.2} and sev["textanalyzer_status"] == "completed"
    assert sev["tombstone_reason"] == "Low quality score: 0.20" and sev["scraper_metadata"] == {"title": "t"}
    assert out["sev"].tags == ["scrape", "Technology", "golang"] and out["sev"].seo_enabled is False
    assert out["sev"].tombstone_at == dt.datetime(2025, 11, 8)
    assert out["std"].seo_enabled is True and out["std"].tombstone_at == dt.datetime(2025, 12, 1)
    assert "tombstone_reason" not in json.loads(out["ok"].metadata)  # a string score is not a number
    assert json.loads(out["pending"].metadata) == {}
    assert json.loads(out["empty"].metadata) == {}  # completed without an analysis object: not applied


def test_enrich_wait_rules(spark):
    docs = make_docs(spark, [
        dict(id="fast", textanalyzer_uuid="j1", metadata='{"textanalyzer_status":"queued"}'),
        dict(id="late", textanalyzer_uuid="j2", metadata='{"textanalyzer_status":"queued"}'),
        dict(id="never", textanalyzer_uuid="j3", metadata='{"textanalyzer_status":"queued"}'),
        dict(id="young", textanalyzer_uuid="j4", metadata='{"textanalyzer_status":"queued"}',
             created_at=dt.datetime(2025, 10, 31, 23, 30)),
        dict(id="done", textanalyzer_uuid="j5", metadata='{"textanalyzer_status":"completed"}'),
    ])
    results = spark.createDataFrame([
        _result("j1", "completed", {"tags": ["x"]}, T0 + dt.timedelta(minutes=60)),
        _result("j2", "completed", {"tags": ["x"]}, T0 + dt.timedelta(minutes=61)),
    ], RES_SCHEMA)
    out = by_id(MG.enrich(docs, results, as_of=AS_OF, max_wait_minutes=60))
    assert {k: v.enrich_outcome for k, v in out.items()} == {
        "fast": "applied", "late": "timeout", "never": "timeout", "young": "waiting", "done": None}
    late = json.loads(out["late"].metadata)
    assert late == {"textanalyzer_status": "failed", "analysis_retrieval_timeout": True, "analysis_retrieval_elapsed_minutes": 61}
    assert json.loads(out["never"].metadata)["analysis_retrieval_elapsed_minutes"] == 720
    assert out["fast"].tags == ["x"]


def test_quality_tombstone(spark):
    docs = make_docs(spark, [
        dict(id="a", metadata='{"quality_score":{"score":0.1}}', seo_enabled=True),
        dict(id="b", metadata='{"quality_score":{"score":0.34}}', seo_enabled=False),
        dict(id="c", metadata='{"quality_score":{"score":0.35}}'),
        dict(id="d", metadata='{"quality_score":{"score":0}}'),
    ])
    out = by_id(MG.quality_tombstone(docs, as_of=AS_OF))
    assert (out["a"].seo_enabled, out["b"].seo_enabled) == (False, True)
    assert json.loads(out["b"].metadata)["tombstone_reason"] == "Low quality score: 0.34"
    assert out["c"].tombstone_at is None and out["d"].tombstone_at is None


def test_delete_documents(spark):
    docs = make_docs(spark, [dict(id="a"), dict(id="b")])
    jobs = spark.createDataFrame([("j1", "a"), ("j2", "b"), ("j3", None)], "id string, result_request_id string")
    res = MG.delete_documents(docs, jobs, spark.createDataFrame([("a",), ("nope",)], "id string"))
    assert [r.id for r in res.documents.collect()] == ["b"]
    assert {r.id: r.result_request_id for r in res.jobs.collect()} == {"j1": None, "j2": "b", "j3": None}
    assert [r.id for r in res.missing.collect()] == ["nope"]


def test_repeated_change_ids_give_one_row_each(spark):
    import pytest

    docs = make_docs(spark, [dict(id="a"), dict(id="b")])
    ch = spark.createDataFrame([("a", ["one"], 1), ("a", ["two"], 2), ("b", ["x"], 1), ("b", ["x"], 1), ("zz", ["x"], 1)], "id string, tags array<string>, n int")
    out = MG.replace_tags(docs, ch, as_of=AS_OF, order="n")
    assert {r.id: list(r.tags) for r in out.documents.collect()} == {"a": ["two"], "b": ["x"]} and out.documents.count() == 2
    assert [r.id for r in out.missing.collect()] == ["zz"]
    with pytest.raises(Exception, match="different changes for one key"):
        MG.replace_tags(docs, ch, as_of=AS_OF).documents.collect()
    same = ch.filter("id = 'b'")
    assert MG.replace_tags(docs, same, as_of=AS_OF).documents.count() == 2
    seo = spark.createDataFrame([("a", False), ("a", False)], "id string, seo_enabled boolean")
    assert MG.set_seo(docs, seo).documents.count() == 2


def test_malformed_metadata_fails_instead_of_vanishing(spark):
    import pytest

    ids = spark.createDataFrame([("a",)], "id string")
    for broken in ('{"a":1', "[1,2]", "7", '"text"', "nonsense"):
        docs = make_docs(spark, [dict(id="a", metadata=broken)])
        with pytest.raises(Exception, match="not a JSON object"):
            MG.tombstone(docs, ids, as_of=AS_OF).documents.collect()
    for blank in (None, "", "  ", "{}"):
        docs = make_docs(spark, [dict(id="a", metadata=blank)])
        assert json.loads(MG.tombstone(docs, ids, as_of=AS_OF).documents.first()["metadata"]).keys() == {"tombstone_datetime"}


def test_first_completed_result_wins(spark):
    docs = make_docs(spark, [dict(id=i, textanalyzer_uuid=f"j{i}", metadata='{"textanalyzer_status":"queued"}') for i in "abc"])
    at = lambda m: T0 + dt.timedelta(minutes=m)
    good = '{"tags":["first"]}'
    res = spark.createDataFrame(
        [("ja", "completed", good, at(10)), ("ja", "completed", '{"tags":["second"]}', at(90)),
         ("jb", "completed", good, at(10)), ("jb", "processing", None, at(20)),
         ("jc", "completed", "no object", at(5)), ("jc", "completed", good, at(30))],
        "job_id string, status string, analysis string, arrived_at timestamp")
    out = by_id(MG.enrich(docs, res, as_of=AS_OF))
    assert {i: (r["enrich_outcome"], list(r["tags"])) for i, r in out.items()} == {i: ("applied", ["first"]) for i in "abc"}
    assert {i: list(r["tags"]) for i, r in by_id(MG.apply_analysis(docs, res, as_of=AS_OF).documents).items()} == {i: ["first"] for i in "abc"}


def test_job_walk_ends_on_cycles_and_reaches_any_depth(spark):
    from folio.operators import jobs as J

    rows = [("1", "2"), ("2", "1"), ("3", "2")] + [(f"c{i}", f"c{i - 1}" if i else None) for i in range(8)]
    jobs = spark.createDataFrame(rows, "id string, parent_job_id string")
    assert sorted((r.id, r.level) for r in J.job_descendants(jobs, ["1"]).collect()) == [("1", 0), ("2", 1), ("3", 2)]
    assert sorted(r.level for r in J.job_descendants(jobs, ["c0"]).collect()) == list(range(8))
    assert [r.id for r in J.missing_jobs(jobs, ["1", "nope"]).collect()] == ["nope"]


def test_links_of_every_form(spark):
    from folio.operators.crawl import page_links

    html = """<LINK HREF="/style.css"><A HREF='one.html'>1</A> <a class="x>y" href=two?a=1&amp;b=2>2</a><a
      href="../up/./three">3</a><abbr href="no">n</abbr><a name="none">4</a><a href="#top">5</a>"""
    pages = spark.createDataFrame([(1, "http://s.test/a/b/page", html)], "page_id long, url string, html string")
    assert [r.link for r in page_links(pages).orderBy("pos").collect()] == [
        "http://s.test/a/b/one.html", "http://s.test/a/b/two?a=1&b=2", "http://s.test/a/up/three", "http://s.test/a/b/page"]
