"""Tag index, point lookups, and documents merged on read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import documents as D
from folio.operators import merges as MG
from folio.operators import tag_index as TI
from folio.sources import lookup as LU
from folio.sources.merge_on_read import DocumentLog

AS_OF = dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
DOCS = "id string, tags array<string>, metadata string, slug string, seo_enabled boolean, tombstone_at timestamp, source_type string"


def docs_of(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["edu", "education", "ml", "machine", "50%_off", "Émile", "", "hot"]
    rows = []
    for i in range(n):
        tags = rng.sample(words[:-1], rng.randrange(4)) + (["hot", "hot"] if i % 3 == 0 else []) + ([None] if i % 7 == 0 else [])
        meta = '{"a": %d, "deep": {"x": [1, 2.5, null]}}' % i if i % 5 else None
        rows.append((f"d{i}", tags if i % 11 else None, meta, f"s{i}" if i % 2 else None, i % 4 != 0, None, "text"))
    return spark.createDataFrame(rows, DOCS)


def ids(df):
    return [r.id for r in df.collect()]


# ------------------------------------------------------------------ tag index
@pytest.mark.parametrize("buckets", [1, 7])
def test_index_finds_what_a_scan_finds(spark, tmp_path, buckets):
    docs = docs_of(spark, 300).cache()
    path = str(tmp_path / f"index-{buckets}")
    TI.build_tag_index(docs, path, buckets=buckets)
    searches = [(["hot"], False), (["edu", "ml"], False), (["ed"], True), (["%_off", "é"], True), ([], False), ([], True), (["none"], False), ([""], True)]
    for tags, fuzzy in searches:
        expected = ids(D.search_by_tags(docs, tags, fuzzy))
        assert ids(TI.search_by_index(spark, path, tags, fuzzy)) == expected
        assert TI.count_by_index(spark, path, tags, fuzzy).first().n_docs == len(expected)
    counts = {r.tag: r.n_docs for r in TI.indexed_tags(spark, path).collect()}
    assert counts["hot"] == len(ids(D.search_by_tags(docs, ["hot"]))) and None not in counts


def test_index_of_more_documents_than_a_bitmap_holds(spark, tmp_path):
    docs = spark.range(70_000).select(F.concat(F.lit("d"), "id").alias("id"), F.array(F.when(F.col("id") % 10_000 == 7, "rare").otherwise("all")).alias("tags"))
    path = str(tmp_path / "index")
    TI.build_tag_index(docs, path, buckets=1)
    assert ids(TI.search_by_index(spark, path, ["rare"])) == sorted(f"d{i}" for i in range(7, 70_000, 10_000))
    assert TI.count_by_index(spark, path, ["all", "rare"]).first().n_docs == 70_000
    assert spark.read.parquet(f"{path}/postings").filter("tag = 'all'").count() == 3  # parts of one bucket


def test_every_bit_position(spark):
    some = [0, 1, 7, 8, 31, 32, 63, 64, 32_767]
    bitmap = spark.createDataFrame([(p,) for p in some], "p long").agg(F.bitmap_construct_agg("p").alias("b"))
    assert sorted(bitmap.select(TI.positions(F.col("b")).alias("p")).first().p) == some


def test_index_with_changes(spark, tmp_path):
    docs = docs_of(spark, 100).cache()
    path = str(tmp_path / "index")
    TI.build_tag_index(docs, path)
    changed = spark.createDataFrame([("d0", None), ("d3", ["new"]), ("d6", ["hot"]), ("d1", ["hot"]), ("added", ["hot"])], "id string, tags array<string>")
    after = docs.select("id", "tags").join(changed, "id", "left_anti").unionByName(changed)
    for tags in (["hot"], ["new"], ["edu"]):
        assert ids(TI.search_by_index(spark, path, tags, changed=changed)) == ids(D.search_by_tags(after, tags))


def test_empty_index(spark, tmp_path):
    TI.build_tag_index(docs_of(spark, 0), str(tmp_path / "index"))
    assert ids(TI.search_by_index(spark, str(tmp_path / "index"), ["hot"])) == []


def test_index_search_reads_no_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    TI.build_tag_index(docs_of(spark, 50), path)
    plan = TI.search_by_index(spark, path, ["ed"], fuzzy=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate explode(tags" not in plan and "Contains(tag,ed)" in plan


# --------------------------------------------------------------------- lookup
def files_read(df):
    """Files that the scans of a finished query opened, and rows they gave."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec":
                found.append((node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()))
            children = node.children()
            todo.extend(children.apply(i) for i in range(children.size()))
    return found


def test_lookups_match_and_skip_files(spark, tmp_path):
    docs = docs_of(spark, 2000).cache()
    path = str(tmp_path / "lookup")
    LU.write_lookup(docs, path, buckets=64)
    wanted = ["d5", "d77", "d1999", "absent", None]
    got = LU.lookup_documents(spark, path, wanted, buckets=64)
    same = D.get_documents(docs, wanted)
    key = ["requested_id", "found", "metadata"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, same.select(key).collect()))
    scans = files_read(got)
    assert sum(n for n, _ in scans) <= 4 and sum(r for _, r in scans) < 400  # of 64 files, 2000 rows
    slugs = spark.createDataFrame([("s5",), ("s77",), ("s4",), ("none",), (None,)], "slug string")
    for published in (False, True):
        a = LU.lookup_slugs(spark, path, slugs, published, buckets=64).select("requested_slug", "found", "id")
        b = D.get_by_slug(docs, slugs, published).select("requested_slug", "found", "id")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert LU.lookup_documents(spark, path, [], buckets=64).count() == 0


# -------------------------------------------------------------- merge on read
def rows_of(df):
    cols = ["id", "tags", "metadata", "seo_enabled", "tombstone_at"]
    return {r.id: (r.tags, r.metadata, r.seo_enabled, r.tombstone_at) for r in df.select(cols).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_on_read_equals_snapshots(spark, tmp_path, seed):
    """Random batches of changes, against the operators that write snapshots."""
    rng = random.Random(seed)
    docs = docs_of(spark, 40).cache()
    log = DocumentLog(spark, f"mor_{seed}", str(tmp_path / "log"), buckets=4).create(docs)
    now = docs
    for seq in range(1, 9):
        some = rng.sample([f"d{i}" for i in range(40)], 15) + ["absent"]
        frame = spark.createDataFrame([(x,) for x in some], "id string")
        kind = rng.choice(["tags", "seo", "metadata", "tombstone", "untombstone"])
        if kind == "tags":
            ch = spark.createDataFrame([(x, rng.choice([["spam", "a"], ["b"], []])) for x in some], "id string, tags array<string>")
            log.replace_tags(ch, seq=seq, trigger_tags=["spam"], as_of=AS_OF + dt.timedelta(days=seq))
            now = MG.replace_tags(now, ch, trigger_tags=["spam"], as_of=AS_OF + dt.timedelta(days=seq)).documents
        elif kind == "seo":
            ch = frame.withColumn("seo_enabled", F.lit(rng.random() < 0.5))
            log.set_seo(ch, seq=seq)
            now = MG.set_seo(now, ch).documents
        elif kind == "metadata":
            texts = ['{"tombstone_datetime":"2024-03-01T00:00:00Z"}', '{"n":1}', None]
            ch = spark.createDataFrame([(x, rng.choice(texts)) for x in some], "id string, metadata string")
            log.set_metadata(ch, seq=seq)
            now = MG.set_metadata(now, ch).documents
        elif kind == "tombstone":
            log.tombstone(frame, seq=seq, as_of=AS_OF + dt.timedelta(days=seq))
            now = MG.tombstone(now, frame, as_of=AS_OF + dt.timedelta(days=seq)).documents
        else:
            log.untombstone(frame, seq=seq)
            now = MG.untombstone(now, frame).documents
        if seq == 4:
            assert [r.id for r in log.missing().collect()] == ["absent"]
            log = log.compact()
    expected, got = rows_of(now), rows_of(log.read())
    normal = lambda text: None if text is None else sorted(__import__("json").loads(text).items())
    assert expected.keys() == got.keys()
    for k, (tags, meta, seo, tomb) in expected.items():
        assert got[k][0] == tags and got[k][2] == seo and got[k][3] == tomb and normal(got[k][1]) == normal(meta), (k, got[k], expected[k])


def test_merge_on_read_deletes_and_repeats(spark, tmp_path):
    docs = docs_of(spark, 20)
    log = DocumentLog(spark, "mor_delete", str(tmp_path / "log"), buckets=4).create(docs)
    assert rows_of(log.read()) == rows_of(docs)
    log.delete(spark.createDataFrame([("d1",), ("d1",)], "id string"), seq=1)
    log.set_seo(spark.createDataFrame([("d1", True), ("d2", None)], "id string, seo_enabled boolean"), seq=2)
    got = rows_of(log.read())
    assert "d1" not in got and got["d2"][2] is None and len(got) == 19
    with pytest.raises(Exception, match="different changes"):
        log.set_seo(spark.createDataFrame([("d3", True), ("d3", False)], "id string, seo_enabled boolean"), seq=3)


def test_merge_on_read_shuffles_neither_side(spark, tmp_path):
    log = DocumentLog(spark, "mor_plan", str(tmp_path / "log"), buckets=4).create(docs_of(spark, 20))
    log.set_seo(spark.createDataFrame([("d1", True)], "id string, seo_enabled boolean"), seq=1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = log.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
