"""op1, op6, op9, op5, op4 and the pipeline."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from llm_fixtures import edge_docs, lspark, no_docs  # noqa: F401
from folio.llm import quality_classifier, quality_rules, secret_scan, vector_topk, warc
from folio.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


def same_rows(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def views(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(lspark, name):
    same_rows(QUERIES[name](lspark, SF), views(SF), ORACLES[name])


# op1 -------------------------------------------------------------------------


def test_classifier_separates_held_out_rows(lspark):
    got = QUERIES["op1_quality_classifier"](lspark, BIG)
    assert got.count() == lspark.read.parquet(f"{BIG}/documents.parquet").count()
    rows = got.join(lspark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_an_id_of_many_rows_trains_at_most_the_bound(lspark):
    """Copies of a row train once, and the bound is one of texts."""
    rows = [(i, f"good text {i}" if i % 2 else f"bad words {i}") for i in range(20)]
    labels = lspark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    make = lambda r: lspark.createDataFrame(r, "doc_id long, text string").repartition(3)
    once = quality_classifier.train(make(rows), labels)
    assert (quality_classifier.train(make(rows + [rows[3]] * 50 + [rows[4]]), labels) == once).all()
    low, high = (r["id"] for r in lspark.range(2).selectExpr("id").orderBy(F.xxhash64("id")).collect())
    two = labels.filter("doc_id < 2")
    many = make([(low, "one text")] * 2 + [(high, f"other text {i}") for i in range(100)])
    weights = lambda **a: (quality_classifier.train(many, two, **a)[:-1] != 0).sum()
    # five of the 101 texts train
    assert 0 < weights(max_docs=5) < weights(max_docs=50) < weights()


def test_held_out_labels_never_train(lspark):
    docs, labels = lspark.read.parquet(f"{SF}/documents.parquet"), lspark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality_classifier.quality_scores(docs, labels).collect()
    assert sorted(a) == sorted(quality_classifier.quality_scores(docs, turned).collect())


def test_classifier_edge_cases(lspark, edge_docs, no_docs):
    labels = lspark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality_classifier.quality_scores(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}
    assert len(empty) == 1
    none = labels.limit(0)
    assert {r["score"] for r in quality_classifier.quality_scores(edge_docs, none).collect()} == {0.5}
    assert quality_classifier.quality_scores(no_docs, labels).count() == 0
    kept = quality_classifier.score(edge_docs, quality_classifier.train(edge_docs, labels.withColumnRenamed("quality", "label")))
    assert sorted(kept.columns) == sorted(edge_docs.columns)


# op6 -------------------------------------------------------------------------


def test_rules_on_edge_cases_and_without_python(lspark, edge_docs, no_docs):
    con = duckdb.connect()
    table = edge_docs.select("doc_id", "text").toArrow()
    con.register("documents", table)
    got = quality_rules.quality_rules(edge_docs)
    same_rows(got, con, ORACLES["op6_quality_rules"])
    assert quality_rules.quality_rules(no_docs).count() == 0
    plan = QUERIES["op6_quality_rules"](lspark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_rules_by_brute_force(edge_docs):
    rows = {(r["doc_id"], r["text"]) for r in edge_docs.collect()}
    for r in quality_rules.quality_rules(edge_docs).collect():
        if r["doc_id"] is None or r["doc_id"] == 14:
            continue
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {t for t in tri if tri.count(t) > 1} if len(tri) < 3000 else None
        if often is not None:
            assert r["n_repeat_words"] == len({j for i, t in enumerate(tri) if t in often for j in (i, i + 1, i + 2)})
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))


def test_lines_that_fail(lspark):
    lines = ["A plain line of words here.", "Home | News | Sport | More", "all rights reserved by us", "$$$ ### *** cheap", "BUY NOW TODAY", "wow!! so!! big!!"]
    text = "\n".join(lines)
    row = quality_rules.clean_lines(lspark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["kept_text"] == lines[0] and row["lost_chars"] == sum(map(len, lines[1:])) and row["all_chars"] == sum(map(len, lines))


def test_each_rule_alone(lspark):
    """One line per rule and its nearest line that passes; blank lines stay."""
    fails = [
        "A heading without a sentence", "version 1.2 of x", "ends,", "Home | News | Sport | More words here.",
        "See our PRIVACY POLICY for more.", "Open the Cookie settings now.", "a$$$ ###b c.", "BUY THIS NOW.", "so!! big!! ok!!",
    ]
    passes = [
        "It ends.", "It ends (so.)", "he said \u201cyes.\u201d", "One sentence. Then cut off in the", "\u597d\u7684\u3002\u7136\u540e", "Home | News | it is.",
        "Our policy on privacy is here.", "It costs $5 or so, not more than that.", "NATO met today.", "Wow! It was a good day for us.", "", "  \t", "\r",
    ]
    for line in fails + passes:
        row = quality_rules.clean_lines(lspark.createDataFrame([(1, f"{line}\nok.")], "doc_id long, text string")).first()
        assert row["kept_text"] == ("ok." if line in fails else f"{line}\nok."), line


def test_cleaning_keeps_clashing_columns(lspark):
    schema = "doc_id long, text string, lines string, failed int, row string, kept_text string, `a.b` int"
    rows = [(1, "No end\nAn end.", "x", 1, "y", "z", 2), (2, None, None, None, None, None, None)]
    got = quality_rules.clean_lines(lspark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "lines", "failed", "row", "a.b", "kept_text", "all_chars", "lost_chars"]
    assert sorted(got.collect(), key=lambda r: r["doc_id"])[0][2:] == ("x", 1, "y", 2, "An end.", 13, 6)
    assert quality_rules.clean_lines(lspark.createDataFrame([], schema)).count() == 0


# op9 -------------------------------------------------------------------------

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 2),
    ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile("[0-9a-f]+"), 32, 0),
    ("slack", re.compile("xox[abprs]-[0-9A-Za-z-]+"), 15, 0),
    ("private_key", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
]


def secrets(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, least, group) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(group)) >= least)


def spelled(spans):
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)


def expected_scan(rows):
    out = []
    for i, t in rows:
        spans = secrets(t)
        base = [s for s in spans if s[1] < 3]
        out.append((i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
    return sorted(out, key=repr)


def test_secret_scan_equals_the_expressions(lspark, edge_docs, no_docs):
    import random

    rng = random.Random(1)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdef12", "deadbeef" * 4, "0" * 31, "AKIA" + "A1" * 6, "AKIA",
            "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "-", "é", "\n", ",", "passwd=", "token==abcdefghij", "漢", "hello"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(1, 40)))) for i in range(400)] + [(900, "password=" + "a1" * 3000), (901, "a" * 3000)]
    df = lspark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in secret_scan.secret_digest(df).collect()), key=repr)
    assert got == expected_scan(rows)
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted((tuple(r) for r in secret_scan.secret_digest(edge_docs).collect()), key=repr) == expected_scan(rows)
    assert secret_scan.secret_digest(no_docs).count() == 0


def test_secret_query_and_redaction(lspark, edge_docs):
    rows = [tuple(r) for r in lspark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op9_secret_scan"](lspark, SF).collect()), key=repr) == expected_scan(rows)
    out = secret_scan.redact(edge_docs)
    assert out.columns == edge_docs.columns
    text = out.filter("doc_id = 16").first()["text"]
    assert text == "[SECRET] [SECRET]\npassword:'short' [SECRET]"


def test_automaton_is_minimal_and_rejects_cross_line_rules():
    from folio.llm.automaton import Automaton

    a = Automaton([("(ab|cb)+x", False)], search=False)
    assert a.table.shape[0] == 5  # start, after a or c, after b, after x, dead
    with pytest.raises(ValueError):
        secret_scan.SecretScanner((secret_scan.Rule("bad", "a\\n+b", "a\\nb", 1),))


# op5 -------------------------------------------------------------------------


def test_top_k_edge_cases(lspark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8, 0) for i in range(40)]  # ties
    rows += [(50, [0.1] * 8, 5), (2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1),
             (None, [1.0] * 8, 1), (2050, [3.0], 1), (2100, [], 1)]
    df = lspark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    best = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(np.float32(x).astype(float) * 256)) for x in v]
            best[i] = max(best.get(i, q), q)
    wide = {i: q + [0] * (8 - len(q)) for i, q in best.items()}
    want = []
    for q in (i for i in wide if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(wide[q], wide[i], strict=True)), i) for i in wide if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in vector_topk.top_k(df).collect()) == sorted(want)
    assert vector_topk.top_k(df.limit(0)).count() == 0
    few = lspark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_topk.top_k(few).collect()] == [(0, 1, 1, 131072)]


def test_scores_beyond_64_bits_fail(lspark):
    schema = "vec_id long, embedding array<double>"
    for huge in (1e30, 2.0**24):
        with pytest.raises(ValueError, match="64 bits"):
            vector_topk.top_k(lspark.createDataFrame([(0, [huge, 1.0]), (1, [1.0, 2.0])], schema))
    large = [(i, [float(2**21 + i), -float(i)]) for i in range(60)]
    want = sorted(((-(256 * 256 * (2**21 * (2**21 + i))), i) for i in range(1, 60)))[:5]
    got = vector_topk.top_k(lspark.createDataFrame(large, schema)).filter("query_id = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in want]


def test_copies_of_a_vector_are_searched_once(lspark, monkeypatch):
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [i / 256.0, 1.0]) for i in range(1500)]
    df = lspark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    made = []
    search = vector_topk._search

    def counted(*a):
        out = search(*a)
        made.append([out.filter(f"{c} % 3 = 0").select(c).distinct().count() for c in ("query_id", "vec_id")])
        return out

    monkeypatch.setattr(vector_topk, "BLOCK", 16)
    monkeypatch.setattr(vector_topk, "_search", counted)
    got = sorted(tuple(r) for r in vector_topk.top_k(df).collect())
    ints = {i: [round(x * 256) for x in v] for i, v in rows}
    want = []
    for q in range(0, 1500, 50):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in ints if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert made and all(queries <= 1 and answers <= 6 for queries, answers in made)


def test_products_stay_exact_beyond_doubles():
    import numpy as np

    a = np.array([[2**30 + 1, 3]])
    assert vector_topk.products(a, a)[0, 0] == (2**30 + 1) ** 2 + 9


# op4 -------------------------------------------------------------------------


def test_archives_round_trip_edge_cases(lspark):
    big = "é<p>" * 400 + "\r\n\r\nWARC/1.1\n" * 30
    rows = [(1, "http://a/ b\n", big, "x"), (2, None, big, "x"), (3, "http://c", "small", "x"), (4, "http://c", "small", "x"), (5, "", None, "x"),
            (6, "http://d", "", "x"), (7, "http://e", big, "x"), (7, "http://e", big, "x"), (None, "http://f", big, "x"), (8, "http://g", "y" * 1000, "x"),
            (9, "http://g", "y" * 999, "x"), (10, "http://g", "y" * 999, "x")]
    df = lspark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive_digest(df).collect()), key=repr)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [(i, size(t), sha(t), "response", None) for i, _, t, _ in rows if t != big]
    want += [(1, size(big), sha(big), "revisit", 7), (2, size(big), sha(big), "revisit", 7), (7, size(big), sha(big), "revisit", 7),
             (7, size(big), sha(big), "response", None), (None, size(big), sha(big), "revisit", 7)]
    assert got == sorted(want, key=repr)
    assert warc.archive_digest(df.limit(0)).count() == 0


def test_legacy_records_of_both_versions():
    import io

    for version in (1, 2):
        name = "x.arc"
        raw = warc.arc_version_block(version, name) + warc.arc_record(version, "http://a/with space", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n", name, 99)
        raw += warc.arc_record(version, "dns:a", "200102030405", "text/dns", b"plain", name, 150)
        (h, b), (h2, b2) = warc.arc_records(io.BytesIO(raw))
        assert h["URL"] == "http://a/with space" and b.endswith(b"body\n") and b2 == b"plain"
        fields, block = next(warc.warc_records(io.BytesIO(warc.convert(h, b, name, 0, None))))
        assert fields["warc-date"] == "2001-02-03T04:05:06Z" and fields["warc-type"] == "response" and block == b
        fields, _ = next(warc.warc_records(io.BytesIO(warc.convert(h2, b2, name, 1, None))))
        assert fields["warc-type"] == "resource" and fields["warc-date"] == "2001-02-03T04:05:00Z"
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(raw[:-4])))


# pipeline --------------------------------------------------------------------


def test_pipeline_stages_one_by_one(lspark):
    import corpus_pipeline
    from test_dedup import components, repeats

    docs = lspark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "secret_scans", "packing"]
    quality, near, cut, scan, pack = (f for _, f in corpus_pipeline.STAGES)
    one = quality(lspark, docs, SF).cache()
    assert one.columns == docs.columns and 0 < one.count() < docs.count()
    labels = lspark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels.filter("quality = 1"), "doc_id").join(one, "doc_id", "left_anti").count() <= 0.05 * labels.count()
    two = near(lspark, one, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(i for i, _, c in components(rows) if i == c)
    three = cut(lspark, two, SF).cache()
    rows = {r["doc_id"]: r["text"] for r in two.collect()}
    want = {i: (n, h) for i, _, n, _, h in repeats(list(rows.items()))}
    got = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == docs.columns
    assert set(rows) - set(got) <= {i for i, (n, _) in want.items() if n}
    assert all(r["text"] == rows[i] for i, r in got.items() if not want[i][0])
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    four = scan(lspark, three, SF)
    assert all(not secrets(r["text"]) for r in four.collect()) and four.count() == three.count()
    five = pack(lspark, four, SF)
    assert five.select("doc_id").distinct().count() == four.count()


def test_pipeline_query(lspark):
    got = QUERIES_AND_PIPELINE()["pipeline"](lspark, SF)
    assert got.count() > 0 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def QUERIES_AND_PIPELINE():
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import __spark_entry__

    return __spark_entry__.queries()
