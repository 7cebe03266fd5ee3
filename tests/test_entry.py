"""Driver contract: entry runs, every query has a runnable plan, oracles match on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from folio.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["bucket", "bucket_start", "duration_seconds", "tag", "doc_count", "rank", "popularity_score", "size_factor"]


def test_oracles_cover_queries():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    from folio.plans.queries import QUERIES

    assert set(QUERIES) <= set(os_)  # every query of the reference's operators has an oracle


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["tag_timeline", "corpus_tag_timeline", "filter_documents", "enrich", "apply_job_events",
                                  "url_rules", "article_export", "slug_conflicts", "document_stats"])
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    idx = [cols.index(c) for c in df.columns]

    def norm(v):
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    want = sorted((tuple(norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(x) for x in r) for r in got), key=repr)
    assert got == want


def test_bench_prints_one_json_line():
    import json
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_DRIVER_MEMORY="2g")
    proc = subprocess.run([sys.executable, "bench.py", "tag_timeline", "url_rules"], cwd=root, env=env,
                          capture_output=True, text=True, timeout=600)
    assert proc.returncode == 0, proc.stderr[-2000:]
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    out = json.loads(lines[-1])
    assert out["unit"] == "sec" and set(out["queries"]) == {"tag_timeline", "url_rules"} and "errors" not in out
    assert out["sf"] == 0.001 and out["value"] == round(sum(out["queries"].values()), 3)
