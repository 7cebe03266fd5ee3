"""op2 and op8 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from llm_fixtures import edge_docs, lspark, no_docs  # noqa: F401
from folio.llm import jaccard_join, suffix_dedup
from folio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sets_of(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def components(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = Counter(p for some in where.values() for p in combinations(some, 2))
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[find(k)].append(i)
    lowest = {k: min((i for i in v if i is not None), default=None) for k, v in low.items()}
    return sorted(((i, len(s), lowest[find(k)] if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_join_equals_brute_force_on_edge_cases(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert as_rows(jaccard_join.near_duplicates(edge_docs)) == components(rows)
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_join_query_on_documents(lspark):
    rows = [tuple(r) for r in lspark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(QUERIES["op8_ngram_jaccard"](lspark, SF)) == components(rows)


def test_no_link_is_lost_by_the_blocks():
    """Linked pairs of every size share a key."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 99, 150, 333, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = rng.integers(0, n // 5 + 1)
            add = 0
            while 100 * (n - drop) >= 80 * (n + add + 1):
                add += 1
            add = rng.integers(0, add + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert len(np.intersect1d(jaccard_join.block_keys(a), jaccard_join.block_keys(b))), (n, drop, add)


def test_one_per_group_keeps_one_row_of_each_component(lspark, edge_docs):
    """Also of components with rows that repeat an id or have none."""
    more = [(500, "un deux trois quatre cinq six"), (500, "un deux trois quatre cinq six"), (None, "seven eight nine"), (None, "Seven eight nine"),
            (19, "an id twice with another text"), (1, "of id one as well but unlike it")]
    extra = lspark.createDataFrame([(i, t, 0.5, 7, "s", 1, "k", len(t)) for i, t in more], edge_docs.schema)
    docs = edge_docs.union(extra)
    kept = jaccard_join.one_per_group(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    ids = [i for i, _ in rows]
    assert 2 not in ids and 3 not in ids and {4, 5, 6} <= set(ids) and ids.count(500) == 1 and ids.count(14) == 1 and ids.count(19) == 2 and ids.count(1) == 2
    assert sorted(t.lower() for i, t in rows if i is None and t) == ["seven eight nine"]
    # as many non-empty sets stay as there are components, none linked with another
    every = components([(k, r["text"]) for k, r in enumerate(docs.collect())])
    alone = components([(k, t) for k, (_, t) in enumerate(rows)])
    assert sum(n > 0 for _, n, _ in alone) == len({c for _, n, c in every if n})
    assert all(i == c for i, _, c in alone)
    assert jaccard_join.one_per_group(docs.limit(0)).count() == 0


def test_chain_of_links_is_one_component(lspark):
    w = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w[i * 5 : 150 + i * 5])) for i in range(30)]
    df = lspark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(jaccard_join.near_duplicates(df)) == components(rows)
    assert {r["component_id"] for r in jaccard_join.near_duplicates(df).collect()} == {0}


def repeats(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + 200] for _, t in texts for p in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("wide, close", [(1000, 256), (1, 256), (1000, 0), (1, 1)])
def test_suffix_dedup_equals_brute_force(lspark, edge_docs, monkeypatch, wide, close):
    """Also with every gram split, and with every window sorted."""
    import folio.llm.suffix_dedup as S

    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    monkeypatch.setattr(S, "WIDE", wide)
    monkeypatch.setattr(S, "CLOSE", close)
    assert as_rows(S.repeat_digest(edge_docs)) == repeats(rows)


def test_suffix_dedup_query_and_empty_table(lspark, no_docs):
    rows = [tuple(r) for r in lspark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(QUERIES["op2_suffix_dedup"](lspark, SF)) == repeats(rows)
    assert suffix_dedup.repeat_digest(no_docs).count() == 0


def test_local_decision_paths_agree():
    """The three ways of deciding a bucket find the same windows."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 900).astype(np.uint8)
    copy = text.copy()
    copy[450] = 65
    data = np.concatenate([text[100:400], copy[100:400], text[80:380], copy[300:600], text[300:600]])
    row, at, lo, hi, gram = suffix_dedup.anchors(data, np.arange(0, 1501, 300))
    order = np.argsort(gram, kind="stable")
    row, at, lo, hi, gram = row[order], at[order], lo[order], hi[order], gram[order]
    parts = [data[300 * r + a - h : 300 * r + a - x + 200] for r, a, x, h in zip(row, at, lo, hi, strict=True)]
    offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    block = {"bucket": gram.view(np.int64), "text_id": row, "start": at - hi, "lo": lo, "hi": hi}
    joined = np.concatenate(parts)
    index, rows = suffix_dedup.SuffixIndex(joined), np.arange(len(row))
    group = np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]]))

    def windows(found):
        return {(int(r), x) for r, a, b in zip(*found, strict=True) for x in range(a, b + 1)}

    want = windows(suffix_dedup._by_windows(index, block, offset, rows, group))
    assert want and windows(suffix_dedup._along_anchors(index, block, offset, rows, group)) == want
    assert set().union(*(windows(suffix_dedup._by_bytes(index, block, offset, rows[group == g])) for g in np.unique(group))) == want


def hot_rows():
    """A common passage with other words of each row's own, and near copies of some rows."""
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(400)]
    rows += [(1000 + i, rows[i][1].replace(f"w{i}x0", "new")) for i in range(0, 400, 20)]
    return rows + [(2000 + i, rows[7][1] + f" more{i}") for i in range(60)]


def _groups_of(df):
    stars = jaccard_join.stored(jaccard_join._stars(jaccard_join._keys(df).repartition("key").sortWithinPartitions("key", "set_id")), "test-stars")
    pairs = stars.select("a", "b").distinct()
    details = jaccard_join._node_details(df, stars.selectExpr("a AS set_id").union(stars.selectExpr("b AS set_id")).distinct())
    found = jaccard_join.components(jaccard_join._verified(jaccard_join._promising(pairs, details), details), "test-components")
    groups, _ = jaccard_join._open_groups(stars, found, details)
    return stars.groupBy("key").count().agg({"count": "max"}).first()[0], [r["count"] for r in groups.groupBy("group").count().collect()]


def test_no_open_group_of_a_common_passage_is_one_task(lspark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 64)
    rows = hot_rows()
    df = lspark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key, groups = _groups_of(df)
    assert key > 200 and max(groups, default=0) <= 4 * 64
    assert as_rows(jaccard_join.near_duplicates(df)) == components(rows)


@pytest.mark.parametrize("tile, counted", [(2, 1 << 16), (8, 4)])
def test_join_equals_brute_force_in_tiles(lspark, edge_docs, monkeypatch, tile, counted):
    """Also with nearly every open group cut, and shingles counted in few nodes."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "COUNTED", counted)
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()] + hot_rows()[:60] + hot_rows()[400:]
    df = lspark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_rows(jaccard_join.near_duplicates(df)) == components(rows)


def test_linked_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(6)
    for n in range(1, 200):
        for _ in range(10):
            a = rng.permutation(2 * n + 4)[:n]
            keep = rng.permutation(a)[: n - rng.integers(0, n // 5 + 1)]
            common, most = len(keep), 0
            while 100 * common >= 80 * (n + most + 1):
                most += 1
            b = np.concatenate([keep, 10_000 + np.arange(rng.integers(0, most + 1)) - 20_000 * rng.integers(0, 2)])
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert set(np.sort(a)[: jaccard_join.prefix_length(len(a))]) & set(np.sort(b)[: jaccard_join.prefix_length(len(b))])


@pytest.mark.parametrize("length, wide", [(250, 30), (203, 30), (195, 30), (250, 4)])
def test_no_bucket_holds_every_text_of_a_hot_passage(lspark, monkeypatch, length, wide):
    """Texts that share a short passage with different bytes around it."""
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = word(length)
    rows = [(i, word(int(rng.integers(100, 300))) + passage + word(int(rng.integers(100, 300)))) for i in range(150)]
    df = lspark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    most = []
    decide = suffix_dedup._repeats

    def counted(contexts):
        most.extend(r["count"] for r in contexts.groupBy("bucket").count().collect())
        return decide(contexts)

    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "_repeats", counted)
    assert as_rows(suffix_dedup.repeat_digest(df)) == repeats(rows)
    assert max(most, default=0) <= wide
