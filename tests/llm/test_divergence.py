"""Source divergence audit against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_fixtures import lspark  # noqa: F401

from folio.llm import packed_words, source_divergence as SD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, top=200):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall(text.translate(lower))
        counts[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        vocabulary = [w for (l, w), n in docs.items() if l == lang and n >= min_docs]
        sources = sorted(s for l, s in groups if l == lang)
        share = {}
        for s in sources:
            n = sum(counts[lang, s][w] for w in vocabulary)
            share[s] = {w: 1 + 10**9 * (counts[lang, s][w] + 1) // (n + len(vocabulary)) for w in vocabulary}
        whole = {w: sum(counts[lang, s][w] for s in sources) for w in vocabulary}
        n = sum(whole.values())
        whole = {w: 1 + 10**9 * (c + 1) // (n + len(vocabulary)) for w, c in whole.items()}
        for s in sources:
            pairs = [(-sum((share[s][w] - share[o][w]) ** 2 // share[o][w] for w in vocabulary), o.encode()) for o in sources if o != s]
            terms = [
                (-((share[s][w] - whole[w]) ** 2 // whole[w]), w.encode())
                for w in vocabulary if counts[lang, s][w] and share[s][w] > whole[w]
            ]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def docs(lspark, rows):
    data = [(i, t, lang, s, 1, 2, "k") for i, (t, lang, s) in enumerate(rows)]
    return lspark.createDataFrame(data, "doc_id int, text string, lang string, source string, n int, total int, term string").repartition(3)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    ("alpha beta Gamma ALPHA", "en", "a"), ("alpha beta", "en", "b"), ("alpha, beta-beta!", "en", "b"), (None, "en", "c"), ("", None, None),
    ("alpha beta gamma delta", "en", "a"), ("gamma", "en", "a"), ("é漢字é x" + "y" * 40, "en", "b"), ("é漢字é x" + "y" * 40, "en", "d"),
    ("é漢字é x" + "y" * 40 + "z", "en", "d"), ("É" * 5000, "fr", "a"), ("É" * 5000, "fr", "b"), ("É" * 5000 + " e", "fr", "b"),
    ("sixteen0letters abcdefghijklmnop abcdefghijklmnopq", "de", "a"), ("abcdefghijklmnop abcdefghijklmnopq", "de", "b"),
    ("abcdefghijklmnop abcdefghijklmnopq abcdefgh abcdefghi", "de", "b"), ("once", "es", "a"), ("once", "es", "b"), ("a_b[c]d`e{f}", "en", "e"),
    ("same", None, ""), ("same", "", None), ("same same", "", "x"), ("alpha\x00beta\x7falpha", "en", "f"),
]


@pytest.mark.parametrize("top", [200, 2])
def test_brute_force(lspark, top):
    assert result(SD.source_divergence(docs(lspark, ROWS), top_terms=top)) == brute(ROWS, top=top)


def test_flushes_and_split_steps(lspark, monkeypatch):
    """Counts handed on in small lots, corrections in blocks of sources."""
    tally = SD._Tally()
    batches = [b for b in docs(lspark, ROWS).select("lang", "source", "text").na.fill("").coalesce(1).toArrow().to_batches(max_chunksize=2)]
    whole = [tuple(r.values()) for b in SD._count(iter(batches)) for r in b.to_pylist()]
    monkeypatch.setattr(SD, "HELD_BYTES", 64)
    lots = [tuple(r.values()) for b in SD._count(iter(batches)) for r in b.to_pylist()]

    def total(rows):
        out = Counter()
        for lang, source, term, n, d in rows:
            out[lang, source, term, "n"] += n
            out[lang, source, term, "docs"] += d
        return out

    assert len(lots) > len(whole) and total(lots) == total(whole)
    assert tally.buckets == {}

    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = []
    for t in range(40):
        some = sorted(rng.choice(12, rng.integers(1, 13), replace=False).tolist())
        rows += [("en", i == 0, s, int(rng.integers(1, 10**6)), 10 + s) for i, s in enumerate(some)]
    table = pa.Table.from_pylist([dict(zip(["lang", "lead", "sid", "p", "rest"], r)) for r in rows], schema=pa.schema(
        [("lang", pa.string()), ("lead", pa.bool_()), ("sid", pa.int32()), ("p", pa.int64()), ("rest", pa.int64())]))

    def sums(size):
        out = Counter()
        for b in SD._corrections(iter(table.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                out[r["a"], r["b"]] += r["value"]
        return out

    expected = sums(1000)
    monkeypatch.setattr(SD, "STEP_CELLS", 30)
    assert sums(7) == expected and len(expected) == 12 * 11


def test_empty(lspark):
    assert result(SD.source_divergence(docs(lspark, ROWS).filter("false"))) == []


def test_radix_order_and_packing():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 500).astype(np.uint64) >> rng.integers(0, 60, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint32)
    assert packed_words.radix_order([b, a]).tolist() == np.lexsort([a, b]).tolist()
    words = [b"a", b"ab", b"abcdefgh", "é".encode(), b"b"]
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    lengths = np.array([len(w) for w in words])
    got = packed_words.packed(data, np.cumsum(lengths) - lengths, lengths)
    assert [sorted(words)[i] for i in np.argsort(np.argsort(got))] == words
