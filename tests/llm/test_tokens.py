"""op7, op10, op3: ids equal the libraries', files and sequences hold every id."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import edge_docs, lspark, no_docs  # noqa: F401
from folio.llm import packing, sentencepiece_codec, token_files
from folio.llm.queries import QUERIES
from folio.llm.tokens import TextEncoder, default_tokenizer

SF = "/root/testdata/sf0.001"
ODD = ["", None, "  a b", " a", "a ", "<|endoftext|> b", "it's 'tis\ny", "é ñ 漢字 a", "a\r\nb c", "a\n\n\nb c\nd", "\n a", "a \nb", "a\tb c",
       "x\u0085 y", "“q” a", "\x00 b", " ", "1 22 $$ ...  ", "😀 ok ﬁ", "x" * 5000, "a  b   c"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_encoder_equals_the_library_for_any_text():
    t, e, rng = library(), TextEncoder(default_tokenizer(), slots=1 << 8), random.Random(1)
    texts = ODD + ["".join(rng.choices(["a", "the", " ", " ", "\n", "é", "'s", "42", ".", "\t", "漢"], k=30)) for _ in range(300)]
    for lo in range(0, len(texts), 50):  # a tiny memory starts anew many times
        ids, cut = e.encode(pa.array(texts[lo : lo + 50]))
        for text, a, b in zip(texts[lo : lo + 50], cut[:-1], cut[1:], strict=True):
            assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype(np.uint32)
    raw = token_files.pack_bits(ids, width)
    assert len(raw) == -(-1001 * width // 8)
    assert (token_files.unpack_bits(raw, width, 1001) == ids).all()


def test_random_access_in_a_file(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 2**15, int(n), dtype=np.int64).astype(np.uint32)) for i, n in enumerate(rng.integers(1, 9000, 30))]
    path = tmp_path / "x.bits"
    with open(path, "wb") as f:
        w = token_files.Writer(f, 15)
        for d in docs:
            w.add(*d)
        w.finish()
    r = token_files.Reader(pa.OSFile(str(path)))
    for n in (29, 0, 13):
        assert (r.document(n) == docs[n][1]).all() and r.docs[n] == n


def expected_ids(text, end):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_an_id_of_many_texts_spreads_over_files(lspark, tmp_path):
    rows = [(None, f"text number {i}") for i in range(400)] + [(i, "one") for i in range(40)]
    docs = lspark.createDataFrame(rows, "doc_id long, text string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows go into one task
    before = lspark.conf.get(key)
    lspark.conf.set(key, "false")
    try:
        manifest = token_files.write(docs, str(tmp_path / "ids"))
    finally:
        lspark.conf.set(key, before)
    assert len([n for n in manifest.collect() if n["n_docs"] > 1]) >= 3
    got = sorted(token_files.read(manifest, str(tmp_path / "ids")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 400 + list(range(40))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0


def test_token_files_against_the_library(lspark, edge_docs, no_docs):
    got = token_files.token_digest(edge_docs).collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g["doc_id"] for g in sorted(got, key=lambda g: g["start"])] == [r[0] for r in rows]
    want = sorted((r[0] or -1, len(x := expected_ids(r[1], 2)), zlib.crc32(x.tobytes())) for r in rows)
    assert sorted((g["doc_id"] or -1, g["n_tokens"], g["ids_crc32"]) for g in got) == want
    at = 0
    for g in sorted(got, key=lambda g: g["start"]):
        assert g["start"] == at
        at += g["n_tokens"]
    assert token_files.token_digest(no_docs).count() == 0


def test_packing_places_every_id_once(edge_docs, no_docs):
    got = packing.pack(edge_docs).collect()
    texts = {}
    for r in edge_docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    sequences = {}
    for g in got:
        assert 0 < g["length"] <= 1024
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, some in texts.items():
        want = sorted((len(x := expected_ids(t, 0)), s, zlib.crc32(x[s : s + n].tobytes())) for t in some for s, n in cut(len(expected_ids(t, 0))))
        assert sorted((g["doc_tokens"], g["start"], g["ids_crc32"]) for g in got if g["doc_id"] == doc_id) == want
    assert packing.pack(no_docs).count() == 0


def cut(n):
    out, at = [], 0
    while at < n:
        size = 1024 if n - at >= 1024 else min(n - at, 512)
        out.append((at, size))
        at += size
    return out


def test_differencing_is_a_balanced_partition():
    rng = random.Random(2)
    for k in (1, 2, 5, 20):
        sizes = [rng.randint(1, 512) for _ in range(100)]
        parts = packing.differencing(sizes, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(100))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 512
    assert packing.differencing([], 3) == [[], [], []]


def test_windows_rise_until_the_capacity_holds():
    sizes = [700] * 5
    assert sorted(map(len, packing.windows(sizes, 1024))) == [1] * 5
    assert all(sum(sizes[i] for i in w) <= 1400 for w in packing.windows(sizes, 1400))


def test_sentencepiece_equals_the_library(edge_docs, no_docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rows = edge_docs.collect()
    got = sentencepiece_codec.encode(edge_docs)
    want = sorted((r["doc_id"] or -1, m.encode(r["text"] or "")) for r in rows)
    assert sorted((g["doc_id"] or -1, list(g["ids"])) for g in got.collect()) == want
    back = sentencepiece_codec.decode(got).collect()
    assert sorted((b["doc_id"] or -1, b["text"]) for b in back) == sorted((r["doc_id"] or -1, r["text"] or "") for r in rows)
    digest = sentencepiece_codec.codec_digest(edge_docs).collect()
    assert all(d["round_trip"] for d in digest) and len(digest) == len(rows)
    assert sentencepiece_codec.codec_digest(no_docs).count() == 0


def test_sentencepiece_odd_texts_and_unigram_relaxing(monkeypatch):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    m, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    texts = [t or "" for t in ODD] + ["a ▁b", "▁", "eeeee ttttt ____ ----"]
    ids, at = c.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [m.encode(t) for t in texts]
    # the unigram rule on the same pieces: the best sum of scores
    u = sentencepiece_codec.Codec(path)
    u.model.kind = "unigram"
    ids, _ = u.encode(pa.array(["other thing"]))
    score = {p: u.model.score[i] for p, i in u.model.text.items()}

    def best(word):
        table = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            table[e] = max((table[s][0] + score[word[s:e]], table[s][1] + [word[s:e]]) for s in range(e) if table[s] and word[s:e] in score)
        return table[-1][0]

    assert np.isclose(sum(u.model.score[i] for i in ids), best("▁other") + best("▁thing"))


def test_queries_read_their_whole_table(lspark):
    n = lspark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_sentencepiece", "op7_token_files"):
        assert QUERIES[name](lspark, SF).count() == n
    assert QUERIES["op10_packing"](lspark, SF).select("doc_id").distinct().count() == n


def twins(n=2048):
    """Two words that a polynomial hash modulo 2**64 takes for one, for any base."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)


def test_words_with_one_polynomial_hash():
    """Known pieces are told apart also where the hash of their bytes is equal."""
    from folio.llm import arrowtext as A
    from folio.llm.jaccard_join import shingle_hashes

    one, two = twins()
    data = np.frombuffer((one + two).encode(), np.uint8)
    at, end = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(A.range_hash(A.prefix_hashes(data), at, end).tolist())) == 1
    assert len(set(A.range_keys(data, at, end).tolist())) == 2 and len(set(A.range_keys(data, at, end, folded=True).tolist())) == 2
    upper = np.frombuffer((one + one.upper()).encode(), np.uint8)
    assert len(set(A.range_keys(upper, at, end, folded=True).tolist())) == 1 and len(set(A.range_keys(upper, at, end).tolist())) == 2
    assert len(set(shingle_hashes(data, np.array([0, 2048, 4096]))[0].tolist())) == 2
    t, e = library(), TextEncoder(default_tokenizer())
    for text in (one, two, one):
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded_by_ids(monkeypatch):
    from folio.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY_IDS", 2000)
    t, e, rng = library(), TextEncoder(default_tokenizer()), random.Random(5)
    for _ in range(12):
        text = "".join(rng.choices("abcdefgh", k=1500))
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and len(e.memory.ids) < 4000
