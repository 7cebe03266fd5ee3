"""License scans against plain Python."""

import random
import re

import pytest

from llm_fixtures import edge_docs, lspark, no_docs  # noqa: F401

from folio.llm import license_scan as LS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def stands(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def brute(rows):
    """Phrases by comparing at every word; templates by counting, at every start,
    the rare words within the drift."""
    parsed = [words(t) for _, t in rows]
    docs_with = {}
    for w in parsed:
        for x in set(w):
            docs_with[x] = docs_with.get(x, 0) + 1
    order = lambda x: (docs_with.get(x, 0), len(x.encode()) > 8, x.encode())
    out = []
    for (doc, _), w in zip(rows, parsed):
        places = [(i, t.label) for t in LS.BASE for i in stands(w, t.text)]
        labels, score = {label for _, label in places}, 1.0 if places else 0.0
        for t in LS.NOTICES:
            tw = t.text.split()
            rare = sorted((x for x in set(tw) if tw.count(x) == 1), key=order)[:12]
            need, drift = (-(-6 * len(rare) // 10), len(tw) // 8) if t.keys else (len(rare), 0)
            votes = {i - tw.index(x) for i, x in enumerate(w) if x in rare}
            for s in votes:
                agree = sum(any(0 <= s + tw.index(x) + d < len(w) and w[s + tw.index(x) + d] == x for d in range(drift + 1)) for x in rare)
                if agree < need:
                    continue
                score = max(score, agree / len(rare))
                if all(any(s - drift <= i <= s + len(tw) + 2 * drift - len(k.split()) for i in stands(w, k)) for k in t.keys or (t.text,)):
                    labels.add(t.label)
        base = {label for _, label in places}
        starts = [i for i, _ in places]
        out.append((doc, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def result(df):
    rows = LS.license_digest(df).collect()
    return sorted(((*tuple(r)[:-1], round(r["score"], 9)) for r in rows), key=str)


def made_rows():
    rng = random.Random(8)
    filler = "the of software license version 2 free any under public is as notice copy".split()
    rows = []
    for i, t in enumerate(LS.BASE + LS.NOTICES):
        w = t.text.split()
        rows.append((i, t.text))
        rows.append((100 + i, "# " + "\n# ".join(" ".join(w[j : j + 9]).title() for j in range(0, len(w), 9))))
        rows.append((200 + i, "Intro, " + " ".join(w[: len(w) // 2] + ["Acme", "inc"] + w[len(w) // 2 :]) + "; end"))
        for k in range(4):  # words dropped, swapped or added: found or not, as the rule says
            x = list(w)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 2)] = [rng.choice(filler)] * rng.randint(0, 2)
                x = x or ["one"]
            rows.append((300 + 10 * i + k, " ".join(rng.choice(filler) for _ in range(rng.randint(0, 30))) + " " + ". ".join(x)))
    rows += [(900 + i, " ".join(rng.choice(filler) for _ in range(200))) for i in range(20)]
    rows += [(950, "cc by nc by nc cc BY-NC/cc_by_nc ccé by nc"), (951, "CC BY"), (951, "NC cc-by-nc"), (952, "under the mit"), (953, "license")]
    rows += [(960, "license " * 20_000 + "under the MIT License"), (961, "gnu " * 3000 + "general public license version 3"), (962, "x" * 300_000)]
    return rows


def frame(lspark, rows):
    return lspark.createDataFrame([(i, t, 1, "p", 2.0) for i, t in rows], "doc_id long, text string, n_words int, places string, score double")


def test_brute_force(lspark):
    rows = made_rows()
    got = result(frame(lspark, rows).repartition(3))
    assert got == brute(rows)
    whole = {r[0]: r[6].split(",") for r in got}
    for i, t in enumerate(LS.BASE + LS.NOTICES):  # each notice is known in its plain forms
        assert t.label in whole[i] and t.label in whole[100 + i], t


def test_edge_rows(lspark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert result(edge_docs) == brute(rows)
    assert LS.license_digest(no_docs).collect() == []


def test_real_output(lspark):
    got = LS.scan(frame(lspark, [(1, "This is released UNDER the MIT License."), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(p) for p in got[0].places] == [("mit", 3)] and got[1].places == [] and got[1].n_words == 0


def test_words_of_templates():
    with pytest.raises(ValueError):
        LS.Vocabulary({"x" * 17})
    v = LS.Vocabulary({"a", "abcdefgh", "abcdefghi", "abcdefghj", "sublicense"})
    import numpy as np

    text = b"a abcdefgh abcdefghi abcdefghk sublicense abcdefghabcdefgh b"
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = LS.word_spans(data, np.array([0, len(data)]), LS.WORD_BREAK)
    got = [v.words[i] if i >= 0 else None for i in v.numbers(data, starts, ends)]
    assert got == ["a", "abcdefgh", "abcdefghi", None, "sublicense", None, None]


def test_query(lspark):
    from folio.llm.queries import QUERIES, table

    rows = [(r.doc_id, r.text) for r in table(lspark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = sorted(((*tuple(r)[:-1], round(r["score"], 9)) for r in QUERIES["op12_license_scan"](lspark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows)
    assert {label for r in got for label in r[6].split(",")} >= {"mit", "apache-2", "cc-by-nc"}
