"""License scans with a positional rare-token index.

Templates are license notices with a label and mandatory key phrases. The index
holds for each template its rarest words (highest inverse document frequency over
the documents scanned, among words that the template has once) with their
positions in it. Of a document, the words that the index holds are looked up: word
number i that stands at position j of a template votes for the template to start
at i - j. Votes within ``drift`` words of each other (a place filled in, a word
added) meet; where at least ``need`` of the template's rare words agree on a start,
the template is a candidate, and it is found if all its key phrases stand there in
full. Phrases are found by their own rarest word and compared word by word. Short
phrases are templates too: all their words have to agree, in place.

Words are runs of letters and digits (all characters beyond ASCII count), A-Z
lower-cased. They are matched exactly, as one or two machine words
(``packed_words``), not by hashes.

Two passes over the texts: one counts in how many documents each template word
stands (a figure per template word reaches the driver), one scans. Documents are
scanned where they lie; nothing is shuffled.

Defined cases: null texts are empty; a document without words has no match and
score 0. Repeated rows give repeated results. Ties in frequency are broken by the
word. Places may overlap. A template's best place is the one with the most words
in agreement, then the first. Very long texts are scanned whole, in one task. An
empty table gives no rows. Other columns of the input are not read, so their names
may clash with those used here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folio.llm.arrowtext import chunks, flat, tidy, word_spans
from folio.llm.packed_words import FOLD, WORD_BYTES, packed

#: Rare words a template is looked up by, and the share that must agree.
RARE_WORDS = 12
NEED = 0.6
#: Longest template word, in bytes.
LONGEST = 2 * WORD_BYTES

# Fixed value: words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F], lower-cased.
WORD_BREAK = np.ones(256, bool)
WORD_BREAK[0x30:0x3A] = WORD_BREAK[0x61:0x7B] = WORD_BREAK[0x80:] = False


class Template(NamedTuple):
    label: str
    text: str
    #: phrases that must stand where the template is found; none: the whole text
    keys: tuple[str, ...] = ()


# The phrases that name a license.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)

# Notices of common licenses, in words.
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so",
        ("permission is hereby granted free of charge", "without limitation the rights to use"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
        "agreed to in writing software distributed under the license is distributed on an as is basis",
        ("apache license version 2", "except in compliance with the license"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        ("under the terms of the gnu general public license", "version 3 of the license"),
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 2 of the license or at your option any later version",
        ("under the terms of the gnu general public license", "version 2 of the license"),
    ),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license version 3"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)
    ),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    Template("cc0-1", "creative commons cc0 1 0 universal"),
)

SCAN_SCHEMA = (
    "doc_id {id}, n_words long, places array<struct<label:string,start:long>>, "
    "templates array<struct<label:string,start:long,share:double,found:boolean>>"
)


def words_of(text: str) -> list[str]:
    """Words of one text, as the scan sees them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    data = FOLD[raw]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), WORD_BREAK)
    return [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]


class Vocabulary:
    """The templates' words, numbered in the order of their bytes per length class."""

    def __init__(self, words: set[str]):
        encoded = sorted({w.encode() for w in words}, key=lambda w: (len(w) > WORD_BYTES, w))
        if any(not 0 < len(w) <= LONGEST for w in encoded):
            raise ValueError(f"template words have 1 to {LONGEST} bytes")
        self.words = [w.decode() for w in encoded]
        self.number = {w: i for i, w in enumerate(self.words)}
        short = [w for w in encoded if len(w) <= WORD_BYTES]
        self.short = np.array([int.from_bytes(w.ljust(8, b"\0"), "big") for w in short], np.uint64)
        pairs = [(int.from_bytes(w[:8], "big"), int.from_bytes(w[8:].ljust(8, b"\0"), "big")) for w in encoded[len(short) :]]
        self.heads = np.unique(np.array([a for a, _ in pairs], np.uint64))
        self.tails = np.unique(np.array([b for _, b in pairs], np.uint64))
        rank = [int(np.searchsorted(self.heads, a)) * (len(self.tails) + 1) + int(np.searchsorted(self.tails, b)) for a, b in np.array(pairs, np.uint64).reshape(-1, 2)]
        self.long = np.array(rank, np.int64)  # ascending, as the pairs are

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Index of each value in a sorted table, else -1."""
        if not len(table):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return np.where(table[at] == values, at, -1)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The word's number, or -1, for every word of the (folded) data."""
        data = np.concatenate([data, np.zeros(WORD_BYTES, np.uint8)])
        lengths = ends - starts
        out = np.full(len(starts), -1, np.int32)
        few = np.flatnonzero(lengths <= WORD_BYTES)
        out[few] = self._find(self.short, packed(data, starts[few], lengths[few]))
        more = np.flatnonzero((lengths > WORD_BYTES) & (lengths <= LONGEST))
        if len(more) and len(self.long):
            head = self._find(self.heads, packed(data, starts[more], np.full(len(more), WORD_BYTES)))
            more = more[head >= 0]
            head = head[head >= 0]
            tail = self._find(self.tails, packed(data, starts[more] + WORD_BYTES, lengths[more] - WORD_BYTES))
            both = self._find(self.long, head * (len(self.tails) + 1) + tail)
            out[more] = np.where((tail >= 0) & (both >= 0), both + len(self.short), -1)
        return out


class _Parsed:
    """Words of a chunk of documents."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: Vocabulary):
        raw, offsets = flat(batch["text"])
        data = FOLD[raw]
        starts, ends, self.words = word_spans(data, offsets, WORD_BREAK)
        self.ids = vocabulary.numbers(data, starts, ends)
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(self.words))


class _Entry(NamedTuple):
    """A template as the index holds it."""

    label: str
    length: int
    rare: list[tuple[int, int]]  # (word number, position)
    need: int
    drift: int
    keys: list[int]  # phrase numbers


class Index:
    """Positional index of the templates by their rare words. ``docs_with`` gives
    the number of documents that hold each word of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary, base: tuple[Template, ...], notices: tuple[Template, ...], docs_with: dict[int, int]):
        def rarity(word: int) -> tuple[int, int]:
            return docs_with.get(word, 0), word

        self.phrases: list[tuple[list[int], int]] = []  # (word numbers, position of the rarest)
        numbers: dict[tuple[int, ...], int] = {}

        def phrase(text: str) -> int:
            words = [vocabulary.number[w] for w in words_of(text)]
            if tuple(words) not in numbers:
                numbers[tuple(words)] = len(self.phrases)
                self.phrases.append((words, min(range(len(words)), key=lambda j: rarity(words[j]))))
            return numbers[tuple(words)]

        self.base = [(t.label, phrase(t.text)) for t in base]
        self.entries = []
        for t in notices:
            words = [vocabulary.number[w] for w in words_of(t.text)]
            once = sorted((w for w in set(words) if words.count(w) == 1), key=rarity)
            rare = [(w, words.index(w)) for w in once[:RARE_WORDS]]
            keys = [phrase(k) for k in t.keys or (t.text,)]
            need = math.ceil(NEED * len(rare)) if t.keys else len(rare)
            self.entries.append(_Entry(t.label, len(words), rare, max(1, need), len(words) // 8 if t.keys else 0, keys))
        #: between the words of two documents, so that no two share a start
        self.gap = 2 * max([e.length + e.drift for e in self.entries], default=0) + 1

    def places(self, chunk: _Parsed, at: dict[int, np.ndarray]) -> list[np.ndarray]:
        """Where each phrase starts, as word numbers of the chunk."""
        out = []
        for words, rarest in self.phrases:
            start = at.get(words[rarest], np.zeros(0, np.int64)) - rarest
            start = start[(start >= 0) & (start + len(words) <= len(chunk.ids))]
            start = start[chunk.row[start] == chunk.row[start + len(words) - 1]]
            for j, word in enumerate(words):
                start = start[chunk.ids[start + j] == word]
            out.append(start)
        return out

    def scan(self, chunk: _Parsed) -> tuple[dict[int, list], dict[int, list]]:
        """Base places and template matches by row of the chunk."""
        known = np.flatnonzero(chunk.ids >= 0)
        order = known[np.argsort(chunk.ids[known], kind="stable")]
        cut = np.flatnonzero(np.diff(chunk.ids[order], prepend=-1))
        at = {int(chunk.ids[part[0]]): part for part in np.split(order, cut[1:]) if len(part)} if len(order) else {}
        found = self.places(chunk, at)
        bases: dict[int, list] = {}
        for label, number in self.base:
            for start in found[number].tolist():
                row = int(chunk.row[start])
                bases.setdefault(row, []).append((start - int(chunk.words[row]), label))
        matches: dict[int, list] = {}
        for entry in self.entries:
            self._align(entry, chunk, at, found, matches)
        return bases, matches

    def _align(self, entry: _Entry, chunk: _Parsed, at: dict, found: list[np.ndarray], matches: dict[int, list]) -> None:
        # word numbers with a gap between documents: starts of different ones never meet
        votes = []
        for word, position in entry.rare:
            hits = at.get(word)
            votes.append(hits - position + chunk.row[hits] * self.gap if hits is not None else np.zeros(0, np.int64))
        if sum(len(v) > 0 for v in votes) < entry.need:
            return
        starts = np.unique(np.concatenate(votes))
        agreed = np.zeros(len(starts), np.int64)
        for v in votes:
            agreed += np.searchsorted(v, starts + entry.drift, "right") > np.searchsorted(v, starts, "left")
        starts, agreed = starts[agreed >= entry.need], agreed[agreed >= entry.need]
        if not len(starts):
            return
        whole = np.ones(len(starts), bool)
        for number in entry.keys:
            key = found[number] + chunk.row[found[number]] * self.gap
            last = starts + entry.length + 2 * entry.drift - len(self.phrases[number][0])
            whole &= np.searchsorted(key, last, "right") > np.searchsorted(key, starts - entry.drift, "left")
        row = self._row_of(starts, chunk)
        best: dict[int, tuple] = {}
        for r, s, n, w in zip(row.tolist(), starts.tolist(), agreed.tolist(), whole.tolist()):
            start = s - r * self.gap - int(chunk.words[r])
            rank = (not w, -n, start)
            if r not in best or rank < best[r][0]:
                best[r] = (rank, (entry.label, start, n / len(entry.rare), w))
        for r, (_, match) in best.items():
            matches.setdefault(r, []).append(match)

    def _row_of(self, starts: np.ndarray, chunk: _Parsed) -> np.ndarray:
        """The document that a start with gaps belongs to. A start may lie up to a
        template's length before its document's first word, less than the gap."""
        rows = np.arange(len(chunk.words) - 1)
        edge = chunk.words[:-1] + rows * self.gap - self.gap // 2
        return np.searchsorted(edge, starts, "right") - 1


def _vocabulary(templates: tuple[Template, ...]) -> Vocabulary:
    return Vocabulary({w for t in templates for text in (t.text, *t.keys) for w in words_of(text)})


def document_frequencies(documents: DataFrame, vocabulary: Vocabulary) -> dict[int, int]:
    """Documents that hold each word of the vocabulary."""
    size = len(vocabulary.words)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for piece in chunks(batch, "text"):
                chunk = _Parsed(piece, vocabulary)
                known = chunk.ids >= 0
                pairs = np.unique(chunk.row[known] * size + chunk.ids[known])
                total += np.bincount(pairs % size, minlength=size)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], ["word", "docs"])

    counted = documents.select("text").mapInArrow(run, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return {r.word: r.docs for r in counted.collect()}  # one row per template word


def scan(documents: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places, templates) per row: the places of the base
    phrases, as word numbers, and each template's best place with the share of its
    rare words that agree there and whether its key phrases stand there."""
    vocabulary = _vocabulary((*base, *notices))
    index = Index(vocabulary, base, notices, document_frequencies(documents, vocabulary))
    schema = SCAN_SCHEMA.format(id=documents.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                chunk = _Parsed(piece, vocabulary)
                bases, matches = index.scan(chunk)
                rows = range(piece.num_rows)
                places = [[{"label": label, "start": s} for s, label in sorted(bases.get(i, []))] for i in rows]
                names = ("label", "start", "share", "found")
                templates = [[dict(zip(names, m)) for m in sorted(matches.get(i, []))] for i in rows]
                columns = [piece["doc_id"], pa.array(np.diff(chunk.words)), pa.array(places, arrow.field("places").type), pa.array(templates, arrow.field("templates").type)]
                yield pa.record_batch(columns, schema=arrow)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def license_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score). The score is the best share of agreeing rare words of a template that
    reached its need there, 1 for a base phrase, else 0."""
    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    places, templates = F.col("places"), F.col("templates")
    starts = F.transform(places, lambda p: p["start"])
    base = F.transform(places, lambda p: p["label"])
    found = F.transform(F.filter(templates, lambda t: t["found"]), lambda t: t["label"])
    share = F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(templates, lambda t: t["share"])), F.lit(0.0)))
    return scan(documents).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), share.alias("score"),
    )
