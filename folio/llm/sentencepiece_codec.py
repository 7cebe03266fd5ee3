"""SentencePiece encoding and decoding by suffix-array matching.

The model file's pieces and scores are used as they are; nothing is trained.
Texts are escaped as the model does it (a leading space, spaces as U+2581). No
piece has a space after another character, so a text falls into words, each
with the spaces before it, that are encoded apart; words met before in the
worker are looked up.

The new words of a batch are concatenated and indexed by a suffix array (sorted
by as many characters as the longest piece has). Every piece is binary-searched
for its range of suffixes; the ranges give all edges (start, piece), which are
sorted by position and relaxed from left to right, all words at once:

* unigram models: the best score reaching a position;
* BPE models: a position's encoding ends in exactly one piece, the one that may
  follow the last piece at its start. Two pieces may stand side by side if
  merging the text of both by the scores gives just these two; that is worked
  out once per pair.

Characters outside the vocabulary become byte pieces.

Edge cases: a null or empty text has no pieces; U+2581 in a text counts as a
space (decoding gives a space); rows repeating a doc_id are encoded each; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrowtext as A
from folio.llm.tokens import PieceMemory, piece_keys

SPACE = "▁"


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str):
        # Field numbers and enumerations of the model format.
        normal, control, user, byte, unused = 1, 3, 4, 6, 5
        pieces, self.kind = [], "unigram"
        with open(path, "rb") as f:
            raw = f.read()
        prefix, extra = True, True
        for number, value in _fields(raw):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append((entry[1].decode(), float(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0]), entry.get(3, normal)))
            elif number == 2:
                self.kind = {1: "unigram", 2: "bpe"}.get(dict(_fields(value)).get(3, 1), "other")
            elif number == 3:
                spec = dict(_fields(value))
                prefix, extra = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("models with a character normaliser are not supported")
        if self.kind == "other" or not prefix or extra:
            raise ValueError("only unigram and BPE models with a leading space and kept spaces are supported")
        self.pieces = pieces
        self.text = {p: i for i, (p, _, k) in enumerate(pieces) if k in (normal, user)}
        if any(SPACE in p.lstrip(SPACE) for p in self.text):
            raise ValueError("a piece crosses words")
        self.score = np.array([s for _, s, _ in pieces])
        self.byte = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == byte:
                self.byte[int(p[3:5], 16)] = i
        self.control = {i for i, (_, _, k) in enumerate(pieces) if k in (control, unused, 2)}


class Codec:
    def __init__(self, path: str):
        self.model = Model(path)
        self.memory = PieceMemory()
        self.unknown = len(self.model.pieces)  # stands for one character outside the vocabulary
        letters = sorted({c for p in self.model.text for c in p})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.points = np.array([ord(c) for c in letters])
        self.depth = max(map(len, self.model.text))
        items = sorted(self.model.text.items())
        self.ids = np.array([i for _, i in items], np.int64)
        self.length = np.array([len(p) for p, _ in items])
        low = np.zeros((len(items), self.depth), ">u2")
        high = np.full((len(items), self.depth), 0xFFFF, ">u2")
        for row, (p, _) in enumerate(items):
            low[row, : len(p)] = high[row, : len(p)] = [self.letter[c] for c in p]
        self.low, self.high = self._as_keys(low), self._as_keys(high)
        self.scores = self.model.score.tolist()
        self.table = PieceMemory(1 << 20)  # pair of pieces -> may follow (number 1) or not (0)
        self.pairs = 0
        raw = [self._raw(i) for i in range(len(self.model.pieces))]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_start = np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    def _as_keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{2 * self.depth}").reshape(-1)

    def _raw(self, i: int) -> bytes:
        piece, _, kind = self.model.pieces[i]
        if kind == 6:
            return bytes([int(piece[3:5], 16)])
        return b"" if i in self.model.control else piece.replace(SPACE, " ").encode()

    # relaxing -----------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """Merge the characters of a short text by the scores, best first."""
        parts = list(text)
        index, score = self.model.text, self.scores
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                number = index.get(parts[i] + parts[i + 1])
                if number is not None and score[number] > best:
                    best, at = score[number], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it (-1: the start)."""
        out = (before < 0) | (before == self.unknown) | (piece == self.unknown)
        todo = np.flatnonzero(~out)
        key = A.mix64((before[todo].astype(np.uint64) << np.uint64(24)) + piece[todo].astype(np.uint64)) | np.uint64(1)
        answer = self.table.find(key)
        new = np.flatnonzero(answer < 0)
        if len(new):
            fresh, where, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.zeros(len(fresh), np.int64)
            for k, w in enumerate(todo[new[where]].tolist()):
                a, b = self.model.pieces[before[w]][0], self.model.pieces[piece[w]][0]
                found[k] = self._merged(a + b) == [a, b]
            if 2 * self.pairs > self.table.slots:
                self.table.forget()
                self.pairs = 0
            self.table.keep(fresh, found)
            self.pairs += len(fresh)
            answer[new] = found[back]
        out[todo] = answer == 1
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, through one suffix array over all of them."""
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size + 1) - 1  # position of each separator
        starts = ends - size
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        letters = np.where(self.points[at] == points, at + 1, len(self.points) + 1)
        letters[ends] = 0
        n = len(letters)
        padded = np.concatenate([letters, np.zeros(self.depth, np.int64)]).astype(">u2")
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[:n]
        # characters behind a word's end must not take part in the order
        left = (np.repeat(ends, size + 1) - np.arange(n)).clip(0, self.depth).astype(np.int8)
        rows = windows.copy()
        rows[np.arange(self.depth, dtype=np.int8)[None, :] >= left[:, None]] = 0
        keys = self._as_keys(rows)
        suffixes = np.argsort(keys, kind="stable")
        ordered = keys[suffixes]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        count = hi - lo
        start = suffixes[A.spread(lo, count)]
        piece = np.repeat(self.ids, count)
        length = np.repeat(self.length, count)
        other = np.flatnonzero(letters == len(self.points) + 1)
        start = np.concatenate([start, other])
        piece = np.concatenate([piece, np.full(len(other), self.unknown)])
        end = start + np.concatenate([length, np.ones(len(other), np.int64)])
        # edges by position: relaxed in the order of their end within the word
        step = end - np.repeat(starts, size + 1)[start]
        order = np.lexsort((start, step))
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        last = np.full(n, -2, np.int64)  # piece that ends here; -2: not reached
        came = np.full(n, -1, np.int64)
        last[starts] = -1
        best = np.zeros(n)
        bounds = np.searchsorted(step, np.arange(1, (step[-1] if len(step) else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            open_ = last[s] != -2
            s, e, p = s[open_], e[open_], p[open_]
            if self.model.kind == "bpe":
                ok = self._follow(last[s], p)
                last[e[ok]], came[e[ok]] = p[ok], s[ok]
            else:
                worst = self.model.score.min() - 10.0
                value = best[s] + np.append(self.model.score, worst)[p]
                rank = np.lexsort((-s, value, e))
                final = rank[np.append(e[rank][1:] != e[rank][:-1], True)]
                last[e[final]], came[e[final]], best[e[final]] = p[final], s[final], value[final]
        # walk back, all words at once
        taken = []
        now = ends.copy()
        word = np.arange(len(words))
        while len(now):
            go = now > starts[word]
            now, word = now[go], word[go]
            if (last[now] < 0).any():
                raise ValueError("a word without an encoding")
            taken.append((word, now, last[now]))
            now = came[now]
        word, place, ids = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((place, word))
        word, place, ids = word[order], place[order], ids[order]
        if (ids == self.unknown).any():
            out, owner = [], []
            for w, p, i in zip(word.tolist(), place.tolist(), ids.tolist(), strict=True):
                some = self.model.byte[list(joined[p - 1].encode())].tolist() if i == self.unknown else [i]
                out += some
                owner += [w] * len(some)
            ids, word = np.array(out), np.array(owner)
        self.memory.append(ids.astype(np.int32), np.cumsum(np.bincount(word, minlength=len(words))))

    # texts --------------------------------------------------------------------

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the range of each row."""
        if column.null_count:
            column = pc.fill_null(column, "")
        data, offsets = A.flat(column)
        if SPACE.encode() in data.tobytes():
            data, offsets = A.flat(pc.replace_substring(column, SPACE, " "))
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        # a space before every text that is not empty
        size = np.diff(offsets)
        row = np.repeat(np.arange(rows), size)
        before = np.cumsum(size > 0)
        text = np.full(len(data) + int(before[-1]), 0x20, np.uint8)
        text[np.arange(len(data)) + before[row]] = data
        ends_of = np.cumsum(size + (size > 0))
        begins_of = np.concatenate([[0], ends_of[:-1]])
        space = text == 0x20
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[begins_of[size > 0]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(text))
        memory = self.memory
        if memory.full():
            memory.forget()
        key = piece_keys(text, starts, ends)
        number = memory.find(key)
        unseen = np.flatnonzero(number < 0)
        if len(unseen):
            fresh, where, back = np.unique(key[unseen], return_index=True, return_inverse=True)
            raw, base = text.tobytes(), len(memory)
            words = [raw[a:b].decode().replace(" ", SPACE) for a, b in zip(starts[unseen[where]].tolist(), ends[unseen[where]].tolist(), strict=True)]
            for lo in range(0, len(words), 16384):
                self._learn(words[lo : lo + 16384])
            memory.keep(fresh, base + np.arange(len(fresh)))
            number[unseen] = base + back
        ids, length = memory.gather(number)
        of = np.searchsorted(ends_of, starts, "right")
        count = np.bincount(of, weights=length, minlength=rows).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(count)])

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of every row, without the leading space."""
        begin = self.raw_start[ids]
        length = self.raw_start[ids + 1] - begin
        flat = self.raw[A.spread(begin, length)].tobytes()
        at = np.concatenate([[0], np.cumsum(length)])[cut]
        return [flat[a + (flat[a : a + 1] == b" ") : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a model file, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(documents: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) per row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.chunks(batch, "text"):
                ids, cut = codec(path).encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(A.tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, text) per row of (doc_id, ids); null ids read as none. Bytes
    that are no UTF-8 (ids cut inside a character) become U+FFFD."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            flat = lists.flatten().to_numpy()
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in codec(path).decode(flat, cut)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(A.tidy(run), "doc_id long, text string")


def codec_digest(documents: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_bytes, round_trip) per row: the
    text is encoded, decoded and compared (U+2581 as a space)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.chunks(batch, "text"):
                ids, cut = codec(path).encode(part.column("text"))
                decoded = codec(path).decode(ids, cut)
                data, offsets = A.flat(part.column("text"))
                packed = ids.astype("<u4")
                crc = [zlib.crc32(packed[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                same = [d == data[a:b].tobytes() or d == data[a:b].tobytes().replace(SPACE.encode(), b" ") for d, a, b in zip(decoded, offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(cut)), pa.array(crc, pa.int64()), pa.array([len(d) for d in decoded], pa.int64()), pa.array(same)],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_bytes", "round_trip"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(A.tidy(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, round_trip boolean")
