"""Token ids of many texts with the ``tokenizers`` library, piece by piece.

Byte-level BPE never merges across the start of a space-led word, so the ids of
a text are those of its pieces: the text up to the first space, then every
space with what follows. Pieces met before are looked up by a 64-bit hash of
their bytes; the new pieces of a batch are encoded together as running text and
cut apart by the byte lengths of their tokens. That holds where every space
lies between two characters that are not white space; any other text goes to
the library whole, as do texts that hold an added token.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from folio.llm import arrowtext as A

#: Slots of the piece memory (twice the pieces kept); when full it starts anew.
SLOTS = 1 << 21

_SPACE = np.zeros(256, np.uint8)
_SPACE[0x20] = 1
_SPACE[0x0A] = 2
# bytes that occur in control characters and in white space other than space and
# newline, or lead one: such texts are not cut
_ODD = np.zeros(256, bool)
_ODD[:0x20] = True
_ODD[0x0A] = False
_ODD[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


#: Ids a worker keeps: 32 MB.
MEMORY_IDS = 8 << 20


class PieceMemory:
    """Ids of text pieces by a 64-bit key: an open-addressing table read and
    filled with whole arrays of keys. When half full, or when it holds
    ``MEMORY_IDS`` ids (a piece may be a whole text), it starts anew."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.number = np.zeros(self.slots, np.int32)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.start) - 1

    def full(self) -> bool:
        return 2 * len(self) > self.slots or len(self.ids) > MEMORY_IDS

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece number per (odd) key, -1 where unknown."""
        mask = np.uint64(self.slots - 1)
        out = np.full(len(key), -1, np.int64)
        todo, slot = np.arange(len(key)), (key >> np.uint64(1)) & mask
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.number[slot[hit]]
            go = ~hit & (there != 0)
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & mask
        return out

    def keep(self, key: np.ndarray, number: np.ndarray) -> None:
        """Enter distinct new keys, while there is room."""
        if 2 * len(self) > self.slots:
            return
        mask = np.uint64(self.slots - 1)
        slot = (key >> np.uint64(1)) & mask
        while len(key):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]] = key[placed]
            self.number[slot[placed]] = number[placed]
            rest = np.ones(len(key), bool)
            rest[placed] = False
            key, number, slot = key[rest], number[rest], (slot[rest] + np.uint64(1)) & mask

    def append(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of further pieces; ``ends`` are their ends within ``ids``."""
        first = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, first + ends])

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of pieces, and their counts."""
        begin = self.start[number]
        length = self.start[number + 1] - begin
        return self.ids[A.spread(begin, length)], length


def piece_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Odd 64-bit keys of byte ranges (hash of the bytes and the length)."""
    return A.range_keys(data, starts, ends) | np.uint64(1)


class TextEncoder:
    """Ids of texts for one tokenizer file."""

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cut = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)  # a byte-level token has one character per byte
        self.memory = PieceMemory(slots)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int32)

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode unseen pieces; those led by a space as running text."""
        for lo in range(0, len(pieces), 4096):
            some = pieces[lo : lo + 4096]
            ends = np.cumsum(np.array([len(p) for p in some]))
            led = all(p[0] == 0x20 for p in some[1:])
            if led:
                ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
                reached = np.cumsum(self.bytes_of[ids])
                cut = np.minimum(np.searchsorted(reached, ends) + 1, len(ids))
            if not led or (reached[cut - 1] != ends).any():
                each = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
                ids, cut = np.array([i for e in each for i in e], np.int32), np.cumsum([len(e) for e in each])
            self.memory.append(ids, cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (null reads as empty) and the range of each row."""
        data, offsets = A.flat(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        cut = self._cuttable(data, offsets)
        row = np.repeat(np.arange(rows), np.diff(offsets))
        begins = (data == 0x20) & cut[row]
        head = offsets[:-1][(np.diff(offsets) > 0) & cut]
        begins[head] = True
        starts = np.flatnonzero(begins)
        of = row[starts]
        ends = np.append(starts[1:], 0)
        last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
        if len(of):
            ends[last] = offsets[of[last] + 1]
        else:
            ends = ends[:0]
        memory = self.memory
        if memory.full():
            memory.forget()
        key = piece_keys(data, starts, ends)
        number = memory.find(key)
        unseen = np.flatnonzero(number < 0)
        if len(unseen):
            fresh, where, back = np.unique(key[unseen], return_index=True, return_inverse=True)
            at = unseen[where]
            order = np.argsort(data[starts[at]] == 0x20, kind="stable")  # pieces without a space first
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            base = len(memory)
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[at[order]].tolist(), ends[at[order]].tolist(), strict=True)]
            bare = int((data[starts[at]] != 0x20).sum())
            self._learn_each(pieces[:bare])
            self._learn(pieces[bare:])
            memory.keep(fresh, base + rank)
            number[unseen] = base + rank[back]
        ids, length = memory.gather(number)
        count = np.bincount(of, weights=length, minlength=rows).astype(np.int64)
        if cut.all():
            return ids, np.concatenate([[0], np.cumsum(count)])
        whole = {i: self._whole(data[offsets[i] : offsets[i + 1]].tobytes()) for i in np.flatnonzero(~cut).tolist()}
        at = np.concatenate([[0], np.cumsum(count)])
        parts = [whole[i] if i in whole else ids[at[i] : at[i + 1]] for i in range(rows)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _learn_each(self, pieces: list[bytes]) -> None:
        if pieces:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            self.memory.append(np.array([i for e in each for i in e], np.int32), np.cumsum([len(e) for e in each]))

    def _cuttable(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose pieces can be encoded apart."""
        rows = len(offsets) - 1
        if not self.cut:
            return np.diff(offsets) == 0
        out = np.ones(rows, bool)
        space = _SPACE[data]
        pair = (space[:-1] > 0) & (space[1:] > 0) & (space[:-1] + space[1:] < 4)
        bad = np.concatenate([np.flatnonzero(pair), offsets[1:][offsets[1:] > offsets[:-1]] - 1])
        bad = bad[(space[bad] == 1) | (bad + 1 < len(data)) & np.append(pair, False)[bad]]
        hit = np.unique(np.searchsorted(offsets, bad, "right") - 1)
        out[hit] = False
        doubtful = np.unique(np.searchsorted(offsets, np.flatnonzero(_ODD[data]), "right") - 1)
        for i in doubtful.tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            out[i] &= not any(c.isspace() and c not in " \n" or not c.isprintable() and c != "\n" for c in set(text))
        for token in self.added:
            if token and token in (raw := data.tobytes()):
                at = raw.find(token)
                while at >= 0:
                    out[np.searchsorted(offsets, at, "right") - 1] = False
                    at = raw.find(token, at + 1)
        return out


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    """Place of the tokenizer file that the queries name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
