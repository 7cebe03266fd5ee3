"""Suffix-array removal of repeated byte strings.

A byte goes if it lies in a 200-byte string that also starts at another place
of the corpus (same text included). Strings never cross texts and are judged on
the input.

Bringing equal strings together. Every window of 200 bytes has an anchor: the
64-byte gram in it with the smallest hash (leftmost on a tie). Equal windows
have equal anchors at equal offsets, so only anchors whose gram occurs twice
need a look, and a task that gets all contexts of one gram (the bytes of all
windows anchored there) can decide about them. Equal contexts are one entry:
those of one chunk are met before anything is shuffled, the others in the task
that decides; all windows of a context met twice repeat. A gram with thousands
of different contexts is split by window offset and by the bytes that all
windows of the offset range share; equal pieces are then met again, by a 256-bit
digest on Spark, and only different ones go on. Where thousands of these still
share a bucket, the windows themselves are met by their digests.

Deciding. In a task the contexts are indexed by prefix polynomial hashes. The
suffixes at the anchors of one gram are merge-sorted, two suffixes being
compared by a binary search over prefix hashes for their common extension and
then by the next byte. The least common extension between two places of the
sorted order is that of their suffixes; with the common extension to the left it
tells which windows the two contexts share. Where a gram has very many contexts
the window starts themselves are the suffixes, sorted per offset: neighbours
with a common extension of 200 bytes repeat. The bytes of every pair found are
compared; after a hash collision the gram is decided by the bytes themselves.

Texts with the same 64-bit hash are indexed once and lose all windows.

Edge cases: null reads as empty; texts shorter than the length repeat nothing;
rows repeating a doc_id are separate texts (two equal rows repeat each other);
a null doc_id takes part like any other; other columns are kept by
``remove_repeats`` and ignored by the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrowtext as A
from folio.llm.storage import discard, stored

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1  # grams per window, and window offsets per anchor
#: Grams with more contexts than this are split; all of them are still compared.
WIDE = 1000
SLICE = 8
#: Up to so many different contexts are compared along the sorted anchors.
CLOSE = 256
BUDGET = 1 << 20
SMALL_CHUNK = 1 << 19
U = np.uint64


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of all windows: (row, position of the gram in its row, smallest
    and largest window offset it stands for, gram hash). The window that
    starts x bytes before the gram has offset x."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, np.zeros(0, U)
    prefix = A.prefix_hashes(data)
    grams = n - GRAM + 1
    at = np.arange(grams)
    gram = A.mix64(A.range_hash(prefix, at, at + GRAM))
    # sliding minimum over SPAN grams, by doubling
    low, width = gram, 1
    while width * 2 <= SPAN:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    windows = n - LENGTH + 1
    low = np.minimum(low[:windows], low[SPAN - width : SPAN - width + windows])
    # windows of one row with one minimum, as runs of starts
    edge = np.ones(windows + 1, bool)
    edge[1:windows] = low[1:] != low[:-1]
    begins = offsets[:-1][np.diff(offsets) >= LENGTH]
    ends = offsets[1:][np.diff(offsets) >= LENGTH] - LENGTH + 1  # past the last start
    if not len(begins):
        return none, none, none, none, np.zeros(0, U)
    edge[begins] = True
    edge[ends] = True
    first = np.flatnonzero(edge[:windows])
    last = np.append(first[1:], windows) - 1
    of = np.searchsorted(begins, first, "right") - 1
    inside = (of >= 0) & (first < ends[of])
    first, last = first[inside], last[inside]
    view = np.lib.stride_tricks.sliding_window_view(gram, SPAN)
    found = []
    while len(first):
        place = np.empty(len(first), np.int64)
        for i in range(0, len(first), 2048):
            some = first[i : i + 2048]
            place[i : i + 2048] = some + (view[some] == low[some, None]).argmax(axis=1)
        found.append((place, first, np.minimum(last, place)))
        # starts behind the gram meet its next occurrence
        go = last > place
        first, last = place[go] + 1, last[go]
    place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.searchsorted(offsets, place, "right") - 1
    return rows, place - offsets[rows], place - last, place - first, gram[place]


class SuffixIndex:
    """Concatenated contexts with prefix hashes; suffixes are byte positions."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length = data, length
        self.prefix = A.prefix_hashes(data)
        self.inverse = A.powers(len(data) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray, limit=None) -> np.ndarray:
        """Common extension of suffix pairs, at most ``limit`` (the length), by
        binary search over the prefix hashes."""
        limit = self.length if limit is None else limit
        low = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        base_a, base_b, inv_a, inv_b = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]
        while step:
            size = np.minimum(low + step, limit)
            same = (self.prefix[a + size] - base_a) * inv_a == (self.prefix[b + size] - base_b) * inv_b
            low = np.where(same, size, low)
            step >>= 1
        return low

    def common_left(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Common extension to the left of two places, at most ``limit``."""
        low = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        end_a, end_b = self.prefix[a], self.prefix[b]
        while step:
            size = np.minimum(low + step, limit)
            from_a, from_b = a - size, b - size
            same = (end_a - self.prefix[from_a]) * self.inverse[from_a] == (end_b - self.prefix[from_b]) * self.inverse[from_b]
            low = np.where(same, size, low)
            step >>= 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray, room=None) -> np.ndarray:
        """Whether suffix a sorts before b; equal ones as ``ties`` says. With
        ``room`` a suffix ends after that many bytes and sorts before longer
        ones that it begins."""
        limit = self.length if room is None else np.minimum(room[a], room[b])
        common = self.common(a, b, limit)
        whole = common >= limit
        if room is not None:
            ties = (room[a] < room[b]) | (room[a] == room[b]) & ties
        end = len(self.data) - 1
        return np.where(whole, ties, self.data[np.minimum(a + common, end)] < self.data[np.minimum(b + common, end)])

    def sort(self, suffix: np.ndarray, group: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        """Merge sort of the suffixes inside each group, all groups at once.
        ``group`` must be sorted. Every level finds, for each element, its rank
        in the neighbouring run by binary search."""
        suffix = suffix.copy()
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([first, [len(group)]]))
        begin, length = np.repeat(first, size), np.repeat(size, size)
        run = 1
        while run < int(size.max(initial=0)):
            at = np.flatnonzero(length > run)
            inside = at - begin[at]
            left = (inside // run) % 2 == 0
            other = (inside // run) * run + np.where(left, run, -run)
            lo = np.minimum(other, length[at])
            hi = np.minimum(lo + run, length[at])
            base, bottom = begin[at], lo.copy()
            mine = suffix[at]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                rival = suffix[base[open_] + mid]
                # ties keep the left run first
                smaller = self.before(rival, mine[open_], ~left[open_], room)
                lo[open_] = np.where(smaller, mid + 1, lo[open_])
                hi[open_] = np.where(smaller, hi[open_], mid)
            pair = (inside // (2 * run)) * 2 * run
            rank = np.where(left, inside - pair, inside - pair - run) + (lo - bottom)
            moved = suffix.copy()
            moved[base + pair + rank] = mine
            suffix = moved
            run *= 2
        return suffix

    def verified_equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of suffix pairs agree over the whole length."""
        out = np.zeros(len(a), bool)
        if not len(a):
            return out
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        for i in range(0, len(a), 4096):
            out[i : i + 4096] = (view[a[i : i + 4096]] == view[b[i : i + 4096]]).all(axis=1)
        return out


def repeated_suffixes(index: SuffixIndex, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Suffixes (of groups sorted by number) equal to another of their group."""
    size = np.bincount(group)[group]
    suffix, group = suffix[size > 1], group[size > 1]
    if not len(suffix):
        return suffix
    order = index.sort(suffix, group)
    mates = np.flatnonzero(group[1:] == group[:-1])
    alike = mates[index.common(order[mates], order[mates + 1]) >= index.length]
    good = index.verified_equal(order[alike], order[alike + 1])
    hit = np.zeros(len(order), bool)
    hit[alike[good]] = True
    hit[alike[good] + 1] = True
    for g in np.unique(group[alike[~good]]):  # a collision: this group by its bytes
        at = np.flatnonzero(group == g)
        words = sorted((index.data[s : s + index.length].tobytes(), s) for s in order[at])
        same = [i for i in range(len(words) - 1) if words[i][0] == words[i + 1][0]]
        order[at] = [s for _, s in words]
        hit[at] = False
        hit[at[same]] = True
        hit[at[[i + 1 for i in same]]] = True
    return order[hit]


def _text_id():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _anchor_rows(documents: DataFrame) -> DataFrame:
    """(gram, text_id, at) per anchor, each text once per task; ``at`` packs the
    gram's position and its window offsets. Of equal contexts in a chunk only
    one has its gram; and every one of them, with null for the gram, is a row
    that says its windows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in A.chunks(batch, "text", SMALL_CHUNK):
                ids = part.column("text_id").to_numpy()
                new = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()], bool)
                if not new.any():
                    continue
                part = part.filter(pa.array(new))
                data, offsets = A.flat(part.column("text"))
                row, at, lo, hi, gram = anchors(data, offsets)
                if not len(row):
                    continue
                start = offsets[row] + at
                begin, end = start - hi, start - lo + LENGTH
                first, many = _equal_contexts(data, begin, end, gram * U(65536) + (lo * 256 + hi).astype(U))
                packed = (at << 16) | (lo << 8) | hi
                text_id = part.column("text_id").to_numpy()[row]
                pick = np.concatenate([first, many])
                grams = pa.array(gram[pick].view(np.int64), mask=np.arange(len(pick)) >= len(first))
                yield pa.RecordBatch.from_arrays([grams, pa.array(text_id[pick]), pa.array(packed[pick])], names=["gram", "text_id", "at"])

    return documents.select(_text_id().alias("text_id"), "text").mapInArrow(A.tidy(run), "gram long, text_id long, at long")


def _equal_contexts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for their equal contexts (same kind, same bytes), and all
    rows that have an equal. A row whose bytes differ from its hash's first row
    stands for itself."""
    key = A.mix64(A.range_hash(A.prefix_hashes(data), begin, end) + A.mix64(kind))
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    lead = first[back]
    other = np.flatnonzero((count[back] > 1) & (np.arange(len(key)) != lead))
    index = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    # a context is at most two windows long: its first and last cover it
    good = np.zeros(len(other), bool)
    for i in range(0, len(other), 4096):
        o = other[i : i + 4096]
        good[i : i + 4096] = (index[begin[o]] == index[begin[lead[o]]]).all(axis=1) & (index[end[o] - LENGTH] == index[end[lead[o]] - LENGTH]).all(axis=1)
    alone = np.ones(len(key), bool)
    alone[other[good]] = False
    hit = ~alone
    hit[lead[other[good]]] = True
    return np.flatnonzero(alone), np.flatnonzero(hit)


def _packed_texts(documents: DataFrame) -> DataFrame:
    """(text_id, packed) once per task and text long enough to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in A.chunks(batch, "text"):
                data, offsets = A.flat(part.column("text"))
                rows = [(i, pack.compress(data[a:b].tobytes())) for i, a, b in zip(part.column("text_id").to_pylist(), offsets[:-1], offsets[1:], strict=True) if b - a >= LENGTH and not (i in seen or seen.add(i))]
                if rows:
                    ids, texts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["text_id", "packed"])

    return documents.select(_text_id().alias("text_id"), "text").mapInArrow(A.tidy(run), "text_id long, packed binary")


def _contexts(places: DataFrame) -> DataFrame:
    """Cut the context of every repeated anchor. ``places``: (text_id, packed,
    spots: array of (gram, at, contexts)). Output (bucket, text_id, start, lo,
    hi, context, digest): context starts at ``start`` and holds the windows with
    offsets lo..hi, the one with offset x starting at byte hi - x. Pieces of
    split grams have a digest, and a context only where it is new in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["bucket", "text_id", "start", "lo", "hi", "context", "digest"]
        met: set[bytes] = set()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            spots = batch.column("spots")
            for i, text_id in enumerate(batch.column("text_id").to_pylist()):
                text = unpack.decompress(batch.column("packed")[i].as_buffer())
                spot = spots[i].values
                done: set[tuple[int, int]] = set()
                for gram, at, many in zip(*(spot.field(k).to_pylist() for k in ("gram", "at", "contexts")), strict=True):
                    if (gram, at) in done:  # the same text met in several tasks
                        continue
                    done.add((gram, at))
                    where, low, high = at >> 16, (at >> 8) & 255, at & 255
                    pieces = [(gram, low, high)]
                    if many > WIDE:
                        pieces = []
                        for x in range(low // SLICE, high // SLICE + 1):
                            core = text[where - x * SLICE : where - x * SLICE - SLICE + 1 + LENGTH]
                            key = hashlib.blake2b(core, digest_size=8, salt=x.to_bytes(2, "big")).digest()
                            pieces.append((int.from_bytes(key, "big", signed=True), max(low, x * SLICE), min(high, x * SLICE + SLICE - 1)))
                    for key, lo, hi in pieces:
                        start = where - hi
                        context = text[start : where - lo + LENGTH]
                        held += len(context)
                        digest = None
                        if many > WIDE:
                            digest = hashlib.blake2b(context, digest_size=32, salt=(lo * 256 + hi).to_bytes(2, "big"), key=key.to_bytes(8, "big", signed=True)).digest()
                            context = None if digest in met else context
                            met.add(digest)
                        for column, value in zip(out, (key, text_id, start, lo, hi, context, digest), strict=True):
                            column.append(value)
                if held > 4 * BUDGET:
                    yield _context_batch(out, names)
                    out, held = [[] for _ in names], 0
            if held:
                yield _context_batch(out, names)

    return places.mapInArrow(A.tidy(run), "bucket long, text_id long, start long, lo int, hi int, context binary, digest binary")


def _pieces_apart(pieces: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(text_id, first, last) runs of repeated window starts among the pieces of
    split grams, and the stored tables read. Pieces met twice repeat as a whole;
    buckets with more than ``WIDE`` different ones are decided by window."""
    pieces = stored(pieces, "suffix-pieces")
    several = pieces.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    whole = pieces.join(several, "digest").select("text_id", F.col("start").alias("first"), (F.col("start") + F.col("hi") - F.col("lo")).alias("last"))
    columns = ["bucket", "text_id", "start", "lo", "hi", "context"]
    one = stored(pieces.filter("context IS NOT NULL").groupBy("digest").agg(F.first(F.struct(*columns)).alias("p")).select("p.*"), "suffix-different")
    full = stored(one.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE).select("bucket"), "suffix-full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.chunks(batch, "context", BUDGET):
                rows = []
                for text_id, start, lo, hi, context in zip(*(part.column(c).to_pylist() for c in columns[1:]), strict=True):
                    rows += [(hashlib.blake2b(context[i : i + LENGTH], digest_size=32).digest(), text_id, start + i) for i in range(hi - lo + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["window", "text_id", "first"])

    windows = stored(one.join(full, "bucket", "left_semi").select(*columns).mapInArrow(A.tidy(run), "window binary, text_id long, first long"), "suffix-windows")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    found = _repeats(one.join(full, "bucket", "left_anti").select(*columns))
    return whole.union(found).union(windows.join(again, "window").select("text_id", "first", F.col("first").alias("last"))), [pieces, one, full, windows]


def _context_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def _decide(block: dict[str, np.ndarray], data: np.ndarray, offset: np.ndarray):
    """(text_id, first, last) runs of starts of repeated windows among whole
    buckets; ``offset`` holds the begin of each context."""
    lo, hi = block["lo"], block["hi"]
    size = hi - lo + LENGTH
    kind = block["bucket"].view(U) * U(65536) + (lo * 256 + hi).astype(U)
    alone, many = _equal_contexts(data, offset, offset + size, kind)
    met = np.zeros(len(lo), bool)
    met[many] = True
    # all windows of a context met twice repeat
    runs = [(many, lo[many], hi[many])]
    bucket = block["bucket"][alone]
    number = np.cumsum(np.concatenate([[False], bucket[1:] != bucket[:-1]]))
    count = np.bincount(number)[number]
    undecided = np.bincount(number, weights=~met[alone])[number] > 0
    index = SuffixIndex(data)
    close = (count > 1) & undecided & (count <= CLOSE)
    runs.append(_along_anchors(index, block, offset, alone[close], number[close]))
    wide = alone[(count > CLOSE) & undecided]
    if len(wide):
        runs.append(_by_windows(index, block, offset, wide, number[(count > CLOSE) & undecided]))
    row, low, high = (np.concatenate(x) for x in zip(*runs, strict=True))
    # the window with offset x starts hi - x bytes into its context
    first = block["start"][row] + hi[row] - high
    return (block["text_id"][row], first, first + high - low) if len(row) else None


def _along_anchors(index: SuffixIndex, block, offset: np.ndarray, rows: np.ndarray, group: np.ndarray):
    """(row, lowest, highest offset) of windows that contexts of a group share,
    from the sorted suffixes at their anchors."""
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none
    lo, hi = block["lo"], block["hi"]
    place = offset + hi  # of the gram
    room = np.zeros(len(index.data) + 1, np.int64)
    room[place[rows]] = LENGTH - lo[rows]
    owner = np.zeros(len(index.data) + 1, np.int64)
    owner[place[rows]] = rows
    suffix = index.sort(place[rows], group, room)
    of = owner[suffix]
    same = group[1:] == group[:-1]
    step = np.zeros(len(suffix), np.int64)
    at = np.flatnonzero(same)
    step[at] = index.common(suffix[at], suffix[at + 1], np.minimum(room[suffix[at]], room[suffix[at + 1]]))
    out, bad = [], []
    right, distance = step[at].copy(), 1
    while len(at):
        a, b = of[at], of[at + distance]
        most = np.minimum(hi[a], hi[b])
        far = right + most >= LENGTH
        a, b, r = a[far], b[far], right[far]
        left = index.common_left(place[a], place[b], most[far])
        low = np.maximum(LENGTH - r, np.maximum(lo[a], lo[b]))
        some = low <= left
        a, b, low, left = a[some], b[some], low[some], left[some]
        good = index.verified_equal(place[a] - left, place[b] - left) & index.verified_equal(place[a] - low, place[b] - low)
        bad.append(a[~good])
        out += [(a[good], low[good], left[good]), (b[good], low[good], left[good])]
        # one place further in the sorted order: the extension can only shrink,
        # but another partner may offer more to the left
        can = right + hi[of[at]] >= LENGTH
        at, right = at[can], right[can]
        go = at + distance + 1 < len(suffix)
        at, right = at[go], right[go]
        go = group[at + distance + 1] == group[at]
        at, right = at[go], right[go]
        right = np.minimum(right, step[at + distance])
        distance += 1
    collided = np.unique(block["bucket"][np.concatenate(bad)]) if bad else none
    for value in collided:
        out.append(_by_bytes(index, block, offset, rows[block["bucket"][rows] == value]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def _by_bytes(index: SuffixIndex, block, offset: np.ndarray, rows: np.ndarray):
    """The same by comparing the windows' bytes."""
    met: dict[tuple[int, bytes], list[int]] = {}
    for row in rows.tolist():
        for x in range(int(block["lo"][row]), int(block["hi"][row]) + 1):
            start = int(offset[row] + block["hi"][row] - x)
            met.setdefault((x, index.data[start : start + LENGTH].tobytes()), []).append(row)
    found = [(row, x) for (x, _), some in met.items() if len(some) > 1 for row in some]
    row = np.array([r for r, _ in found], np.int64)
    x = np.array([x for _, x in found], np.int64)
    return row, x, x


def _by_windows(index: SuffixIndex, block, offset: np.ndarray, rows: np.ndarray, group: np.ndarray):
    """The same with every window start as a suffix, sorted per offset."""
    count = block["hi"][rows] - block["lo"][rows] + 1
    row = np.repeat(rows, count)
    step = A.spread(np.zeros(len(rows), np.int64), count)  # 0 .. hi-lo, from the left
    key = np.repeat(group, count) * 256 + (block["hi"][row] - step)
    order = np.argsort(key, kind="stable")
    _, dense = np.unique(key[order], return_inverse=True)
    found = np.sort(repeated_suffixes(index, (offset[row] + step)[order], dense))
    of = np.searchsorted(offset, found, "right") - 1
    x = block["hi"][of] - (found - offset[of])
    return of, x, x


def _repeats(contexts: DataFrame) -> DataFrame:
    """(text_id, first, last) runs of repeated window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, BUDGET

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Decide about the buckets that have ended; the last may go on."""
            nonlocal held, size, limit
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bucket = table.column("bucket").to_numpy()
            ended = np.flatnonzero(bucket != bucket[-1])
            edge = len(bucket) if last else int(ended[-1]) + 1 if len(ended) else 0
            whole, rest = table.slice(0, edge), table.slice(edge)
            held, size = ([rest] if rest.num_rows else []), rest.nbytes
            limit = max(BUDGET, 2 * size)
            if edge:
                data, offset = A.flat(whole.column("context"))
                block = {c: whole.column(c).to_numpy().astype(np.int64) for c in ("bucket", "text_id", "start", "lo", "hi")}
                found = _decide(block, data, offset[:-1])
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["text_id", "first", "last"])

        for batch in batches:
            for part in A.chunks(batch, "context", BUDGET):
                held.append(part)
                size += part.nbytes
                if size > limit:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(A.tidy(run), "text_id long, first long, last long")


def repeated_windows(documents: DataFrame) -> DataFrame:
    """(text_id, first, last): runs of starts of repeated 200-byte strings. A
    text that occurs several times repeats from its first to its last start."""
    rows = stored(_anchor_rows(documents), "suffix-anchors")
    open_ = rows.filter("gram IS NOT NULL")
    local = rows.filter("gram IS NULL").selectExpr("text_id", "shiftright(at, 16) - (at & 255) AS first", "shiftright(at, 16) - (shiftright(at, 8) & 255) AS last")
    # a gram counts each place once: smallest and largest place differ
    place = F.xxhash64("text_id", "at")
    grams = stored(open_.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("gram", "contexts"), "suffix-grams")

    def contexts(some: DataFrame) -> DataFrame:
        spots = open_.join(some, "gram").groupBy("text_id").agg(F.collect_list(F.struct("gram", "at", "contexts")).alias("spots"))
        return _contexts(_one_each(documents).join(spots, "text_id").select("text_id", "packed", "spots"))

    found, tables = _repeats(contexts(grams.filter(F.col("contexts") <= WIDE)).drop("digest")), []
    wide = grams.filter(F.col("contexts") > WIDE)
    if not wide.isEmpty():
        split, tables = _pieces_apart(contexts(wide))
        found = found.union(split)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    copies = documents.select(_text_id().alias("text_id"), size.alias("size")).filter(F.col("size") >= LENGTH).groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size")).filter("n > 1")
    out = stored(found.union(local).union(copies.select("text_id", F.lit(0).cast("long"), (F.col("size") - LENGTH).cast("long"))), "suffix-repeats")
    discard(rows, grams, *tables)
    return out


def _one_each(documents: DataFrame) -> DataFrame:
    return _packed_texts(documents).groupBy("text_id").agg(F.first("packed").alias("packed"))


def _spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered byte runs of window-start runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + LENGTH))
        else:
            out.append((a, b + LENGTH))
    return out


def remove_repeats(documents: DataFrame, as_text: bool = False) -> DataFrame:
    """``documents`` plus (__kept, __spans array of [start, end)): the bytes that
    stay and the byte runs removed from each text. ``as_text`` gives __kept as a
    string, without the rest of a character that a run cuts."""
    runs = _run_lists(repeated_windows(documents))
    keyed = documents.withColumn("__text_id", _text_id())
    joined = keyed.join(runs.withColumnRenamed("text_id", "__text_id"), "__text_id", "left").drop("__text_id")
    kept = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.chunks(batch, "text"):
                data, offsets = A.flat(part.column("text"))
                remain, spans = [], []
                first, last = part.column("__first"), part.column("__last")
                for i in range(part.num_rows):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    cut = _spans(first[i].values.to_numpy(), last[i].values.to_numpy()) if first[i].is_valid else []
                    edges = [0, *(e for s in cut for e in s), len(text)]
                    remain.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in cut])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                if as_text:
                    remain = [r.decode("utf-8", "ignore") for r in remain]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(remain, pa.string() if as_text else pa.binary()), pa.array(spans, kind)], names=[*kept, "__kept", "__spans"])

    schema = documents.withColumn("__kept", F.lit("" if as_text else b"")).withColumn("__spans", F.expr("array(struct(0L AS start, 0L AS end))")).schema
    return joined.mapInArrow(A.tidy(run), schema)


def _run_lists(runs: DataFrame) -> DataFrame:
    return runs.groupBy("text_id").agg(F.collect_list("first").alias("__first"), F.collect_list("last").alias("__last"))


def repeat_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row. Digests are
    made once per text that loses something and joined to its rows."""
    documents = documents.select("doc_id", "text")
    texts = _one_each(documents).join(_run_lists(repeated_windows(documents)), "text_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i, text_id in enumerate(batch.column("text_id").to_pylist()):
                text = unpack.decompress(batch.column("packed")[i].as_buffer())
                cut = _spans(batch.column("__first")[i].values.to_numpy(), batch.column("__last")[i].values.to_numpy())
                edges = [0, *(e for s in cut for e in s), len(text)]
                digest = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    digest.update(text[a:b])
                rows.append((text_id, sum(b - a for a, b in cut), len(cut), digest.hexdigest()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["text_id", "n_removed", "n_spans", "sha"])

    cut = texts.mapInArrow(A.tidy(run), "text_id long, n_removed long, n_spans long, sha string")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", _text_id().alias("text_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(cut, "text_id", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
