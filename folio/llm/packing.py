"""Packing documents into fixed-length training sequences by Karmarkar-Karp
multiway differencing.

A document's ids are cut into full sequences and a remainder, a remainder of
more than half a sequence into two pieces (with pieces of at most half a window
the windows come out nearly equal and nearly full). The remaining pieces of a
batch are partitioned into k windows: every piece starts as a partial
partition with one filled window; the two partial partitions with the largest
imbalance are merged over and over, the fullest window of one with the emptiest
of the other, so that opposing imbalances cancel. k starts at the least count
that the ids need and rises whenever a window exceeds the capacity.

Batches are made inside each input partition, so nothing is shuffled and no
group meets in one task. A batch holds a fixed number of pieces.

Edge cases: a null or empty text is the end id alone; rows repeating a doc_id
are separate documents; a null doc_id is carried as null; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrowtext as A
from folio.llm.tokens import default_tokenizer, encoder

CAPACITY = 1024
END_ID = 0
#: Pieces partitioned together.
BATCH = 512


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: item numbers of k windows with near-equal sums."""
    if not sizes:
        return [[] for _ in range(k)]
    # a partial partition: filled windows as (sum, items), fullest first; the
    # other k - len windows are empty
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        one, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(one) < len(other):
            one, other = other, one
        free = k - len(one)
        merged = one
        if len(other) <= free:  # both fit side by side
            merged = one + other
        else:
            # other's fullest windows take the empty ones, the rest meet the
            # emptiest filled windows, fullest with emptiest
            alone, paired = other[:free], other[free:]
            head, tail = one[: len(one) - len(paired)], one[len(one) - len(paired) :]
            merged = head + alone + [(a + b, x + y) for (a, x), (b, y) in zip(tail, reversed(paired), strict=True)]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        serial += 1
        heapq.heappush(heap, (-spread, serial, merged))
    windows = [items for _, items in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows within the capacity; their number rises until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += max(1, k // 128)


def pack(documents: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, batch: int = BATCH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Every id lies in exactly one piece."""
    path = tokenizer or default_tokenizer()
    largest = max(1, capacity // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        waiting: list[tuple] = []
        out: list[tuple] = []
        coder = encoder(path)

        def close() -> None:
            nonlocal sequence
            for window in windows([w[2] for w in waiting], capacity):
                offset = 0
                for i in window:
                    out.append((*waiting[i], sequence, offset))
                    offset += waiting[i][2]
                sequence += 1
            waiting.clear()

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for part in A.chunks(b, "text"):
                ids, cut = coder.encode(part.column("text"))
                for doc_id, lo, hi in zip(part.column("doc_id").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own = np.append(ids[lo:hi], end_id).astype("<u4")
                    start = 0
                    while start < len(own):
                        left = len(own) - start
                        size = capacity if left >= capacity else min(left, largest)
                        row = (doc_id, start, size, zlib.crc32(own[start : start + size].tobytes()), len(own))
                        start += size
                        if size == capacity:
                            out.append((*row, sequence, 0))
                            sequence += 1
                        else:
                            waiting.append(row)
                            if len(waiting) >= batch:
                                close()
                if out:
                    yield emit()
        if waiting:
            close()
        if out:
            yield emit()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(A.tidy(run), schema)
