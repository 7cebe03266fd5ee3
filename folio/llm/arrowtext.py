"""Text columns of Arrow batches as flat UTF-8 bytes, cut into bounded chunks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

# Fixed value: the word separators of the contracts, \x20 and \x09-\x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(SEPARATORS)] = True

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLDED = np.arange(256)
_FOLDED[0x41:0x5B] += 0x20
BYTE_VALUE_FOLDED = BYTE_VALUE[_FOLDED]

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse mod 2**64 for i < n (grown on demand)."""
    global _powers, _inverse
    if len(_powers) < n:
        n = 1 << int(n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, np.uint64(base & (2**64 - 1)))
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverse


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers ``data[:i]``; differences of two
    entries times the inverse power of the start are position-free."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


#: Ranges up to so many bytes have a polynomial key. Texts of 1024 bytes are known
#: that any polynomial modulo 2**64 takes for equal; longer ranges get a digest.
POLYNOMIAL_BYTES = 255


def range_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, folded: bool = False) -> np.ndarray:
    """64-bit keys of byte ranges; with ``folded``, A-Z count as a-z."""
    values = BYTE_VALUE_FOLDED if folded else BYTE_VALUE
    keys = mix64(range_hash(prefix_hashes(data, values), starts, ends) + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES).tolist():
        part = data[starts[i] : ends[i]]
        digest = hashlib.blake2b((_FOLDED[part].astype(np.uint8) if folded else part).tobytes(), digest_size=8).digest()
        keys[i] = np.uint64(int.from_bytes(digest, "little"))
    return keys


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def tidy(run):
    """Wrap a task's function: when its input has ended, what the allocators
    still hold goes back to the system, since the worker stays for other tasks."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most ``limit`` bytes of the column
    (a single longer text stays whole)."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(batch.schema.get_field_index(name))
    _, off = flat(column)
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every row (or
    of the runs of bytes that ``breaks`` leaves), and the range of word numbers
    per row. Words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~breaks[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = solid[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start .. start+length``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)
