"""Words as machine integers: short ones in one or two uint64, longer ones in
byte strings of a common width, and a radix sort over such columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD_BYTES = 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20  # only A-Z are lower-cased


def byte_rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Matrix of ``width`` bytes per word, padded with zeros. ``data`` must have
    ``width`` bytes to spare behind its last word."""
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
    rows[np.arange(width) >= lengths[:, None]] = 0
    return rows


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words of 1 to 8 bytes as big-endian integers: integer order is byte order,
    and as words hold no zero byte no two of them share an integer. ``data`` must
    have eight bytes to spare behind its last word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    rows = np.lib.stride_tricks.sliding_window_view(data, WORD_BYTES)[starts]
    words = np.ascontiguousarray(rows).view(">u8")[:, 0].astype(np.uint64)
    return words & (_ALL << (np.uint64(8) * (np.uint64(WORD_BYTES) - lengths.astype(np.uint64))))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned integer columns, the most significant first:
    least significant digits of 16 bits go first, one counting pass each (numpy's
    stable sort of 16-bit integers); digits that do not vary are skipped."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, 8 * column.dtype.itemsize, 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def as_strings(rows: np.ndarray) -> pa.Array:
    """Zero-padded byte rows as an Arrow string column."""
    filled = rows != 0
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(filled.sum(axis=1), out=offsets[1:])
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(rows[filled]))
