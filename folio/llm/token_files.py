"""Token ids in bit-packed files: every id in the minimum bits of the vocabulary.

File layout: magic and bit width; blocks of 4096 ids, each starting on a byte;
then the index - block offsets, document ids and token counts - and a trailer
that points at it. A reader seeks to any block through the offsets and unpacks
it with numpy. Ids lie most significant bit first.

``write`` range-partitions by doc_id and a hash of the text, so that an id of many
texts (null, say) spreads over tasks, and writes one file per partition into the
shared folder, ids in ascending doc_id order (null first, rows repeating an id
side by side), so the files in order of their number are the whole sequence. Only
rows equal in both lie in one file.

Edge cases: a null or empty text is the end id alone; other columns are
ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import arrowtext as A
from folio.llm.storage import Publication, by_file, open_folder, shared_folder, stored
from folio.llm.tokens import default_tokenizer, encoder

MAGIC = b"IDBITS01"
BLOCK = 4096
END_ID = 2
NO_ID = -(1 << 63)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :].reshape(-1)).tobytes()


def unpack_bits(raw: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f">u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width).reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


class Writer:
    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.offsets, self.docs, self.counts = [], [], []
        self.waiting, self.held = [], 0
        self.at = 0
        self._put(MAGIC + struct.pack("<I", width))

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for lo in range(0, whole, BLOCK):
            self.offsets.append(self.at)
            self._put(pack_bits(ids[lo : lo + BLOCK][: whole - lo], self.width))
        self.waiting = [ids[whole:]]
        self.held = len(ids) - whole

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._blocks(False)

    def finish(self) -> None:
        self._blocks(True)
        index = self.at
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.counts, "<u8")):
            self._put(np.array(values, kind).tobytes())
        self._put(struct.pack("<QQQ", index, len(self.offsets), len(self.docs)) + MAGIC)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if bytes(file.read_at(8, 0)) != MAGIC or bytes(file.read_at(8, size - 8)) != MAGIC:
            raise ValueError("not a complete token file")
        self.width = struct.unpack("<I", file.read_at(4, 8))[0]
        index, blocks, docs = struct.unpack("<QQQ", file.read_at(24, size - 32))
        raw = file.read_at(8 * (blocks + 2 * docs), index)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(index)).astype(np.int64)
        self.docs = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        self.cut = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", docs, 8 * (blocks + docs)).astype(np.int64))])

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last-1 of the file."""
        if last <= first:
            return np.zeros(0, np.uint32)
        lo, hi = first // BLOCK, (last - 1) // BLOCK + 1
        raw = self.file.read_at(int(self.offsets[hi] - self.offsets[lo]), int(self.offsets[lo]))
        total = int(self.cut[-1])
        parts = []
        for b in range(lo, hi):
            a = int(self.offsets[b] - self.offsets[lo])
            parts.append(unpack_bits(raw[a : a + int(self.offsets[b + 1] - self.offsets[b])], self.width, min(BLOCK, total - b * BLOCK)))
        return np.concatenate(parts)[first - lo * BLOCK : last - lo * BLOCK]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.cut[number]), int(self.cut[number + 1]))


def write(documents: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the manifest (part, file, n_docs, n_tokens)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        publication = writer = None
        coder = encoder(path)
        width = width_of(max(coder.size, end_id + 1))
        for batch in batches:
            for piece in A.chunks(batch, "text"):
                if writer is None:
                    publication = Publication(folder, f"ids-{part:06d}.bits")
                    writer = Writer(publication, width)
                ids, cut = coder.encode(piece.column("text"))
                for doc_id, lo, hi in zip(piece.column("doc_id").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    writer.add(doc_id, np.append(ids[lo:hi], end_id).astype(np.uint32))
        if writer is not None:
            writer.finish()
            publication.publish()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([f"ids-{part:06d}.bits"]), pa.array([len(writer.docs)]), pa.array([int(sum(writer.counts))])],
                names=["part", "file", "n_docs", "n_tokens"])

    keyed = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return stored(ordered.mapInArrow(A.tidy(run), "part long, file string, n_docs long, n_tokens long"), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.
    ``start`` counts the ids of all documents before it."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base_path = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{base_path}/{name}") as file:
                    reader = Reader(file)
                    total, at = len(reader.docs), 0
                    while at < total:  # a run of documents at a time
                        end = max(at + 1, int(np.searchsorted(reader.cut, reader.cut[at] + (1 << 20), "right")) - 1)
                        ids = reader.ids(int(reader.cut[at]), int(reader.cut[end])).astype("<u4")
                        lo = reader.cut[at : end + 1] - reader.cut[at]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(lo[:-1], lo[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([None if d == NO_ID else d for d in reader.docs[at:end].tolist()], pa.int64()),
                             pa.array(base + reader.cut[at:end]), pa.array(np.diff(lo)), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = end

    return by_file(stored(placed.select("part", "file", "base"), "token-bases"), "part").mapInArrow(A.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(documents: DataFrame) -> DataFrame:
    """Write all documents' ids as files, then read them back."""
    folder = shared_folder(documents.sparkSession, "token-files")
    return read(write(documents, folder), folder)
