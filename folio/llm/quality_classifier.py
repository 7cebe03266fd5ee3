"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Features of a text are hashed occurrences of words, word pairs and triples of
word shapes (case, digits, kind of symbol), each group weighted by its share of
the text. Training reads a bounded sample of labelled rows; scoring reads every
text whole and needs only the weight vector (``2**bits`` floats, a fixed size).

Edge cases: a null or empty text has no features and scores the bias alone; a
null label or id never trains; repeated ids in the labels count once (greatest
label); other columns of the input are left alone; without labelled rows of
both classes the model is constant (the label mean, 0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import arrowtext as A

BITS = 18
#: Bound on the labelled documents that training reads.
MAX_TRAIN_DOCS = 8000
SCALE = 6.0


def _shape_table() -> np.ndarray:
    """Bit flags per byte: lower, upper, digit, other letter, and symbol kinds."""
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 4
    table[128:] = 8
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 16
    table[ord("!")] = 32
    table[[ord(c) for c in "#*$%&|<>"]] = 64
    table[[ord(c) for c in "/@_=+~^{}[]\\`"]] = 128
    return table


SHAPES = _shape_table()


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """(row, slot, value) triples, sorted by row, of all rows of a chunk."""
    starts, ends, words = A.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    prefix = A.prefix_hashes(data)
    word = A.mix64(A.range_hash(prefix, starts, ends))
    flags = np.bitwise_or.reduceat(SHAPES[data], starts).astype(np.uint64)
    # reduceat runs to the next word's start: separators carry no flag
    long_word = (np.minimum(ends - starts, 15) // 4).astype(np.uint64)
    shape = flags * np.uint64(4) + long_word
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    rows, slots, values = [], [], []
    shift = np.uint64(64 - bits)
    for width, keys, factor in ((1, word, 0x1F), (2, word, 0x2F), (3, shape, 0x3F)):
        n = len(word) - width + 1
        if n <= 0:
            continue
        key = keys[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(factor)
        for i in range(1, width):
            key = A.mix64(key) + keys[i : i + n] * np.uint64(0xD6E8FEB86659FD93)
        ok = row[:n] == row[width - 1 :]
        r = row[:n][ok]
        count = np.bincount(r, minlength=len(offsets) - 1)
        rows.append(r)
        slots.append((A.mix64(key[ok]) >> shift).astype(np.int64))
        values.append((SCALE / np.maximum(count, 1)[r]).astype(np.float32))
    row, slot, value = map(np.concatenate, (rows, slots, values))
    order = np.argsort(row, kind="stable")
    return row[order], slot[order], value[order]


def _combined(slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(slot, return_inverse=True)
    return unique, np.bincount(inverse, weights=value)


def ftrl(examples, bits: int = BITS, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
    """Per-coordinate FTRL-proximal over (slots, values, label) examples; the
    last slot is the bias. Returns the weight vector."""
    z = np.zeros((1 << bits) + 1)
    n = np.zeros_like(z)

    def weights(at):
        keep = np.abs(z[at]) > l1
        return np.where(keep, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for slots, values, label in examples:
            at = np.append(slots, 1 << bits)
            x = np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def train(texts: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
          usable: Column | None = None, max_docs: int = MAX_TRAIN_DOCS, bits: int = BITS) -> np.ndarray:
    """Weights fitted on at most ``max_docs`` labelled texts, those whose id
    hashes lowest, then by id and the text's hash; rows repeating an id and its
    text count once. Features are made where the texts lie (the sample, at most
    ``max_docs``, is broadcast); one task runs the updates over them."""
    pool = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        pool = pool.filter(usable)
    pool = pool.groupBy(id_col).agg(F.max(label_col).cast("double").alias("__label"))
    sample = pool.withColumn("__order", F.xxhash64(id_col)).orderBy("__order", id_col).limit(max_docs)
    rows = texts.select(F.col(id_col), F.col(text_col).alias("__text"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("__hash")).join(F.broadcast(sample), id_col)
    # an id may have any number of rows: the bound holds for what is trained on
    chosen = rows.select(id_col, "__hash", "__order").distinct().orderBy("__order", id_col, "__hash").limit(max_docs).drop("__order")
    rows = rows.join(F.broadcast(chosen), [id_col, "__hash"]).groupBy(id_col, "__hash").agg(*(F.first(c).alias(c) for c in ("__text", "__order", "__label")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.chunks(batch, "__text"):
                data, offsets = A.flat(part.column("__text"))
                row, slot, value = features(data, offsets, bits)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                pairs = [_combined(slot[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__order"), part.column("__hash"), part.column("__label"),
                     pa.array([s.astype(np.int32) for s, _ in pairs], pa.list_(pa.int32())),
                     pa.array([v.astype(np.float32) for _, v in pairs], pa.list_(pa.float32()))],
                    names=["__order", "__hash", "__label", "slots", "values"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            slots, values = batch.column("slots"), batch.column("values")
            for i in range(batch.num_rows):
                examples.append((slots[i].values.to_numpy(), values[i].values.to_numpy(), batch.column("__label")[i].as_py()))
        classes = {label for *_, label in examples}
        if len(classes) < 2:
            weights = np.zeros((1 << bits) + 1, np.float32)
            weights[-1] = 0.0 if not classes else 4.0 if classes == {1.0} else -4.0
        else:
            weights = ftrl(examples, bits)
        at = np.flatnonzero(weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["slot", "weight"])

    made = rows.mapInArrow(A.tidy(extract), "__order long, __hash string, __label double, slots array<int>, values array<float>")
    fitted = made.repartition(1).sortWithinPartitions("__order", F.size("slots"), "__label", "__hash").mapInArrow(A.tidy(fit), "slot int, weight float").toPandas()
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[fitted["slot"].to_numpy()] = fitted["weight"].to_numpy()
    return weights


def score(texts: DataFrame, weights: np.ndarray, *, text_col: str = "text", output: str = "score") -> DataFrame:
    """``texts`` with the probability of label 1 added, computed from the whole
    text alone. An existing column named like the output is replaced."""
    spark = texts.sparkSession
    bits = int(len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights)
    texts = texts.drop(output)
    kept = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in A.chunks(batch, text_col):
                data, offsets = A.flat(part.column(part.schema.get_field_index(text_col)))
                row, slot, value = features(data, offsets, bits)
                dot = np.bincount(row, weights=w[slot] * value, minlength=part.num_rows) + w[-1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-dot)), pa.float64())], names=[*kept, output])

    schema = texts.withColumn(output, F.lit(0.0).cast("double")).schema
    return texts.mapInArrow(A.tidy(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never used for labels: crc32 of the id as text leaves 2 mod 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def quality_scores(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. A null id is
    not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label"))
    weights = train(documents, known, usable=~held_out(), max_docs=max_docs)
    scored = score(documents.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
