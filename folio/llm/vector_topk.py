"""Exact top-k inner products through a pivot-distance index.

Vectors are integers: floor(256 * x) per component. With M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) make the inner product a distance:
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the best scores are the nearest points.

Index. Every vector is keyed by its nearest pivot and its distance to it; range
partitioning by that key cuts each pivot's points into annuli, blocks of at most
``BLOCK`` rows, so that a pivot with any share of all rows spreads over tasks.

Search, for a stated query set in blocks. First each query meets the annuli of
its own pivot around its own distance, which gives the score its k-th answer has
at least, hence a radius. Then the annuli expand: by the triangle inequality an
annulus [lo, hi] of pivot p can hold an answer only if d(q', p) - r <= hi and
d(q', p) + r >= lo; all others are never read. Scores are computed in exact
integer arithmetic (float64 products while they stay below 2^53, else 64-bit
integers).

Copies. Of equal vectors the k + 1 smallest ids are candidates, which is enough
for every answer, and equal query vectors are searched once, for k + 1 answers;
each query then drops itself and keeps k.

The pivots are a documented, bounded sample (the ``PIVOTS`` vectors whose ids
hash lowest); every candidate is indexed and the search is exact.

Edge cases: null vectors, vectors with a null or non-finite component and rows
without an id take no part; rows repeating an id count once (greatest vector);
missing trailing components count as zero; ties go to the smaller id; fewer
than k candidates give all; other columns are ignored. Where a square of a length
reaches 2^62 (components of some 2^22 in few dimensions), inner products might leave
64 bits: the search fails, it gives no wrapped scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import arrowtext as A
from folio.llm.storage import stored

PIVOTS = 32
BLOCK = 1024
QUERY_BLOCK = 256
#: Rounding of distances, relative to the longest vector: squares of lengths cancel.
SLACK = 1e-7
#: Largest square of a length; no inner product exceeds it.
MAX_NORM2 = 2.0**62


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<long>, norm2) of the rows that take part."""
    x = F.col("v")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return (
        embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
        .select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("vector"))
        .groupBy("vec_id").agg(F.max("vector").alias("vector"))
        .withColumn("norm2", F.aggregate("vector", F.lit(0).cast("double"), lambda acc, c: acc + c.cast("double") * c))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    flat, off = column.flatten().to_numpy(), column.offsets.to_numpy()
    off = off - off[0]
    size = np.diff(off)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Space:
    """The pivots in the lifted space."""

    def __init__(self, pivots: np.ndarray, norm2: np.ndarray, top: float):
        self.pivots, self.top, self.width = pivots.astype(np.float64), top, pivots.shape[1]
        self.norm2 = norm2
        self.lift = np.sqrt(np.maximum(top - norm2, 0))

    def slack(self, away: np.ndarray) -> np.ndarray:
        return SLACK * (1 + away + np.sqrt(self.top))

    def distances(self, x: np.ndarray, norm2: np.ndarray, lifted: bool) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.top - norm2, 0)) if lifted else np.zeros(len(x))
        square = (norm2 + lift**2)[:, None] + self.top - 2 * (x.astype(np.float64) @ self.pivots.T + lift[:, None] * self.lift)
        return np.sqrt(np.maximum(square, 0))


def _blocks(keyed: DataFrame, size: int, name: str) -> DataFrame:
    """Consecutive rows of one pivot, by distance, as (block, pivot, lo, hi, ids, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            rows = sorted(held, key=lambda r: r[2])  # by id: a stable order then breaks ties
            block = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([rows[0][0]], pa.int32()), pa.array([min(r[1] for r in rows)]), pa.array([max(r[1] for r in rows)]),
                 pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(r[3] for r in rows)], pa.binary())],
                names=["block", "pivot", "lo", "hi", "ids", "data"])
            number += 1
            held.clear()
            return block

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "distance", "vec_id", "data")), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= size):
                    yield close()
                held.append(row)
        if held:
            yield close()

    ordered = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return stored(ordered.mapInArrow(A.tidy(run), "block long, pivot int, lo double, hi double, ids array<long>, data binary"), name)


def _search(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, space: _Space, k: int) -> DataFrame:
    """Best k of every (query block, block) pair: (query_id, vec_id, score).
    Queries carry the score their k-th answer has at least (``least``)."""
    joined = pairs.join(queries.select("query_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "least"), "query_block").join(
        blocks.select("block", "pivot", "lo", "hi", "ids", "data"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: B023, E731
                q_ids, ids = get("q_ids").values.to_numpy(), get("ids").values.to_numpy()
                q = np.frombuffer(get("q_data").as_buffer(), np.int64).reshape(len(q_ids), space.width)
                x = np.frombuffer(get("data").as_buffer(), np.int64).reshape(len(ids), space.width)
                least = get("least").values.to_numpy(zero_copy_only=False)
                norm2 = (q.astype(np.float64) ** 2).sum(axis=1)
                radius = np.sqrt(np.maximum(norm2 + space.top - 2 * least, 0))
                away = space.distances(q, norm2, False)[:, get("pivot").as_py()]
                slack = space.slack(away)
                near = (away - radius <= get("hi").as_py() + slack) & (away + radius >= get("lo").as_py() - slack)
                if not near.any():
                    continue
                q, q_ids, least = q[near], q_ids[near], least[near]
                score = products(q, x)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                row = np.arange(len(q_ids))[:, None]
                ok = score[row, best] >= least[:, None]
                r, c = np.nonzero(ok)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(ids[best[r, c]]), pa.array(score[r, best[r, c]])], names=["query_id", "vec_id", "score"])

    return joined.mapInArrow(A.tidy(run), "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, *, k: int = 5, query_filter=None, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query row,
    by default those whose id is divisible by 50."""
    spark = embeddings.sparkSession
    vectors = stored(quantised(embeddings, id_col, vector_col), "topk-vectors")
    is_query = query_filter if query_filter is not None else F.col("vec_id") % 50 == 0
    schema = "query_id long, rank int, vec_id long, score long"
    figures = vectors.agg(F.max("norm2").alias("top"), F.max(F.size("vector")).alias("width")).first()
    if figures["top"] is None:
        return spark.createDataFrame([], schema)
    width, top = max(1, figures["width"]), figures["top"]
    if top >= MAX_NORM2:
        raise ValueError(f"inner products may leave 64 bits: a vector's integer square length is {top:.3g}")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()  # a bounded sample
    space = _Space(_matrix(sample.column("vector").combine_chunks(), width), sample.column("norm2").to_numpy(), top)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"), width).astype(np.int64)
                away = space.distances(x, batch.column("norm2").to_numpy(), True)
                nearest = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(x)), nearest]), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["vec_id", "pivot", "distance", "data"])

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("vec_id", "vector", "norm2").mapInArrow(A.tidy(key), "vec_id long, pivot int, distance double, data binary")

    # of equal vectors the first k + 1 ids (Spark limits each group before it is shuffled)
    copy = Window.partitionBy("vector").orderBy("vec_id")
    candidates = vectors.withColumn("copy", F.row_number().over(copy)).filter(F.col("copy") <= k + 1)
    asking = vectors.filter(is_query)
    groups = stored(asking.groupBy("vector", "norm2").agg(F.min("vec_id").alias("vec_id")), "topk-asked")

    blocks = _blocks(keyed(candidates), BLOCK, "topk-blocks")
    asked = _blocks(keyed(groups), QUERY_BLOCK, "topk-queries").withColumnRenamed("block", "query_block")

    # first answers: annuli of the own pivot around the own distances
    b = blocks.select("block", "pivot", "lo", "hi")
    q = asked.select("query_block", "pivot", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    first = b.join(q, "pivot").filter("hi >= q_lo AND lo <= q_hi").select("query_block", "block")
    unknown = asked.withColumn("least", F.transform("ids", lambda _: F.lit(float("-inf"))))
    found = stored(_search(first, unknown, blocks, space, k + 1), "topk-first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bound = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k + 1).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bound"))
    # put the bounds beside the ids of each query block, in their order
    each = asked.select("query_block", F.posexplode("ids").alias("at", "id")).join(bound, "id", "left")
    lists = each.groupBy("query_block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(float("-inf"))).alias("least")))).alias("l"))
    ready = stored(asked.join(lists.select("query_block", F.transform("l", lambda s: s["least"]).alias("least")), "query_block"), "topk-ready")

    # expand: per query block and pivot, the distances that can hold an answer
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = np.frombuffer(batch.column("data")[i].as_buffer(), np.int64).reshape(-1, width)
                norm2 = (rows.astype(np.float64) ** 2).sum(axis=1)
                radius = np.sqrt(np.maximum(norm2 + top - 2 * batch.column("least")[i].values.to_numpy(zero_copy_only=False), 0))[:, None]
                away = space.distances(rows, norm2, False)
                slack = space.slack(away)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(away.shape[1], batch.column("query_block")[i].as_py())), pa.array(np.arange(away.shape[1], dtype=np.int32)),
                     pa.array((away - radius - slack).min(axis=0)), pa.array((away + radius + slack).max(axis=0))],
                    names=["query_block", "pivot", "from", "to"])

    spans = ready.select("query_block", "data", "least").mapInArrow(A.tidy(reach), "query_block long, pivot int, from double, to double")
    more = b.join(spans, "pivot").filter("hi >= from AND lo <= to").select("query_block", "block").join(first, ["query_block", "block"], "left_anti")
    every = found.union(_search(more, ready, blocks, space, k + 1))
    answers = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("answers"))
    # back to every query of an equal vector, without itself
    shared = groups.select("vector", F.col("vec_id").alias("query_id")).join(answers, "query_id").select("vector", "answers")
    each = asking.select(F.col("vec_id").alias("query_id"), "vector").join(shared, "vector").select("query_id", F.explode("answers").alias("a")).select("query_id", "a.vec_id", "a.score")
    return each.filter("query_id <> vec_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 5) -> str:
    """The same rows in DuckDB SQL, by comparing every query with every row."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
