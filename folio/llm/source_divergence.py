"""Source divergence audit: how far the vocabulary of each source strays from
the other sources of its language, and by which terms.

Terms are the runs of letters (ASCII letters and all characters beyond ASCII)
of every whole text, A-Z lower-cased. They are counted by length-bucketed
packing: in each Spark task the terms of a chunk are cut by numpy; terms of up to
8 bytes become one uint64 and terms of up to 16 bytes two, which are
radix-sorted and run-counted; longer terms go in buckets of one byte width each
(a power of two), which are sorted as bytes. Counts of a task are merged the same
way while they fit ``HELD_BYTES`` and leave as (language, source, term, count,
documents) rows, so a term of every document is combined before the shuffle.

Spark then folds these rows by (language, term), keeps the terms of at least
``min_docs`` documents of a language and scores them. With N the count of a
group's kept terms and V the kept terms of the language, a term's share is
``p = 1 + floor(10**9 * (count + 1) / (N + V))`` and the divergence of p from q
is ``floor((p - q)**2 / q)``, all in integers.

``pair`` rows sum the divergence of a source from each other source of its
language over all kept terms. Most counts are zero, so the sum is put together
from four parts, which need no row per (source, term) without occurrences: the
value of terms absent from both (one figure), terms of the one and terms of the
other taken as if the partner had none (by the histogram of counts), and a
correction for terms that both have (numpy, over the postings of each term).
``term`` rows list what a source uses more than its language does.

Defined cases: null texts, languages and sources read as ''. Each row is a
document of its own, whether its id repeats or is null. A group without kept
terms still has its ``pair`` rows (value 0 if the language keeps no term), a
language with one source has none. Ties are ranked by item in UTF-8 order. Terms
may be as long as their text. An empty table gives no rows. Other input columns
are not read. The number of ``pair`` rows is sources times sources of a language,
as asked for; nothing else grows faster than the corpus vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.arrowtext import chunks, flat, tidy, word_spans
from folio.llm.packed_words import FOLD, WORD_BYTES, as_strings, byte_rows, packed, radix_order
from folio.llm.storage import stored

SCALE = 10**9
MIN_DOCS = 3
TOP_TERMS = 200
#: Counts a task holds before it hands them on.
HELD_BYTES = 32 << 20
#: Cells of one step of the correction (terms x sources x sources).
STEP_CELLS = 1 << 20

# Fixed value: terms are runs of [^\x00-\x40\x5B-\x60\x7B-\x7F].
TERM_BREAK = np.ones(256, bool)
TERM_BREAK[0x41:0x5B] = TERM_BREAK[0x61:0x7B] = TERM_BREAK[0x80:] = False

COUNT_SCHEMA = "lang string, source string, term string, n long, docs long"


def _differs(column: np.ndarray) -> np.ndarray:
    out = np.ones(len(column), bool)
    out[1:] = column[1:] != column[:-1]
    return out


class _Bucket:
    """Counts of the terms of one length class: sorted key columns, group, count
    and documents. ``width`` is 8 or 16 for packed terms, else the byte width."""

    def __init__(self, width: int):
        self.width, self.parts, self.rows = width, [], 0

    def keys(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        if self.width == WORD_BYTES:
            return [packed(data, starts, lengths)]
        if self.width == 2 * WORD_BYTES:
            full = np.full(len(starts), WORD_BYTES)
            return [packed(data, starts, full), packed(data, starts + WORD_BYTES, lengths - WORD_BYTES)]
        return [byte_rows(data, starts, lengths, self.width).view(f"S{self.width}")[:, 0]]

    def order(self, keys: list[np.ndarray], group: np.ndarray) -> np.ndarray:
        if self.width <= 2 * WORD_BYTES:
            return radix_order([*keys, group])
        order = radix_order([group])
        return order[np.argsort(keys[0][order], kind="stable")]

    def count(self, keys: list[np.ndarray], group: np.ndarray, row: np.ndarray) -> None:
        """Run-count one chunk's terms, given in row order."""
        order = self.order(keys, group)
        keys, group, row = [k[order] for k in keys], group[order], row[order]
        run = np.logical_or.reduce([_differs(k) for k in [*keys, group]])
        begin = np.flatnonzero(run)
        docs = np.add.reduceat((run | _differs(row)).astype(np.int64), begin)
        self.put(keys, group, begin, np.diff(begin, append=len(run)), docs)

    def put(self, keys, group, begin, n, docs) -> None:
        self.parts.append(([k[begin] for k in keys], group[begin], n, docs))
        self.rows += len(begin)

    def merge(self) -> None:
        """One sorted run of all parts."""
        if len(self.parts) < 2:
            return
        keys = [np.concatenate(k) for k in zip(*(p[0] for p in self.parts))]
        group, n, docs = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3))
        order = self.order(keys, group)
        keys, group = [k[order] for k in keys], group[order]
        begin = np.flatnonzero(np.logical_or.reduce([_differs(k) for k in [*keys, group]]))
        self.parts, self.rows = [], 0
        self.put(keys, group, begin, np.add.reduceat(n[order], begin), np.add.reduceat(docs[order], begin))

    @property
    def held(self) -> int:
        return self.rows * (max(self.width, WORD_BYTES) + 24)

    def terms(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        keys, group, n, docs = self.parts[0]
        if self.width <= 2 * WORD_BYTES:
            rows = np.stack(keys, axis=1).astype(">u8").view(np.uint8).reshape(len(n), self.width)
        else:
            rows = np.ascontiguousarray(keys[0]).view(np.uint8).reshape(len(n), self.width)
        return as_strings(rows), group, n, docs


class _Tally:
    """Counts of one task."""

    def __init__(self):
        self.buckets: dict[int, _Bucket] = {}
        self.groups: dict[tuple[str, str], int] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        code = np.fromiter(
            (self.groups.setdefault(k, len(self.groups)) for k in zip(batch["lang"].to_pylist(), batch["source"].to_pylist())),
            np.uint32, batch.num_rows,
        )
        raw, offsets = flat(batch["text"])
        starts, ends, words = word_spans(raw, offsets, TERM_BREAK)
        if not len(starts):
            return
        lengths = ends - starts
        row = np.repeat(np.arange(batch.num_rows, dtype=np.uint32), np.diff(words))
        # the next power of two, 8 at least: the length classes
        width = np.maximum(WORD_BYTES, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        width[width < lengths] *= 2
        data = np.concatenate([FOLD[raw], np.zeros(int(width.max()), np.uint8)])
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            bucket = self.buckets.setdefault(int(w), _Bucket(int(w)))
            bucket.count(bucket.keys(data, starts[mine], lengths[mine]), code[row[mine]], row[mine])

    def shrink(self) -> bool:
        """Merge when too much is held; True if it is still too much."""
        if sum(b.held for b in self.buckets.values()) <= HELD_BYTES:
            return False
        for bucket in self.buckets.values():
            bucket.merge()
        return sum(b.held for b in self.buckets.values()) > HELD_BYTES // 2

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The counts, and a row without a term for each group met."""
        if not self.groups:
            return
        names = [pa.array(k, pa.string()) for k in zip(*self.groups)]
        zero = pa.array(np.zeros(len(self.groups), np.int64))
        columns = ["lang", "source", "term", "n", "docs"]
        yield pa.record_batch([*names, pa.nulls(len(self.groups), pa.string()), zero, zero], columns)
        for bucket in self.buckets.values():
            terms, group, n, docs = bucket.terms()
            group = pa.array(group.astype(np.int64))
            yield pa.record_batch([names[0].take(group), names[1].take(group), terms, pa.array(n), pa.array(docs)], columns)
        self.buckets, self.groups = {}, {}


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for piece in chunks(batch, "text"):
            tally.add(piece)
            if tally.shrink():
                yield from tally.flush()
    yield from tally.flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in
    each group; a row without a term per group. Rows of one key may repeat, from
    different tasks."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(_count, COUNT_SCHEMA)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, total, lead): the terms of at least ``min_docs``
    documents of their language; total is the term's count in the language, lead
    marks one row of each term. Rows without a term stay, one per group."""
    # dealt by (lang, term) once: the fold per source and the sums per term need no other shuffle
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = (
        each.withColumn("total", F.sum("n").over(term))
        .withColumn("term_docs", F.sum("docs").over(term))
        .withColumn("lead", F.row_number().over(term.orderBy("source")) == 1)
    )
    return marked.filter(F.col("term").isNull() | (F.col("term_docs") >= min_docs)).select("lang", "term", "source", "n", "total", "lead")


def group_sizes(kept: DataFrame) -> DataFrame:
    """(lang, source, sid, total, terms, lang_total, vocabulary): per group the
    count of its kept terms (N), their number and a number of the source within
    its language; per language the same N and V."""
    real = F.col("term").isNotNull()
    sizes = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count_if(real).alias("terms"), F.count_if(real & F.col("lead")).alias("led")
    )
    lang = Window.partitionBy("lang")
    return sizes.select(
        "lang", "source", F.row_number().over(lang.orderBy("source")).alias("sid"), "total", "terms",
        F.sum("total").over(lang).alias("lang_total"), F.sum("led").over(lang).alias("vocabulary"),
    )


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + vocabulary)), exact."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, (total + vocabulary).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


@tidy
def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, term), the first of each term marked; sums per
    (lang, source, other) over the task's terms."""
    sums: dict[tuple[str, int, int], int] = {}

    def fold(batch: pa.RecordBatch) -> None:
        begin = np.flatnonzero(batch["lead"].to_numpy(zero_copy_only=False))
        size = np.diff(begin, append=batch.num_rows)
        sid, p, rest = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sid", "p", "rest"))
        langs = batch["lang"].dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for k in np.unique(size[size > 1]):
            first = begin[size == k]
            # blocks of terms, or of the sources of one term
            terms, sources = max(1, STEP_CELLS // int(k * k)), max(1, min(int(k), STEP_CELLS // int(k)))
            for i in range(0, len(first), terms):
                at = first[i : i + terms, None] + np.arange(k)
                for j in range(0, int(k), sources):
                    some = at[:, j : j + sources]
                    value = _cross(p[some], rest[some], p[at], rest[at])
                    code = np.stack(np.broadcast_arrays(lang[at][:, :1, None], sid[some][:, :, None], sid[at][:, None, :]), -1).reshape(-1, 3)
                    packed_code = (code[:, 0] << 48) | (code[:, 1] << 24) | code[:, 2]
                    keys, where = np.unique(packed_code, return_inverse=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, where, value.reshape(-1))
                    for key, v in zip(keys.tolist(), total.tolist()):
                        a, b = (key >> 24) & 0xFFFFFF, key & 0xFFFFFF
                        if a != b:
                            name = (langs.dictionary[key >> 48].as_py(), a, b)
                            sums[name] = sums.get(name, 0) + v

    def drain() -> pa.RecordBatch:
        langs, a, b = zip(*sums)
        out = pa.record_batch([pa.array(langs, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "value"])
        sums.clear()
        return out

    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.concat_batches([held, batch])
        lead = np.flatnonzero(batch["lead"].to_numpy(zero_copy_only=False))
        if not len(lead):
            held = batch
            continue
        # the last term may go on in the next batch
        fold(batch.slice(0, int(lead[-1])))
        held = batch.slice(int(lead[-1]))
        if len(sums) > STEP_CELLS:
            yield drain()
    if held is not None:
        fold(held)
    if sums:
        yield drain()


def _cross(p: np.ndarray, p_rest: np.ndarray, q: np.ndarray, q_rest: np.ndarray) -> np.ndarray:
    """Divergence of terms that both sources have, less what the other parts
    count for them: (terms, sources, others)."""
    def d(a, b):
        a, b = a[:, :, None], b[:, None, :]
        return (a - b) ** 2 // b

    return d(p, q) - d(p, q_rest) - d(p_rest, q) + d(p_rest, q_rest)


def pair_rows(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources."""
    share_of = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    rest = F.when(F.col("vocabulary") > 0, share(F.lit(0), F.col("total"), F.col("vocabulary")))
    one = groups.select("lang", F.col("sid").alias("a"), F.col("source"), F.col("terms").alias("a_terms"), rest.alias("a_rest"), "vocabulary")
    two = groups.select("lang", F.col("sid").alias("b"), F.col("source").alias("item"), F.col("terms").alias("b_terms"), rest.alias("b_rest"))
    pairs = one.join(two, "lang").filter("a <> b")
    absent = F.when(F.col("vocabulary") > 0, (F.col("vocabulary") - F.col("a_terms") - F.col("b_terms")) * divergence(F.col("a_rest"), F.col("b_rest")))
    base = pairs.select("lang", "a", "b", F.coalesce(absent, F.lit(0)).alias("value"))

    real = kept.filter(F.col("term").isNotNull())
    histogram = real.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k"))
    bars = histogram.join(groups, ["lang", "source"]).select("lang", F.col("sid").alias("x"), "k", share_of.alias("p"))
    others = two.select("lang", F.col("b").alias("y"), F.col("b_rest").alias("rest"))
    met = bars.join(others, "lang").filter("x <> y")
    p, r = F.col("p"), F.col("rest")
    sides = F.explode(F.array(
        F.struct(F.col("x").alias("a"), F.col("y").alias("b"), (F.col("k") * divergence(p, r)).alias("value")),
        F.struct(F.col("y").alias("a"), F.col("x").alias("b"), (F.col("k") * divergence(r, p)).alias("value")),
    )).alias("s")
    alone = met.select("lang", sides).select("lang", "s.*")

    postings = real.drop("total").join(groups.drop("terms"), ["lang", "source"]).select("lang", "term", "source", "lead", "sid", share_of.alias("p"), rest.alias("rest"))
    dealt = postings.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = dealt.select("lang", "lead", "sid", "p", "rest").mapInArrow(_corrections, "lang string, a int, b int, value long")

    total = base.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "sid", "source")
    named = total.join(names.withColumnRenamed("sid", "a"), ["lang", "a"])
    return named.join(names.select("lang", F.col("sid").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", "item", "value")


def term_rows(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms a group uses more than its language."""
    sized = kept.filter("term IS NOT NULL AND n > 0").withColumnRenamed("total", "term_total").join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = share(F.col("term_total"), F.col("lang_total"), F.col("vocabulary"))
    both = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    return both.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank); ``top_terms`` ranks of the terms
    are listed, all of the pairs."""
    kept = stored(kept_terms(term_counts(docs), min_docs), "divergence-kept")
    groups = stored(group_sizes(kept), "divergence-groups")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", ranked]
    pairs = pair_rows(kept, groups).withColumn("part", F.lit("pair")).select(*columns)
    terms = term_rows(kept, groups).withColumn("part", F.lit("term")).select(*columns).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


def oracle_sql(min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> str:
    """The same in DuckDB, with a row for every (source, kept term)."""
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (
  SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
dense AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + s.v) AS p
  FROM sizes s JOIN kept k ON s.lang = k.lang LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
whole AS (
  SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.c + 1)) // (z.n + z.v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term) t
  JOIN (SELECT lang, sum(n) AS n, max(v) AS v FROM sizes GROUP BY lang) z ON t.lang = z.lang),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
terms AS (
  SELECT d.lang, d.source, 'term' AS part, d.term AS item, ((d.p - w.q) * (d.p - w.q)) // w.q AS value
  FROM dense d JOIN whole w ON d.lang = w.lang AND d.term = w.term WHERE d.c > 0 AND d.p > w.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top_terms}
"""
