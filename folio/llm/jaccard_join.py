"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct 5-word shingles (as 64-bit hashes). Every
shingle flips one bit of the document's sketch, so the Hamming distance of two
sketches is at most the size of the symmetric difference, and J >= t bounds
that by (1-t)/(1+t) * (|A|+|B|).

Candidates. Sizes are split into bands (ratio 1.5); a document joins its own
band and, as the larger partner, the band below if it can have partners there.
A band's sketch has K blocks, more than the largest difference D of its pairs:
by the pigeonhole principle at least K-D blocks of a linked pair come from the
same shingles. A document emits its fullest blocks, at least D+1 of them and
all that hold as many shingles as the last of these; of two linked documents
the one with the higher cut-off therefore emits a block that the other emits
too. Blocks are 2**32 bits wide and almost empty, so each travels as the XOR of
one random word per set bit: blocks of different shingles stay apart however
many documents there are. Sets of up to 12 shingles instead enumerate the
sketches within their bound (at most two shingles left out).

Work per group of equal blocks is linear: each member is paired with the
group's smallest set. Verified links are joined into components; only groups
that still hold several components compare members across components, sketch
against sketch, until nothing is left unchecked. Sets of an open group of more
than ``TILE`` members are grouped anew by their rarest shingles: two linked sets
share one of the first n - ceil(0.8 n) + 1 in any common order. What is still
larger is cut in tiles, and pairs of tiles are dealt over the tasks; tiles of
one component never meet. No link between different sets is lost, and copies
(equal sets) are one node throughout.

Edge cases: a null or empty text, or one without words, has an empty set, links
with nothing and is its own component; fewer words than the width form one
shingle; rows repeating a doc_id are separate rows; a null doc_id takes part
and never names a component unless its whole component has no id (then null);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrowtext as A
from folio.llm.components import components
from folio.llm.storage import discard, stored

WIDTH = 5
#: Similarity as a fraction; links need 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
TINY = 10
SKETCH_WORDS = 16
#: Members that a task compares at once; larger groups are cut.
TILE = 1024
#: Nodes in which shingles are counted, and shingles that get a place by count.
COUNTED, ORDERED = 1 << 16, 1 << 16
U = np.uint64


def largest_partner(n: int) -> int:
    return n * DENOMINATOR // NUMERATOR


def difference_bound(total: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add up to total."""
    return total * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


@lru_cache(maxsize=None)
def band(index: int) -> tuple[int, int, int]:
    """Smallest and largest size of the smaller partner, and number of blocks."""
    low = TINY + 1 if index == 1 else band(index - 1)[1] + 1
    high = low * 3 // 2
    bound = difference_bound(high + largest_partner(high))
    return low, high, bound + 1 + int(np.ceil(2.5 * np.sqrt(bound + 1)))


@lru_cache(maxsize=4096)
def roles(n: int) -> tuple[tuple[int, int, int], ...]:
    """(band, blocks, difference bound) for each band a set of n joins."""
    out = []
    index = 1
    while n > TINY:
        low, high, blocks = band(index)
        if low <= n <= high:
            out.append((index, blocks, difference_bound(n + min(largest_partner(n), largest_partner(high)))))
            break
        if n <= largest_partner(high):
            out.append((index, blocks, difference_bound(n + high)))
        index += 1
    return tuple(out)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows (with repeats) and the range per row."""
    starts, ends, words = A.word_spans(data, offsets)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    word = A.range_keys(data, starts, ends, folded=True)
    count = np.diff(words)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    cut = np.concatenate([[0], np.cumsum(size)])
    first = A.spread(words[:-1], size)
    length = np.repeat(np.minimum(count, width), size)
    out = length.astype(U)
    for i in range(width):
        inside = length > i
        at = np.minimum(first + i, len(word) - 1)
        out = np.where(inside, A.mix64(out * U(0x9E3779B97F4A7C15) + word[at]), out)
    return out, cut


def set_identity(shingles: np.ndarray) -> int:
    """64-bit identity of a set of distinct shingle hashes, as a signed long."""
    with np.errstate(over="ignore"):
        total = A.mix64(shingles ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(shingles))
    return int(A.mix64(np.array([total], U)).view(np.int64)[0])


def block_keys(shingles: np.ndarray) -> np.ndarray:
    """Join keys of one sorted set of distinct shingle hashes."""
    n = len(shingles)
    if n == 0:
        return np.zeros(0, U)
    out = []
    if n <= largest_partner(TINY):
        tokens = A.mix64(shingles)
        whole = np.bitwise_xor.reduce(tokens)
        out.append(np.array([whole ^ np.bitwise_xor.reduce(tokens[list(c)], initial=U(0)) for d in range(n * (DENOMINATOR - NUMERATOR) // DENOMINATOR + 1) for c in combinations(range(n), d)], U))
    bit = A.mix64((shingles & U(0xFFFFFFFF)) + U(0x1234567))
    for index, blocks, bound in roles(n):
        block = (((shingles >> U(32)) * U(blocks)) >> U(32)).astype(np.int64)
        count = np.bincount(block, minlength=blocks)
        cutoff = np.partition(count, blocks - 1 - bound)[blocks - 1 - bound]
        value = np.zeros(blocks, U)
        full = np.flatnonzero(count)
        value[full] = np.bitwise_xor.reduceat(bit, np.searchsorted(block, full))
        chosen = np.flatnonzero(count >= cutoff)
        out.append(A.mix64(value[chosen] + A.mix64(chosen.astype(U) * U(1 << 20) + U(index))))
    return np.concatenate(out)


def sketch_words(n: int) -> int:
    """Words of a set's sketch: two bits per shingle at least, a power of two."""
    return max(SKETCH_WORDS, 1 << (n // 32).bit_length())


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit's number is a remainder by the width, so that a sketch of half the
    width is the XOR of the halves (``folded``)."""
    size = sketch_words(len(shingles)) * 64
    bits = np.bincount(((shingles >> U(20)) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (one a row) of a width that the smaller partner has."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _sets(part: pa.RecordBatch, name: str) -> list[np.ndarray]:
    hashes, cut = shingle_hashes(*A.flat(part.column(name)))
    return [np.unique(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def set_table(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id, n_shingles, set_id) per row; set_id null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.chunks(batch, "text"):
                sets = _sets(part, "text")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_identity(s) if len(s) else None for s in sets], pa.int64())],
                    names=["doc_id", "text_id", "n_shingles", "set_id"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(A.tidy(run), "doc_id long, text_id long, n_shingles long, set_id long")


def _keys(documents: DataFrame) -> DataFrame:
    """(key, set_id) rows, once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in A.chunks(batch, "text"):
                keys, owner = [], []
                for s in _sets(part, "text"):
                    if len(s) and (identity := set_identity(s)) not in seen:
                        seen.add(identity)
                        keys.append(block_keys(s))
                        owner.append(np.full(len(keys[-1]), identity, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))], names=["key", "set_id"])

    return documents.select("text").mapInArrow(A.tidy(run), "key long, set_id long")


def _stars(sorted_keys: DataFrame) -> DataFrame:
    """(key, a, b) for every further member b of a key whose smallest is a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_set = leader = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("set_id").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            repeat = np.zeros(len(key), bool)
            repeat[1:] = ~new[1:] & (node[1:] == node[:-1])
            new[0] = last_key is None or key[0] != last_key
            repeat[0] = not new[0] and node[0] == last_set
            run_no = np.cumsum(new)
            leaders = np.concatenate([[0 if leader is None else leader], node[new]])
            lead = leaders[run_no]
            out = ~new & ~repeat
            last_key, last_set, leader = key[-1], node[-1], lead[-1]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(lead[out]), pa.array(node[out])], names=["key", "a", "b"])

    return sorted_keys.mapInArrow(A.tidy(run), "key long, a long, b long")


def _node_details(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(set_id, n, sketch, packed text) of the given nodes, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in A.chunks(batch, "text"):
                data, offsets = A.flat(part.column("text"))
                rows = []
                for i, s in enumerate(_sets(part, "text")):
                    if len(s) and (identity := set_identity(s)) not in seen:
                        seen.add(identity)
                        rows.append((identity, len(s), parity_sketch(s), pack.compress(data[offsets[i] : offsets[i + 1]].tobytes())))
                if rows:
                    ids, sizes, sketches, texts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(list(sketches), pa.list_(pa.int64())), pa.array(texts, pa.binary())],
                        names=["set_id", "n", "sketch", "packed"])

    made = documents.select("text").mapInArrow(A.tidy(run), "set_id long, n long, sketch array<long>, packed binary")
    return made.join(nodes, "set_id", "left_semi").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("packed").alias("packed"))


def _promising(pairs: DataFrame, details: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketch distance allow a link."""
    side = lambda c: details.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    def narrow(mine: str, other: str):
        half = (F.size(mine) / 2).cast("int")
        both = F.zip_with(F.slice(mine, 1, half), F.slice(mine, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(mine) > F.size(other), both).otherwise(F.col(mine))

    # widths differ by one step at most where the sizes allow a link
    distance = F.aggregate(F.zip_with(narrow("s_a", "s_b"), narrow("s_b", "s_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x.cast("int"))
    sizes = DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b")
    return joined.filter(sizes & ((DENOMINATOR + NUMERATOR) * distance <= (DENOMINATOR - NUMERATOR) * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def _verified(pairs: DataFrame, details: DataFrame) -> DataFrame:
    """The pairs whose shingle sets, computed again from the texts, link."""
    side = lambda c: details.select(F.col("set_id").alias(c), F.col("packed").alias(f"p_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ok = np.zeros(len(a), bool)
            for lo in range(0, len(a), 64):
                some = [unpack.decompress(x.as_buffer()) for i in range(lo, min(lo + 64, len(a))) for x in (batch.column("p_a")[i], batch.column("p_b")[i])]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])])
                hashes, cut = shingle_hashes(np.frombuffer(b"".join(some), np.uint8), offsets)
                sets = [np.unique(hashes[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                for i in range(0, len(sets), 2):
                    x, y = sets[i], sets[i + 1]
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    ok[lo + i // 2] = DENOMINATOR * common >= NUMERATOR * (len(both) - common)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["u", "v"])

    return joined.mapInArrow(A.tidy(run), "u long, v long")


def prefix_length(n: int) -> int:
    """So many of the first shingles, in any order common to all sets, contain
    one that each linked set of any size has among its own first ones."""
    return n + (-NUMERATOR * n // DENOMINATOR) + 1


def _frequent(details: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count) of at most ``ORDERED`` frequent shingles of the nodes,
    sorted by shingle. They only order shingles, and any order finds every link:
    so they are counted in about ``COUNTED`` nodes, told by their hash."""
    few = max(1, nodes.count() // COUNTED)
    some = details.join(nodes.filter(F.pmod(F.xxhash64("set_id"), F.lit(few)) == 0), "set_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    counted = some.select("set_id", "packed").mapInArrow(A.tidy(run), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("count"))
    top = counted.filter("count > 1").orderBy(F.desc("count"), "shingle").limit(ORDERED).toArrow()
    shingle, count = top.column("shingle").to_numpy().view(U), top.column("count").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], count[order]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and their sets, computed again from the packed texts."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        node = batch.column("set_id").to_numpy()
        for lo in range(0, len(node), 64):
            some = [unpack.decompress(batch.column("packed")[i].as_buffer()) for i in range(lo, min(lo + 64, len(node)))]
            hashes, cut = shingle_hashes(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
            yield node[lo : lo + 64], [np.unique(hashes[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _prefixes(details: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shingle, node) of each node's first shingles, rare ones first."""
    known, count = _frequent(details, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, sets in _unpacked(batches):
            firsts = []
            for s in sets:
                often = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, count[at], 0)
                firsts.append(s[np.lexsort((s, often))[: prefix_length(len(s))]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(node, [len(f) for f in firsts]))], names=["shingle", "node"])

    return details.join(nodes, "set_id", "left_semi").select("set_id", "packed").mapInArrow(A.tidy(run), "shingle long, node long")


def _tiles(rows: DataFrame, key: str) -> DataFrame:
    """(group, side, node, component) from (key, node, component): a key of at
    most ``TILE`` members is one group with side 0. A larger one is cut in tiles
    of about that size, large components in tiles of their own and small ones
    pooled whole; a group is a pool (side 0) or two tiles (sides 1 and 2) that
    are not of one large component."""
    parts = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy(key).agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("k"), F.sum(F.when(2 * F.col("c") <= TILE, F.col("c")).otherwise(0)).alias("pooled")).filter("k > 1")
    small = rows.join(sizes.filter(F.col("m") <= TILE).select(key), key)
    small = small.select(F.xxhash64(key).alias("group"), F.lit(0).alias("side"), "node", "component")
    wide = sizes.filter(F.col("m") > TILE).select(key, F.ceil(F.col("pooled") / TILE).alias("pools"))
    big = parts.filter(2 * F.col("c") > TILE).withColumn("own", F.ceil(F.col("c") / TILE))
    # as many rows per key as it has tiles, at most
    listed = big.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("component", "own"))).alias("bigs"))
    total = F.aggregate("bigs", F.lit(0).cast("long"), lambda acc, x: acc + x["own"])
    wide = wide.join(listed, key, "left").withColumn("bigs", F.coalesce("bigs", F.expr("array()").cast("array<struct<component:bigint,own:bigint>>"))).withColumn("tiles", F.col("pools") + total)
    begins = wide.select(key, "pools", F.posexplode("bigs").alias("at", "big"), "bigs").select(
        key, F.col("big.component").alias("component"), F.col("big.own").alias("own"),
        (F.col("pools") + F.aggregate(F.slice("bigs", 1, F.col("at")), F.lit(0).cast("long"), lambda acc, x: acc + x["own"])).alias("begin"))
    placed = rows.join(wide.select(key, "pools", "tiles"), key).join(begins, [key, "component"], "left")
    mine = F.when(F.col("begin").isNull(), F.pmod(F.xxhash64("component"), "pools")).otherwise(F.col("begin") + F.pmod(F.xxhash64("node"), "own"))
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    placed = placed.filter("begin IS NULL OR other < begin OR other >= begin + own")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return small.union(placed.select(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), side.alias("side"), "node", "component"))


def _open_groups(stars: DataFrame, comps: DataFrame, details: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(group, side, node, component), and the stored tables it reads: every pair of linked sets that no star
    compared and that lie in different components meets in a group, with side 0
    or on its two sides. Keys of up to ``TILE`` members are groups; the sets of
    larger ones are grouped by their rarest shingles instead (prefix filter)."""
    # the star's centre was compared with all others
    placed = stars.select("key", F.col("b").alias("node")).join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi")
    open_ = stored(placed.join(keys.select("key", "m"), "key").select("key", "node", "component", "m"), "jaccard-open")
    rows = _tiles(open_.filter(F.col("m") <= TILE), "key")
    large = open_.filter(F.col("m") > TILE).select("node", "component").distinct()
    if large.isEmpty():
        return rows, [open_]
    large = stored(large, "jaccard-large")
    shingles = stored(_prefixes(details, large.select(F.col("node").alias("set_id"))), "jaccard-prefixes")
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("shingle")
    meet = stored(shingles.join(shared, "shingle").join(large, "node").select("shingle", "node", "component"), "jaccard-shared")
    discard(shingles, large)
    return rows.union(_tiles(meet, "shingle")), [open_, meet]


class _Group:
    """Members of one group of a task: sets that are to be compared."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.group, self.side, self.node, self.component, self.n = (rows[c].to_numpy() for c in ("group", "side", "node", "component", "n"))
        self.packed = rows["packed"] if "packed" in rows.column_names else None
        sketch = rows["sketch"].chunk(0) if rows["sketch"].num_chunks else pa.array([], pa.list_(pa.int64()))
        values, ends = sketch.flatten().to_numpy().view(U), np.cumsum(sketch.value_lengths().to_numpy())
        width = np.diff(ends, prepend=0)
        #: sketch width -> (members, their sketches)
        self.classes = {}
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            self.classes[w] = of, values[(ends[of] - w)[:, None] + np.arange(w)]

    def near(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members (x, y) of different labels whose sizes and sketches allow a
        link, in blocks. Labels may change between blocks."""
        two_sides = bool(self.side.any())
        for w, (rows, sketch) in self.classes.items():
            for v in (w, 2 * w):  # linked sets' sketches are at most twice as wide
                if v not in self.classes:
                    continue
                others, wide = self.classes[v]
                wide = folded(wide, w)
                for lo in range(0, len(rows), 128):
                    for at in range(0, len(others), 8192):
                        a, b = rows[lo : lo + 128], others[at : at + 8192]
                        n, m = self.n[a][:, None], self.n[b][None, :]
                        ok = (label[a][:, None] != label[b][None, :]) & (DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m))
                        if two_sides:
                            ok &= self.side[a][:, None] != self.side[b][None, :]
                        if v == w:
                            ok &= a[:, None] < b[None, :]
                        x, y = np.nonzero(ok)
                        step = max(1, (1 << 20) // w)
                        for s in range(0, len(x), step):
                            p, q = x[s : s + step], y[s : s + step]
                            far = np.bitwise_count(sketch[lo + p] ^ wide[at + q]).sum(axis=1)
                            some = (DENOMINATOR + NUMERATOR) * far <= (DENOMINATOR - NUMERATOR) * (n[p, 0] + m[0, q])
                            if some.any():
                                yield a[p[some]], b[q[some]]


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[_Group]:
    """The groups of a task's rows, which are sorted by group."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if held and held[0]["group"][0].as_py() != group[a]:
                yield _Group(pa.concat_tables(held))
                held = []
            held.append(part)
    if held:
        yield _Group(pa.concat_tables(held))


class _Shingles:
    """Sets of a group's members, unpacked when asked for; the last ones stay."""

    def __init__(self, packed: pa.ChunkedArray, limit: int = 64 << 20):
        self.packed, self.limit, self.size = packed, limit, 0
        self.unpack, self.sets = zstandard.ZstdDecompressor(), {}

    def of(self, i: int) -> np.ndarray:
        if i not in self.sets:
            text = self.unpack.decompress(self.packed[i].as_buffer())
            hashes, _ = shingle_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            if self.size > self.limit:
                self.sets, self.size = {}, 0
            self.sets[i] = np.unique(hashes)
            self.size += self.sets[i].nbytes
        return self.sets[i]

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        mine, theirs = self.of(i), [self.of(j) for j in others.tolist()]
        size = np.array([len(t) for t in theirs])
        every = np.concatenate(theirs)
        at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        common = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(size) - size)
        return DENOMINATOR * common >= NUMERATOR * (len(mine) + size - common)


def _joining(group: _Group) -> list[tuple[int, int]]:
    """Verified links that join two components of the group, one less than its
    components at most."""
    label, sets, out = group.component.copy(), _Shingles(group.packed), []
    for x, y in group.near(label):
        for i in np.unique(x).tolist():
            rest = y[x == i]
            while len(rest := rest[label[rest] != label[i]]):
                some, rest = rest[:32], rest[32:]
                for j in some[sets.linked(i, some)].tolist():
                    if label[i] != label[j]:
                        out.append((int(group.node[i]), int(group.node[j])))
                        label[label == label[j]] = label[i]
    return out


def _across(stars: DataFrame, comps: DataFrame, details: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Verified links (u, v) between a key's members in different components that
    no star compared; and the stored tables read. A first pass over sketches finds
    the members with a possible partner in their group; a second one verifies these
    by their texts and hands on only the links that join two components of the
    group, so both give at most a row per member."""
    groups, tables = _open_groups(stars, comps, details)
    rows = groups.join(details.select(F.col("set_id").alias("node"), "n", "sketch"), "node")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups_of(batches):
            near = np.zeros(len(group.node), bool)
            for x, y in group.near(group.component):
                near[x] = near[y] = True
            if near.any():
                columns = (group.group, group.side, group.node, group.component)
                yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in columns], names=["group", "side", "node", "component"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups_of(batches):
            if found := _joining(group):
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("group").sortWithinPartitions("group", "node")

    sketched = dealt(rows).select("group", "side", "node", "component", "n", "sketch")
    members = stored(sketched.mapInArrow(A.tidy(candidates), "group long, side int, node long, component long"), "jaccard-candidates")
    texts = members.join(details.withColumnRenamed("set_id", "node"), "node")
    verified = dealt(texts).select("group", "side", "node", "component", "n", "sketch", "packed").mapInArrow(A.tidy(join), "u long, v long")
    return verified.distinct(), [*tables, members]


def links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the sets with a link to a different set, and the
    verified links (u, v) that connect them; nodes are set ids."""
    stars = stored(_stars(_keys(documents).repartition("key").sortWithinPartitions("key", "set_id")), "jaccard-stars")
    pairs = stars.select("a", "b").distinct()
    nodes = stars.select(F.col("a").alias("set_id")).union(stars.select(F.col("b").alias("set_id"))).distinct()
    details = stored(_node_details(documents, nodes), "jaccard-nodes")
    edges = stored(_verified(_promising(pairs, details), details), "jaccard-links")
    found = components(edges, "jaccard-components")
    apart, tables = _across(stars, found, details)
    more = stored(apart, "jaccard-links")
    discard(stars, details, *tables)
    if not more.isEmpty():
        # the second round only joins components of the first
        both = stored(edges.union(more), "jaccard-links")
        discard(edges, found)
        edges, found = both, components(both, "jaccard-components")
    discard(more)
    return found, edges


def _grouped_sets(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set table, and per set (set_id, first, __group): its smallest doc_id
    and the component it lies in."""
    sets = stored(set_table(documents), "jaccard-sets")
    linked, _ = links(documents)
    # name the components from one row per set, so that copies meet no task twice
    each = sets.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    placed = each.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left")
    return sets, placed.select("set_id", "first", F.coalesce("component", "set_id").alias("__group"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``documents`` (doc_id, text)."""
    sets, placed = _grouped_sets(documents)
    lowest = placed.groupBy("__group").agg(F.min("first").alias("component_id"))
    names = stored(placed.join(lowest, "__group").select("set_id", "component_id"), "jaccard-names")
    named = sets.filter("set_id IS NOT NULL").join(names, "set_id", "left").select("doc_id", "n_shingles", "component_id")
    return named.union(sets.filter("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_per_group(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` per component: the smallest doc_id's, a row
    without an id only where none of its component has one, of rows with the same
    id and text any one. Rows with an empty set stay."""
    sets, placed = _grouped_sets(documents)
    # a row is told by its id and text: rows repeating an id may differ in text
    kinds = sets.filter("set_id IS NOT NULL").groupBy("doc_id", "text_id").agg(F.first("set_id").alias("set_id"), F.count(F.lit(1)).alias("rows"))
    # (component, keeper) from one row per set, so that copies meet no task twice
    first = lambda *c: F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *c)).alias("keeper")
    best = kinds.groupBy("set_id").agg(first("doc_id", "text_id"))
    lowest = placed.join(best, "set_id").groupBy("__group").agg(F.min("keeper").alias("keeper"))
    keeper = placed.join(lowest, "__group").select("set_id", F.col("keeper.doc_id").alias("__doc"), F.col("keeper.text_id").alias("__text"))
    judged = stored(kinds.join(keeper, "set_id").select(
        F.col("doc_id").alias("__id"), F.col("text_id").alias("__text_id"), "rows",
        (F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_id") == F.col("__text"))).alias("keeps")), "jaccard-kinds")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text_id"))
    stay = documents.join(judged.filter("NOT keeps"), same, "left_anti")
    several = judged.filter("keeps AND rows > 1")
    if several.isEmpty():
        return stay
    once = stay.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(several, same, "left_anti").union(once)
