"""Conversation structure repair by weighted interval parsing.

A conversation should run system?, (user, assistant)+. What keeps it from that
(blank, repeated, cut-off turns, turns out of order) is mended by edits of least
cost: keep a row, give it another role, delete it, or insert an empty turn.

The repair grammar is in Chomsky normal form. Its nonterminals N(p, q) derive the
spans whose repaired roles lead from state p to state q of the wanted sequence
(start, after system, after user, after assistant):

    N(p, q) -> N(p, r) N(r, q)              for all states r
    N(p, q) -> row                          keep, re-role or delete, with its cost
    N(p, q) -> (nothing)                    the cheapest insertions from p to q

and the empty rules are closed over: a cell of one row already holds the
insertions before and after it. The cell of a span has for each N(p, q) the
minimum of (cost, audit), the audit being the edits' initials. Cells are combined
bottom-up by span length. Two audits of equal cost for one span cannot be
prefixes of each other (the longer would have extra, paid insertions), so the
least audit of two halves is the concatenation of their least audits; and every
derivation of a span can be cut at any of its rows, so one cut per span gives the
same minimum as all cuts, and spans of 1, 2, 4, ... rows suffice. The result is
the least cell N(start, start) or N(start, after assistant) of all rows.

On Spark, rows are damaged and their faults found by DataFrame functions, dealt
by conversation and sorted; a task then streams through them. Rows with equal
fault and role class have equal cells, so cells of short spans are kept and
reused. Conversations are parsed in spans of at most ``SPAN_ROWS`` rows or
``SPAN_BYTES``: of a longer one only the cells so far, from the start to each
state, and their digests are held, never its texts. (A digest runs over the whole
repaired conversation in order, so one conversation is one task's stream; its
audit, one character a row, is held as the result's own value.)

Defined cases: null conversation ids form one conversation; null roles, texts,
and for the damage null ids and turns, read as one space. Rows of equal turn are
taken by role, then text. Roles count by their first character (an empty role has
none and cannot be kept). Repeated rows are duplicates. A conversation all of
whose rows were dropped has zeros, an empty audit and the digest of the empty
string. An empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.arrowtext import tidy

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
DAMAGE_CLASSES = 20
SPAN_ROWS = 4096
SPAN_BYTES = 4 << 20
#: Cells of spans up to this many rows are kept for reuse.
KEPT_SPAN = 16

# Fixed value: characters that are no text.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

STATES = range(4)  # start, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = STATES
#: role initial -> {state before: state after}
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}

Cell = dict[tuple[int, int], tuple[int, str]]
OUT_SCHEMA = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _least(rules: list[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    cell: Cell = {}
    for pair, value in rules:
        if pair not in cell or value < cell[pair]:
            cell[pair] = value
    return cell


def combined(left: Cell, right: Cell) -> Cell:
    """N(p, q) -> N(p, r) N(r, q): the cell of two adjacent spans."""
    cell: Cell = {}
    for p in STATES:
        for q in STATES:
            ways = [(left[p, r], right[r, q]) for r in STATES if (p, r) in left and (r, q) in right]
            if not ways:
                continue
            cost = min(a[0] + b[0] for a, b in ways)
            cell[p, q] = (cost, min(a[1] + b[1] for a, b in ways if a[0] + b[0] == cost))
    return cell


def _insertions() -> Cell:
    """Closure of the empty rules: the cheapest insertions from state to state."""
    once = _least([((p, p), (0, "")) for p in STATES] + [((p, q), (INSERT, "I")) for role in "ua" for p, q in STEPS[role].items()])
    return combined(combined(once, once), once)


INSERTIONS = _insertions()


@lru_cache(None)
def row_cell(kind: str) -> Cell:
    """Cell of one row. ``kind`` is its role initial (u, a, s, else x), in upper
    case when the row is truncated, or d when it has to go."""
    rules = [((p, p), (DELETE, "D")) for p in STATES]
    if kind != "d":
        extra = TRUNCATED if kind.isupper() else 0
        rules += [(step, (extra, "K")) for step in STEPS.get(kind.lower(), {}).items()]
        rules += [(step, (REROLE + extra, "R")) for role in "ua" for step in STEPS[role].items()]
    return combined(combined(INSERTIONS, _least(rules)), INSERTIONS)


def span_cell(kinds: str) -> Cell:
    """Cell of a span of rows, its halves first."""
    if not kinds:
        return INSERTIONS
    return _kept_cell(kinds) if len(kinds) <= KEPT_SPAN else _cut(kinds)


def _cut(kinds: str) -> Cell:
    if len(kinds) == 1:
        return row_cell(kinds)
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return combined(span_cell(kinds[:half]), span_cell(kinds[half:]))


_kept_cell = lru_cache(1 << 13)(_cut)


def best(cell: Cell) -> tuple[int, str]:
    """The cheapest repair: nothing at all, or ending after an assistant."""
    return min(cell[START, q] for q in (START, ASSISTANT) if (START, q) in cell)


def applied(audit: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows, from a state on."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = STEPS[role[0]][state]
        yield role, text


class _Conversation:
    """One conversation as its rows stream by."""

    def __init__(self, key):
        self.key = key
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial = None
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[str] = []
        self.bytes = 0
        self.ways: dict[int, tuple[int, str, object, bool]] | None = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns += 1
            self.last = turn
        kind = initial if initial in STEPS else "x"
        if fault == "blank":
            self.blank += 1
            kind = "d"
        elif fault == "duplicate":
            self.duplicate += 1
            kind = "d"
        elif fault == "truncated":
            self.truncated += 1
            kind = kind.upper()
        self.rows.append((role, text))
        self.kinds.append(kind)
        self.bytes += len(text)
        if len(self.rows) >= SPAN_ROWS or self.bytes >= SPAN_BYTES:
            self.fold()

    def fold(self) -> None:
        """Combine the span held with what came before, from the start to each
        state, and carry the digests of the repaired text along."""
        cell = span_cell("".join(self.kinds))
        before = self.ways or {START: (0, "", hashlib.sha256(), True)}
        after = {}
        for q in STATES:
            ways = [(before[p][0] + cell[p, q][0], before[p][1] + cell[p, q][1], p) for p in before if (p, q) in cell]
            if ways:
                cost, audit, p = min(ways)
                digest, fresh = before[p][2].copy(), before[p][3]
                for role, text in applied(cell[p, q][1], self.rows, p):
                    digest.update(("" if fresh else "\n").encode() + f"{role}:{text}".encode())
                    fresh = False
                after[q] = (cost, audit, digest, fresh)
        self.ways, self.rows, self.kinds, self.bytes = after, [], [], 0

    def result(self) -> tuple:
        if self.ways is None:  # one span: only its best repair is spelled out
            cost, audit = best(span_cell("".join(self.kinds))) if self.kinds else (0, "")
            text = "\n".join(f"{role}:{text}" for role, text in applied(audit, self.rows, START))
            sha = hashlib.sha256(text.encode()).hexdigest()
        else:
            if self.kinds:
                self.fold()
            cost, audit, digest, _ = min((w for q, w in self.ways.items() if q in (START, ASSISTANT)), key=lambda w: w[:2])
            sha = digest.hexdigest()
        gaps = self.last - self.first + 1 - self.turns if self.first is not None else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha


def _parser(schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by conversation and place."""
        current, done = None, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "live", "turn", "role", "text", "fault")]
            for key, live, turn, role, text, fault in zip(*columns):
                if current is None or key != current.key:
                    if current is not None:
                        done.append(current.result())
                    current = _Conversation(key)
                if live:
                    current.add(turn, role, text, fault)
            if len(done) >= 1000:
                yield _rows(done, schema)
                done = []
        if current is not None:
            done.append(current.result())
        if done:
            yield _rows(done, schema)

    return run


def _rows(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, live): the rows with their planted
    damage. A dropped row stays as a mark of its conversation, with live false."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    damage = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % DAMAGE_CLASSES
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), damage.alias("damage"))
    d = F.col("damage")
    text = F.when(d <= 1, F.lit("")).when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"), (d != 0).alias("live"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault, dealt by conversation. A row repeats an
    earlier one if role and text are equal; the window runs in the deal by
    conversation, so texts are shuffled once."""
    place = [F.col("turn").asc_nulls_first(), "copy"]
    dealt = rows.repartition("conv_id")
    met = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy(*place))
    tail = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(tail == "", F.lit("blank")).when(F.col("met") > 1, F.lit("duplicate"))
        .when(~tail.isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    )
    return dealt.withColumn("met", met).withColumn("fault", fault)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the digest
    of the repaired text, of the rows as ``damaged`` leaves them."""
    rows = with_faults(damaged(conversations)).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "met")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = OUT_SCHEMA.format(id=kind)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.select("conv_id", "live", F.col("turn").cast("long").alias("turn"), "role", "text", "fault").mapInArrow(_parser(arrow), schema)
