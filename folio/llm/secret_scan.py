"""Secret scans with one combined deterministic automaton.

All rules are compiled into one minimal automaton that reads every byte of a
text once (``automaton.Scanner``). Bytes after which every state is the start
state (the newline among them) delimit stretches that no match crosses; only
stretches in which the automaton accepted a rule are looked at again, by that
rule's own automaton, for the leftmost, longest, non-overlapping spans.

Fixed values: the base kinds assign, access and hex with their expressions and
least lengths. The method adds slack (bot and app tokens) and private_key (key
block headers).

Edge cases: null reads as empty and holds nothing; spans count code points, end
exclusive; rows repeating a doc_id are scanned each; a null doc_id is carried;
``redact`` keeps all columns, ``secret_digest`` reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm import arrowtext as A
from folio.llm.automaton import Scanner, anchored, longest

VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORDS = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"


@dataclass(frozen=True)
class Rule:
    kind: str
    expression: str  # whole match, as the leftmost longest span
    least: str  # a shortest match that counts
    minimum: int  # least length of the value (assign) or the match
    fold: bool = False


RULES = (
    Rule("assign", KEYWORDS + VALUE + "+", KEYWORDS + VALUE + "{8}", 8, True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12}", 16),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32}", 32),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]+", "xox[abprs]-[0-9A-Za-z-]{10}", 15),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
BASE = 3


def _value_length(match: bytes) -> int:
    """Length of the value of an assignment: what follows the separator, its
    spaces and an opening quote."""
    value = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value)


class SecretScanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.scanner = Scanner([(r.least, r.fold) for r in rules])
        self.resets = self.scanner.automaton.resets()
        if not self.resets[0x0A]:
            raise ValueError("a rule matches across lines")
        self.whole = [anchored(r.expression, r.fold) for r in rules]

    def _spans(self, stretch: bytes, kinds: int) -> Iterator[tuple[int, int, int]]:
        for number, (rule, automaton) in enumerate(zip(self.rules, self.whole, strict=True)):
            at = 0
            while kinds >> number & 1 and at < len(stretch):
                if stretch[at] in automaton.first and (end := longest(automaton, stretch, at)) > 0:
                    size = _value_length(stretch[at:end]) if rule.kind == "assign" else end - at
                    if size >= rule.minimum:
                        yield at, number, end
                    at = end
                else:
                    at += 1

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, rule number, end) byte spans by row, for rows with any."""
        rows = len(offsets) - 1
        if not len(data):
            return {}
        # a newline behind every row keeps rows apart
        row = np.repeat(np.arange(rows), np.diff(offsets))
        text = np.full(len(data) + rows, 0x0A, np.uint8)
        text[np.arange(len(data)) + row] = data
        begins = offsets + np.arange(rows + 1)
        states = self.scanner.states(text)
        hits = np.flatnonzero(states >= self.scanner.automaton.first_accepting)
        if not len(hits):
            return {}
        kinds = self.scanner.automaton.accepts[states[hits]]
        stops = np.flatnonzero(self.resets[text])
        stretch = np.searchsorted(stops, hits)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for part in np.unique(stretch).tolist():
            lo = int(stops[part - 1]) + 1 if part else 0
            hi = int(stops[part])
            seen = int(np.bitwise_or.reduce(kinds[stretch == part])) if len(hits) < 64 else int(np.bitwise_or.reduce(kinds[np.searchsorted(stretch, part) : np.searchsorted(stretch, part, "right")]))
            of = int(np.searchsorted(begins, lo, "right")) - 1
            shift = lo - int(begins[of])
            out.setdefault(of, []).extend((shift + a, k, shift + b) for a, k, b in self._spans(text[lo:hi].tobytes(), seen))
        return {i: sorted(s) for i, s in out.items() if s}


@lru_cache(maxsize=1)
def scanner() -> SecretScanner:
    """The worker's compiled rules, kept between tasks."""
    return SecretScanner()


def _code_points(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans)


def secret_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.chunks(batch, "text"):
                data, offsets = A.flat(part.column("text"))
                n = part.num_rows
                counts = np.zeros((BASE, n), np.int64)
                digest, text = [nothing] * n, [""] * n
                for i, found in scanner().scan(data, offsets).items():
                    spans = _code_points(data[offsets[i] : offsets[i + 1]], found)
                    base = [s for s in spans if s[1] < BASE]
                    for _, k, _ in base:
                        counts[k, i] += 1
                    digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    text[i] = _joined(spans)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digest), pa.array(text)],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(A.tidy(run), schema)


def redact(documents: DataFrame, *, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret span (overlapping ones as one) replaced."""
    kept = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index("text")
        for batch in batches:
            for part in A.chunks(batch, "text"):
                data, offsets = A.flat(part.column(at))
                found = scanner().scan(data, offsets)
                if found:
                    texts = part.column(at).to_pylist()
                    for i, spans in found.items():
                        raw, out, done = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
                        for a, _, b in spans:
                            if a >= done:
                                out += [raw[done:a], mark.encode()]
                            done = max(done, b)
                        texts[i] = b"".join([*out, raw[done:]]).decode()
                    columns = list(part.columns)
                    columns[at] = pa.array(texts, pa.string())
                    part = pa.RecordBatch.from_arrays(columns, names=kept)
                yield part

    return documents.mapInArrow(A.tidy(run), documents.schema)
