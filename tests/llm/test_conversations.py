"""Conversation repair against enumerated edits and a whole-table parse."""

import hashlib
import itertools
import re
import zlib

import pytest

from llm_fixtures import lspark  # noqa: F401

from folio.llm import conversation_repair as CR

WANTED = re.compile(r"(s?(ua)+)?")


def enumerate_best(kinds, inserts=4):
    """All edit sequences with up to ``inserts`` insertions."""
    n, found = len(kinds), []
    for slots in itertools.product(range(3), repeat=n + 1):
        if sum(slots) > inserts:
            continue
        for edits in itertools.product("KRD", repeat=n):
            cost, ok, options, audit = 3 * sum(slots), True, [[]], ""
            for i in range(n + 1):
                audit += "I" * slots[i]
                options = [o + ["?"] * slots[i] for o in options]
                if i == n:
                    break
                e, k = edits[i], kinds[i]
                audit += e
                if e == "D":
                    cost += 4
                    continue
                if k == "d":
                    ok = False
                    break
                cost += 3 * k.isupper() + 3 * (e == "R")
                options = [o + [k.lower() if e == "K" else "?"] for o in options]
            if ok and fits(options[0]):
                found.append((cost, audit))
    return min(found)


def fits(roles):
    """'?' stands for user or assistant."""
    if not roles:
        return True
    rest = roles[1:] if roles[0] == "s" else roles
    return bool(rest) and len(rest) % 2 == 0 and all(r in ("?", "ua"[i % 2]) for i, r in enumerate(rest))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_cheapest_edits_enumerated(n):
    for kinds in itertools.product("suaxSUAd", repeat=n):
        assert CR.best(CR.span_cell("".join(kinds))) == enumerate_best(kinds), kinds


def test_every_cut_gives_the_same_cell():
    import random

    rng = random.Random(4)
    for _ in range(60):
        kinds = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(2, 12)))
        table = {(i, i + 1): CR.row_cell(k) for i, k in enumerate(kinds)}
        for length in range(2, len(kinds) + 1):
            for i in range(len(kinds) - length + 1):
                cells = [CR.combined(table[i, c], table[c, i + length]) for c in range(i + 1, i + length)]
                assert all(c == cells[0] for c in cells)
                table[i, i + length] = cells[0]
        assert table[0, len(kinds)] == CR.span_cell(kinds)


def brute(rows):
    """Plain Python over (conv_id, turn, role, text) rows, whole-table parse."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            d = zlib.crc32(key.encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            role = "user" if d == 4 else role
            mine += [(turn, role, text)] * (2 if d == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        blank = dup = cut = illegal = 0
        kinds, seen = "", set()
        for i, (_, role, text) in enumerate(mine):
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            body = text.strip(" \t\n\v\f\r")
            if not body:
                blank, kind = blank + 1, "d"
            elif (role, text) in seen:
                dup, kind = dup + 1, "d"
            elif body[-1] not in ".!?":
                cut, kind = cut + 1, kind.upper()
            seen.add((role, text))
            kinds += kind
            if i and (mine[i - 1][1][:1] + role[:1]) not in ("su", "ua", "au"):
                illegal += 1
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = parse(kinds)
        fixed, rest = [], iter(mine)
        for e in audit:
            role, text = ("", "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            if e in "RI":
                role = "assistant" if fixed and fixed[-1][0][0] == "u" else "user"
            fixed.append((role, text))
        assert WANTED.fullmatch("".join(r[0] for r, _ in fixed)), (kinds, audit)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, blank, dup, cut, illegal, cost, audit, sha)
    return out


def parse(kinds):
    """Row by row over the four states, insertions relaxed to a fixed point."""
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def relax(best):
        for _ in range(4):
            for role in "ua":
                for p, q in steps[role].items():
                    if p in best:
                        way = (best[p][0] + 3, best[p][1] + "I")
                        if q not in best or way < best[q]:
                            best[q] = way
        return best

    best = relax({0: (0, "")})
    for k in kinds:
        new = {}
        for p, (cost, audit) in best.items():
            ways = [(p, cost + 4, "D")]
            if k != "d":
                extra = 3 * k.isupper()
                ways += [(q, cost + extra, "K") for pp, q in steps.get(k.lower(), {}).items() if pp == p]
                ways += [(q, cost + 3 + extra, "R") for r in "ua" for pp, q in steps[r].items() if pp == p]
            for q, c, e in ways:
                if q not in new or (c, audit + e) < new[q]:
                    new[q] = (c, audit + e)
        best = relax(new)
    return min(best[q] for q in (0, 3) if q in best)


SCHEMA = "conv_id long, turn long, role string, text string, copy int, live string, met int, fault string"


def made_rows():
    import random

    rng = random.Random(9)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "cut off", " \n", "", None, "Why?", "é漢.", "tail . \t", "x"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]) if rng.random() < 0.3 else turn, role, text))
    rows += [(1000, 1, "user", "a."), (1000, 1, "user", "a."), (1000, 1, "assistant", "a."), (1001, -5, "user", "long " * 50_000)]
    only_dropped = next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((only_dropped, 0, "user", "gone."))
    return rows, only_dropped


def collected(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("span", [4096, 3])
def test_brute_force(lspark, monkeypatch, span):
    rows, only_dropped = made_rows()
    df = lspark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(5)
    if span == 3:  # spans in the driver's process: the same stream of rows, cut short
        monkeypatch.setattr(CR, "SPAN_ROWS", 3)
        from pyspark.sql import functions as F

        plan = CR.with_faults(CR.damaged(df)).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "met")
        batches = plan.coalesce(1).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "met").select(
            "conv_id", "live", "turn", "role", "text", "fault").toArrow().to_batches(max_chunksize=50)
        import pyarrow as pa

        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
        got = {r["conv_id"]: tuple(r.values())[1:] for b in CR._parser(schema)(iter(batches)) for r in b.to_pylist()}
    else:
        got = collected(CR.repaired(df))
    assert got == brute(rows)
    assert got[only_dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation(lspark):
    """Many spans of one conversation; a digest carried over all of them."""
    rows = [(7, t, "user" if t % 3 else "assistant", f"turn {t}." if t % 7 else "cut") for t in range(12_000)]
    df = lspark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert collected(CR.repaired(df)) == brute(rows)


def test_empty(lspark):
    assert CR.repaired(lspark.createDataFrame([], SCHEMA)).collect() == []


def test_query(lspark):
    from folio.llm.queries import QUERIES, table

    rows = [tuple(r) for r in table(lspark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op13_conversation_repair"](lspark, "/root/testdata/sf0.001")) == brute(rows)
