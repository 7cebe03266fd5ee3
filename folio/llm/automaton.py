"""One minimal deterministic automaton for several regular expressions.

Expressions (literals, classes, groups, alternation, repeats) become one
nondeterministic automaton; subset construction and partition refinement turn it
into a transition array over byte classes. ``Scanner`` runs all rules over a
buffer in one pass: lanes of equal length advance together, a byte per step,
each assuming the start state; lanes that were entered in another state are
run again from it until they meet the assumed course.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

import numpy as np

LANE = 256


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, fold: bool) -> int:
        """Append a parsed expression after ``start``; returns its end state."""
        for op, arg in tree:
            if op is C.LITERAL or op is C.IN or op is C.NOT_LITERAL:
                end = self.state()
                self.moves[start].append((_bytes(op, arg, fold), end))
                start = end
            elif op is C.SUBPATTERN:
                start = self.add(arg[3], start, fold)
            elif op is C.BRANCH:
                end = self.state()
                for option in arg[1]:
                    self.empty[self.add(option, start, fold)].append(end)
                start = end
            elif op in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = arg
                for _ in range(low):
                    start = self.add(inner, start, fold)
                if high is C.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.empty[start].append(loop)
                    self.empty[loop].append(end)
                    self.empty[self.add(inner, loop, fold)].append(loop)
                    start = end
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[start].append(end)
                        start = self.add(inner, start, fold)
                    self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return start


def _bytes(op, arg, fold: bool) -> frozenset:
    if op is C.LITERAL:
        out = {arg}
    elif op is C.NOT_LITERAL:
        return frozenset(range(256)) - _bytes(C.LITERAL, arg, fold)
    else:
        out, negate = set(), False
        for kind, value in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                out.add(value)
            elif kind is C.RANGE:
                out.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {kind}")
        if negate:
            return frozenset(range(256)) - frozenset(out)
    if fold:
        out |= {ord(chr(b).swapcase()) for b in out if chr(b).isascii() and chr(b).isalpha()}
    if max(out, default=0) > 127:
        raise ValueError("rules are over ASCII bytes")
    return frozenset(out)


class Automaton:
    """``table[state, class]`` with the start state 0; ``accepts[state]`` holds a
    bit per rule. ``search``: matches may start anywhere."""

    def __init__(self, rules: list[tuple[str, bool]], search: bool):
        nfa = _Nfa()
        start = nfa.state()
        finals = {}
        for number, (expression, fold) in enumerate(rules):
            finals[nfa.add(parser.parse(expression), start, fold)] = number
        sets = {s for moves in nfa.moves for s, _ in moves}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.byte_class = np.array([kinds[s] for s in signature], np.uint8)
        samples = [int(np.flatnonzero(self.byte_class == k)[0]) for k in range(len(kinds))]

        def closure(states) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        first = closure([start])
        number, order, rows = {first: 0}, [first], []
        for states in order:
            row = []
            for byte in samples:
                target = closure({t for s in states for allowed, t in nfa.moves[s] if byte in allowed} | ({start} if search else set()))
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            rows.append(row)
        accepts = [sum(1 << finals[s] for s in states if s in finals) for states in order]
        self._minimise(np.array(rows), np.array(accepts, np.int64))
        if not search:
            # the state without any way on
            dead = [i for i, row in enumerate(self.table) if (row == i).all() and not self.accepts[i]]
            self.dead = dead[0] if dead else -1

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Merge states that no input tells apart (partition refinement)."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        # the start first, accepting states last
        some = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
        rank = np.lexsort((np.arange(len(some)), np.arange(len(some)) != block[0], accepts[some] != 0))
        place = np.empty(len(some), np.int64)
        place[rank] = np.arange(len(some))
        self.table = place[block[table[some[rank]]]].astype(np.uint16)
        self.accepts = accepts[some[rank]]
        self.first_accepting = int((self.accepts == 0).sum())

    def resets(self) -> np.ndarray:
        """Bytes that lead to the start state from every state."""
        return (self.table == 0).all(axis=0)[self.byte_class]


class Scanner:
    def __init__(self, rules: list[tuple[str, bool]]):
        self.automaton = Automaton(rules, search=True)
        self.flat = self.automaton.table.reshape(-1)
        self.classes = np.uint32(self.automaton.table.shape[1])

    def _step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return self.flat[state * self.classes + kind]

    def states(self, data: np.ndarray) -> np.ndarray:
        """State after every byte, starting in state 0."""
        n = len(data)
        lanes = max(1, -(-n // LANE))
        padded = np.zeros(lanes * LANE, np.uint8)
        padded[:n] = self.automaton.byte_class[data]
        kind = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        course = np.empty((LANE, lanes), np.uint16)
        state = np.zeros(lanes, np.uint16)
        for i in range(LANE):
            state = self._step(state, kind[i])
            course[i] = state
        # lanes entered in another state than assumed
        todo = np.flatnonzero(course[-1, :-1]) + 1
        entry = course[-1, todo - 1]
        while len(todo):
            lane, now, moved = todo, entry, []
            for i in range(LANE):
                now = self._step(now, kind[i, lane])
                go = now != course[i, lane]
                lane, now = lane[go], now[go]
                if not len(lane):
                    break
                course[i, lane] = now
            else:
                moved = lane[lane + 1 < lanes]
            todo = np.asarray(moved, np.int64) + 1 if len(moved) else np.zeros(0, np.int64)
            entry = course[-1, todo - 1]
        return course.T.reshape(-1)[:n]


def longest(automaton: Automaton, data: bytes, start: int) -> int:
    """End of the longest match that begins at ``start``, or -1."""
    table, kinds, accepts, dead = automaton.rows, automaton.kinds, automaton.accepting, automaton.dead
    state, end = 0, -1
    for at in range(start, len(data)):
        state = table[state][kinds[data[at]]]
        if state == dead:
            break
        if accepts[state]:
            end = at + 1
    return end


def anchored(expression: str, fold: bool) -> Automaton:
    """Automaton of one rule with plain lists for byte-wise walks."""
    out = Automaton([(expression, fold)], search=False)
    out.rows, out.kinds, out.accepting = out.table.tolist(), out.byte_class.tolist(), (out.accepts != 0).tolist()
    out.first = frozenset(b for b in range(256) if out.rows[0][out.kinds[b]] != out.dead)
    return out
