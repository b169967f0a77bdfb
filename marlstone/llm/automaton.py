"""Several byte regexes as one deterministic automaton in transition arrays.

``compile_rules`` parses each rule, joins their position automata, determinises them together by subset construction and
merges equal states by partition refinement. The result is a table ``next[state * classes + class]``, where bytes that no
rule tells apart share a class. ``scan`` runs it over a buffer in one pass, many lanes side by side.

Pattern syntax: literals, ``\\xNN``, ``\\.`` and other escaped signs, ``[a-z]`` classes, ``( | )``, ``?``, ``*``, ``+`` and ``{m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANES = 4096


class _Parser:
    """A recursive-descent parser that adds to a Thompson automaton; each method returns (start, end)."""

    def __init__(self, pattern: str, fold_names: bool):
        self.p, self.i, self.fold = pattern, 0, fold_names
        self.eps: list[list[int]] = []
        self.arcs: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append(None)
        return len(self.eps) - 1

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.eps[start].append(a)
            self.eps[b].append(end)
            if self.peek() != "|":
                return start, end
            self.i += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.peek() not in ("", "|", ")"):
            at = self.i
            a, b = self.atom()
            stop = self.i
            low, high = self.times()
            after = self.i
            for k in range(max(low, 1 if high is None else high)):
                if k:
                    self.i = at
                    a, b = self.atom()
                    assert self.i == stop
                self.eps[end].append(a)
                out = self.state()
                self.eps[b].append(out)
                if k >= low:
                    self.eps[end].append(out)
                if high is None and k == max(low, 1) - 1:
                    self.eps[b].append(a)
                    if low == 0:
                        self.eps[end].append(out)
                end = out
            self.i = after
        return start, end

    def times(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in "?*+" and c:
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            close = self.p.index("}", self.i)
            low, comma, high = self.p[self.i + 1 : close].partition(",")
            self.i = close + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def one(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.i += 1
            span = self.alternatives()
            assert self.peek() == ")", self.p
            self.i += 1
            return span
        start, end = self.state(), self.state()
        if self.peek() == "[":
            self.i += 1
            chars: set[int] = set()
            while self.peek() != "]":
                low = self.one()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    chars |= set(range(low, self.one() + 1))
                else:
                    chars.add(low)
            self.i += 1
        else:
            chars = {self.one()}
        if self.fold:
            chars |= {ord(chr(c).swapcase()) for c in chars if chr(c).isascii() and chr(c).isalpha()}
        self.arcs[start] = (frozenset(chars), end)
        return start, end


@dataclass(frozen=True)
class Dfa:
    """State 0 is the start. ``next`` is flat; ``accepts[s]`` has bit r set where rule r ends in state s."""

    classes: np.ndarray  # uint8[256]; the last class is the cut between texts, which no byte has
    width: int
    next: np.ndarray  # int32[states * width]; entries are state * width
    accepts: np.ndarray  # uint32[states]

    def dead(self) -> int:
        """The entry of a state that accepts nothing and that nothing leaves, or -1."""
        table = self.next.reshape(-1, self.width)[:, :-1]
        own = np.arange(len(table)) * self.width
        stuck = np.flatnonzero((table == own[:, None]).all(axis=1) & (self.accepts == 0))
        return int(stuck[0] * self.width) if len(stuck) else -1

    def walk(self, data: bytes) -> list[int]:
        """The rule bits after each byte, from the start state."""
        out, s = [], 0
        for c in self.classes[np.frombuffer(data, np.uint8)]:
            s = int(self.next[s + c])
            out.append(int(self.accepts[s // self.width]))
        return out


def _nfa(rules: list[tuple[str, bool]]) -> tuple[list[list[int]], list, list[int], list[int]]:
    eps, arcs, starts, ends = [], [], [], []
    for pattern, fold in rules:
        p = _Parser(pattern, fold)
        a, b = p.alternatives()
        assert p.i == len(pattern), pattern
        base = len(eps)
        eps += [[x + base for x in e] for e in p.eps]
        arcs += [(c, t + base) if (x := arc) and (c := x[0]) and (t := x[1]) is not None else None for arc in p.arcs]
        starts.append(a + base)
        ends.append(b + base)
    return eps, arcs, starts, ends


def _determinise(eps, arcs, starts: list[int], ends: list[int], search: bool) -> Dfa:
    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if arcs[x] is not None or x in final)

    final = set(ends)
    signature: dict[int, tuple] = {b: tuple(k for k, a in enumerate(arcs) if a and b in a[0]) for b in range(256)}
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature.values()))}
    classes = np.array([kinds[signature[b]] for b in range(256)], np.uint8)
    example = {k: b for b, k in reversed(list(enumerate(classes.tolist())))}
    width = len(kinds) + 1
    first = closure(starts)
    moves: dict[tuple[int, int], frozenset[int]] = {}

    def step(state: frozenset[int], byte: int) -> frozenset[int]:
        out: set[int] = set(first) if search else set()
        for x in state:
            if arcs[x] and byte in arcs[x][0]:
                if (x, byte) not in moves:
                    moves[x, byte] = closure([arcs[x][1]])
                out |= moves[x, byte]
        return frozenset(out)

    ids, table, todo = {first: 0}, [], [first]
    while todo:
        fresh: list[frozenset[int]] = []
        for state in todo:
            row = []
            for k in range(width - 1):
                to = step(state, example[k])
                if to not in ids:
                    ids[to] = len(ids)
                    fresh.append(to)
                row.append(ids[to])
            table.append([*row, 0])
        todo = fresh
    nxt = np.array(table, np.int64)
    accepts = np.zeros(len(ids), np.uint32)
    for state, k in ids.items():
        for r, e in enumerate(ends):
            accepts[k] |= np.uint32((e in state) << r)
    # partition refinement: states are one while they accept alike and lead to the same blocks
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[nxt]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    for b in block:  # blocks numbered by first state, so the start stays 0
        if order[b] < 0:
            order[b] = order.max() + 1
    block = order[block]
    keep = np.unique(block, return_index=True)[1]
    return Dfa(classes, width, (block[nxt[keep]] * width).astype(np.int32).ravel(), accepts[keep])


def compile_rules(rules: list[tuple[str, bool]]) -> Dfa:
    """One automaton that finds every rule anywhere. rules: (pattern, letters in either case)."""
    return _determinise(*_nfa(rules), search=True)


def compile_reversed(pattern: str, fold: bool) -> Dfa:
    """An anchored automaton for the mirrored pattern: from a match's end back to its starts."""
    eps, arcs, (start,), (end,) = _nfa([(pattern, fold)])
    back_eps: list[list[int]] = [[] for _ in eps]
    back_arcs: list = [None] * len(arcs)
    extra: list[tuple[int, tuple[frozenset[int], int]]] = []
    for a, out in enumerate(eps):
        for b in out:
            back_eps[b].append(a)
    for a, arc in enumerate(arcs):
        if arc:
            extra.append((arc[1], (arc[0], a)))
    for at, arc in extra:  # several arcs can meet in one state: each gets a state of its own
        back_eps.append([])
        back_arcs.append(arc)
        back_eps[at].append(len(back_arcs) - 1)
    return _determinise(back_eps, back_arcs, [end], [start], search=False)


def scan(dfa: Dfa, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits after each byte where any is set, those places) over texts laid out in ``data`` with offsets ``off``.

    The buffer is cut into lanes that step together. A lane starts in state 0; where the lane before ends in another state,
    it is run again from that state until it meets its own first run.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # a cut class after each text sends the automaton back to its start
    cls = np.full(n + len(off) - 1, dfa.width - 1, np.uint8)
    at = np.arange(n) + np.repeat(np.arange(len(off) - 1), np.diff(off))
    cls[at] = dfa.classes[data]
    lanes = min(LANES, max(1, len(cls) // 64))
    steps = -(-len(cls) // lanes)
    grid = np.full(lanes * steps, dfa.width - 1, np.uint8)
    grid[: len(cls)] = cls
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    seen = np.empty((steps, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for t in range(steps):
        state = dfa.next[state + grid[t]]
        seen[t] = state
    true = np.zeros(lanes, np.int32)  # the state that each lane was run from
    while True:
        want = np.concatenate([[0], seen[-1][:-1]]).astype(np.int32)
        redo = np.flatnonzero(want != true)
        if not len(redo):
            break
        true[redo] = want[redo]
        state = want[redo]
        for t in range(steps):
            state = dfa.next[state + grid[t, redo]]
            differs = state != seen[t, redo]
            if not differs.any():
                break
            seen[t, redo] = state
    hit = (dfa.accepts != 0)[seen // dfa.width].T.ravel()[: len(cls)]
    places = np.flatnonzero(hit)
    bits = dfa.accepts[seen.T.ravel()[places] // dfa.width]
    back = places - np.searchsorted(off[1:] + np.arange(len(off) - 1), places, side="left")
    return bits, back
