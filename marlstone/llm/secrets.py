"""Secret scanning with one automaton for all rules (operator 2).

Every text is read once by the combined automaton (see ``automaton``), which marks where a rule can end. Ends are then taken
in order; the mirrored automaton of the rule walks back from each to its earliest start that lies behind the match before.
This gives the leftmost, longest, non-overlapping matches of each rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.automaton import Dfa, compile_reversed, compile_rules, scan
from marlstone.llm.textbytes import slices


@dataclass(frozen=True)
class Rule:
    """``least``: shortest accepted match, in bytes, or shortest accepted value behind the sign where ``value`` is set.

    Lengths that most texts come near (``hex``) are counted by the automaton; the rest are filtered afterwards, as counters
    of several rules that run at once would multiply its states.
    """

    kind: str
    pattern: str
    fold: bool = False
    least: int = 0
    value: bool = False


# The base rules in the order of the contract, then well-known token formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


@lru_cache(maxsize=4)
def machines(rules: tuple[Rule, ...]) -> tuple[Dfa, tuple[Dfa, ...]]:
    return compile_rules([(r.pattern, r.fold) for r in rules]), tuple(compile_reversed(r.pattern, r.fold) for r in rules)


def _value_length(match: bytes) -> int:
    """Length of group 2 of an ``assign`` match: what stands behind the first ':' or '=' with its blanks and quote."""
    at = min(k for k in (match.find(b":"), match.find(b"=")) if k >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def matches(data: np.ndarray, off: np.ndarray, rules: tuple[Rule, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """(start, rule, end) of the accepted matches by text, as byte places within the text."""
    dfa, mirrored = machines(rules)
    bits, at = scan(dfa, data, off)
    doc = np.searchsorted(off, at, side="right") - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r, (rule, back) in enumerate(zip(rules, mirrored, strict=True)):
        mine = np.flatnonzero(bits >> np.uint32(r) & 1)
        if not len(mine):
            continue
        a, d = at[mine], doc[mine]
        last = np.ones(len(a), bool)
        last[:-1] = (a[1:] != a[:-1] + 1) | (d[1:] != d[:-1])
        begun, of, dead = 0, -1, back.dead()
        for end, k in zip((a[last] + 1).tolist(), d[last].tolist(), strict=True):
            if k != of:
                of, begun = k, int(off[k])
            state, start = 0, -1
            nxt, accepts, classes, width = back.next, back.accepts, back.classes, back.width
            for p in range(end - 1, begun - 1, -1):
                state = nxt[state + classes[data[p]]]
                if accepts[state // width]:
                    start = p
                elif state == dead:
                    break
            if start < 0:
                continue
            begun = end
            if (_value_length(data[start:end].tobytes()) if rule.value else end - start) < rule.least:
                continue
            found.setdefault(k, []).append((start - int(off[k]), r, end - int(off[k])))
    return found


def _row(text: bytes, hits: list[tuple[int, int, int]], rules: tuple[Rule, ...], base: int) -> tuple:
    counts = [0] * len(rules)
    if not hits:
        return (0,) * base, 0, "", ""
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    place = lambda p: int(points[p - 1]) if p else 0
    spans = []
    for start, r, end in sorted(hits):
        counts[r] += 1
        spans.append((place(start), r, place(end)))
    say = lambda some: ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in some)
    return tuple(counts[:base]), sum(counts[base:]), say([x for x in spans if x[1] < base]), say(spans)


def scan_batches(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], base: int) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for part, data, off in slices(batch):
            n = part.num_rows
            found = matches(data, off, rules)
            counts = np.zeros((base, n), np.int64)
            added = np.zeros(n, np.int64)
            sha, spans = [nothing] * n, [""] * n
            for k, hits in found.items():
                per, more, of_base, of_all = _row(data[off[k] : off[k + 1]].tobytes(), hits, rules, base)
                counts[:, k], added[k], spans[k] = per, more, of_all
                sha[k] = hashlib.sha256(of_base.encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(c) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """One row per input row with counts by kind, a digest of the base spans, and all spans in code points.

    Null and empty texts have no match (the digest is that of the empty string). Repeated rows give repeated results, an
    empty table an empty one; other columns are left out. Starts that tie are ordered by kind as listed in ``BASE`` + ``added``.
    """
    rules = (*BASE, *added)
    rows = docs.selectExpr(f"`{key}` as doc_id", f"`{text}` as text")
    return rows.mapInArrow(lambda it: scan_batches(it, rules, len(BASE)), SCHEMA)
