"""Language-model scoring by logistic context mixing over the running text (operator 7).

A text is a row of tokens: lower-cased words, then one end. Every token is told by a row of binary decisions: along a Huffman
tree of the ``VOCABULARY`` most frequent training words that occur ``LEAST`` times; a word outside of it takes the tree's escape and is then spelt, byte by
byte along a Huffman tree of the training documents' bytes, up to a closing sign. For each decision six predictors, each under a hashed context, know how often either
bit came there in the training documents: for words the contexts are none, the last one, two and three words, the last
word that is among the most frequent ones (which tells the language), and the end of the last word; within a spelt word they
are none, the last one, two and three bytes, the word so far, and that with the last frequent word. Their logits are mixed with weights that a gate picks by how much the longest contexts have seen.
Along a text the weights are adapted, block after block, to what came so far.

1. Documents are cut into chunks; a chunk lists its distinct words, and its documents become rows of places in that list. Words
   of training documents are counted over all chunks, which gives the base score and the vocabulary.
2. The predictors' counts are summed over all training documents. They are whole numbers, so their sums don't depend on how
   documents are dealt over tasks.
3. The weights are learnt from every decision of all training documents, each left out of the counts that tell it: one Newton step from fixed
   weights, whose sums are whole numbers too. Every document is then scored by itself, so scores don't depend on partitions either.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.labelled import held_out
from marlstone.llm.spool import spool
from marlstone.llm.tables import PART, summed, table_parts
from marlstone.llm.textbytes import lower, mix64, slices, span_hash, words

VOCABULARY, LEAST = 1 << 17, 2  # words with a code of their own, and how often one occurs at least; all others are spelt
FREQUENT = 256  # of these, the words that make a context of their own
ORDERS, SLOT_BITS = 6, 19  # predictors, and slots of each: 24 MiB of counts
GATES, SMOOTH, RIDGE = 26, 0.1, 10.0
UNIT, STEPS = 64, 1024  # parts of a logit's and of a probability's unit in the weights' sums
SOME_TOKENS, AT_ONCE, ROWS = 1 << 12, 1 << 18, 1 << 12  # tokens whose decisions are made at once, few enough for a core's cache; decisions sorted by gate at once, and multiplied at once
CLIP = 14  # bound of a decision's logit
FIRST_BLOCK, LAST_BLOCK = 32, 1024  # tokens between two adaptations along a text: doubling from the first to the last
RATE = 0.03
CHUNK_BYTES, TABLE_BYTES, PARTS, MOST_COUNTED = 32 << 20, 16 << 20, 32, 1 << 30
CLOSE = 0x20  # the sign that ends a spelt word; no word holds it
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------ words and counts


def _chunks(docs: DataFrame) -> DataFrame:
    """kind 0: (chunk, place, hash, n) by distinct word, counted in training documents; kind 1: (chunk, doc_id, tk, held, size, tokens) by document; kind 2: (chunk, place, n) by byte that training documents hold."""
    names = ["kind", "chunk", "place", "hash", "n", "doc_id", "tk", "held", "size", "tokens"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, seen = 0, np.zeros(256, np.int64)

        def hand_on() -> Iterator[pa.RecordBatch]:
            hashes, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            local = np.split(back, np.cumsum([len(h[0]) for h in held])[:-1])
            tokens = [m[h[1]] for m, h in zip(local, held, strict=True)]
            total, train = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
            for t, h in zip(tokens, held, strict=True):
                total += np.bincount(t, minlength=len(hashes))
                train += np.bincount(t[np.repeat(~h[5], np.diff(h[2]))], minlength=len(hashes))
            rank = np.empty(len(hashes), np.int32)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(hashes))  # frequent words get small places, which compress well
            chunk = _chunk_name(held)
            none = lambda k, t: pa.nulls(k, t)
            n = len(hashes)
            there = np.flatnonzero(seen)
            if k := len(there):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 2, np.int32)), pa.array(np.full(k, chunk)), pa.array(there.astype(np.int32)), none(k, pa.int64()), pa.array(seen[there]), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.int64()), none(k, pa.binary())], names=names)
                seen[:] = 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, chunk)), pa.array(rank), pa.array(hashes.view(np.int64)), pa.array(train), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.int64()), none(n, pa.binary())], names=names)
            for t, h in zip(tokens, held, strict=True):
                k = len(h[3])
                rows = [rank[t[a:b]].tobytes() for a, b in zip(h[2][:-1], h[2][1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(np.full(k, chunk)), none(k, pa.int32()), none(k, pa.int64()), none(k, pa.int64()), h[3], h[4], pa.array(h[5]), pa.array(h[6]), pa.array(rows, pa.binary())], names=names)

        for batch in it:
            for part, data, off in slices(batch):
                data = lower(data)
                starts, ends, first = words(data, off)
                h, back = np.unique(span_hash(data, starts, ends), return_inverse=True)
                held.append((h, back.astype(np.int32), first, part.column(0), part.column(1), part.column(2).to_numpy(zero_copy_only=False), np.diff(off)))
                seen += np.bincount(data[np.repeat(~held[-1][5], held[-1][6])], minlength=256)
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield from hand_on()
                    held, size = [], 0
        if held:
            yield from hand_on()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), held_out(F.col("doc_id"), 10).alias("held"), "text")
    return rows.mapInArrow(batches, "kind int, chunk long, place int, hash long, n long, doc_id long, tk long, held boolean, size long, tokens binary")


def _chunk_name(held: list[tuple]) -> int:
    """A number for a chunk from the ids and texts of its documents, the same whenever the chunk is made again."""
    out = np.uint64(len(held))
    for h in held:
        ids, tk = (c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in h[3:5])
        out = mix64(np.array([out ^ np.add.reduce(mix64(ids * _C1 + tk), dtype=np.uint64)]))[0]
    return int(out & np.uint64(0x7FFFFFFFFFFFFFFF))


# ------------------------------------------------------------------- model


def _tree(weights: list[int]) -> tuple[list[int], list[int]]:
    """Huffman's tree: the parent of each node and its side there; leaves come first, the root last."""
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = [0] * len(weights), [0] * len(weights)
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b], side[a], side[b] = len(parent), len(parent), 0, 1
        heapq.heappush(heap, (x + y, len(parent)))
        parent.append(0)
        side.append(0)
    return parent, side


@dataclass
class Codes:
    """Binary codes: ids 0 .. V - 1 are words by ``hashes`` (sorted), V the escape, V + 1 the end, V + 2 + b the byte b."""

    hashes: np.ndarray
    start: np.ndarray  # of each code in ``steps`` and ``bits``
    size: np.ndarray
    steps: np.ndarray  # twice the node, plus the bit
    bits: np.ndarray
    frequent: np.ndarray  # whether a code is one of the FREQUENT commonest words

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, escapes: int, ends: int, signs: np.ndarray | None = None) -> Codes:
        """Huffman codes of the words, and of spelt signs by how often each is expected (alike, if not told); equal counts go by place, so the same counts give the same codes."""
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        weights = [*counts.tolist(), escapes + 1, ends + 1]
        v = len(weights)
        nodes, bits = [], []
        start, size = np.zeros(v + 256, np.int64), np.zeros(v + 256, np.int64)
        for first, own, above in ((0, weights, 0), (v, (np.ones(256, np.int64) if signs is None else signs + 1).tolist(), 1 << 40)):
            parent, side = _tree(own)
            for w in np.argsort(-np.array(own), kind="stable").tolist():  # paths of frequent words lie close together, which a core's cache likes
                path, k = [], w
                while k != len(parent) - 1:
                    path.append((above + parent[k], side[k]))
                    k = parent[k]
                start[first + w], size[first + w] = len(nodes), len(path)
                nodes += [n for n, _ in reversed(path)]
                bits += [s for _, s in reversed(path)]
        nodes, bits = np.array(nodes, np.int64), np.array(bits, np.int8)
        frequent = np.zeros(len(size), bool)
        frequent[np.lexsort((hashes, -counts))[:FREQUENT]] = True
        return Codes(hashes, start, size, nodes << 1 | bits, bits, frequent)


@dataclass
class Tokens:
    """Texts of a slice as tokens, the end of each included: hash, code, bytes, and the contexts that words before give."""

    data: np.ndarray
    first: np.ndarray  # of each text
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    topic: np.ndarray  # hash of the last frequent word before
    context: np.ndarray  # ORDERS x tokens


def tokens_of(data: np.ndarray, off: np.ndarray, codes: Codes) -> Tokens:
    data = lower(data)
    starts, ends, of_text = words(data, off)
    n, v = len(off) - 1, len(codes.hashes)
    count = np.diff(of_text)
    first = np.concatenate([[0], np.cumsum(count + 1)])
    at = np.arange(len(starts)) + np.repeat(np.arange(n), count)
    h = np.zeros(first[-1], np.uint64)
    h[at] = span_hash(data, starts, ends)
    code, start, end = np.full(len(h), v + 1), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    start[at], end[at] = starts, ends
    near = np.minimum(np.searchsorted(codes.hashes, h[at]), max(v - 1, 0))
    code[at] = np.where(codes.hashes[near] == h[at], near, v) if v else v
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    back = []
    for k in (1, 2, 3):
        b = np.zeros(len(h), np.uint64)
        b[k:] = h[:-k]
        b[place < k] = 0
        back.append(b)
    tail = np.zeros(len(h), np.uint64)
    if len(data):
        last = np.zeros(len(h), np.uint64)
        for k in (1, 2, 3):
            inside = (end - start) >= k
            last = last * np.uint64(257) + np.where(inside, data[np.maximum(end - k, 0)], 0).astype(np.uint64)
        tail[1:] = last[:-1]
        tail[place < 1] = 0
    latest = np.zeros(len(h), np.int64)
    latest[1:] = np.maximum.accumulate(np.where(codes.frequent[code], np.arange(len(h)), -1))[:-1]
    topic = np.where((latest >= np.repeat(first[:-1], np.diff(first))) & (place > 0), h[latest], 0).astype(np.uint64)
    one, two, three = back
    pair = mix64(one * _C1 + two)
    context = np.stack([np.zeros(len(h), np.uint64), mix64(one + np.uint64(1)), mix64(pair + np.uint64(2)), mix64(pair * _C2 + three + np.uint64(3)), mix64(topic + np.uint64(4)), mix64(tail + np.uint64(5))])
    return Tokens(data, first, code, start, end, topic, context)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def decisions(t: Tokens, some: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The decisions of the tokens ``some``: owner by symbol (its token's place in ``some``), slots (ORDERS x decisions), bit, whether it spells by symbol, and bounds.

    Symbols are tokens and spelt signs, those of long codes first. Decisions go by depth: those from ``bounds[d]`` to ``bounds[d + 1]`` are
    the d-th ones of the first symbols, so that what holds for a symbol is added to its decisions by slices.
    """
    code = t.code[some]
    spelt = np.flatnonzero(code == len(codes.hashes))
    context, symbol, owner = t.context[:, some], code, np.arange(len(some))
    if len(spelt):
        length = t.end[some[spelt]] - t.start[some[spelt]]
        source = ranges(t.start[some[spelt]], length + 1)
        place = ranges(np.zeros(len(spelt), np.int64), length + 1)
        closes = place == np.repeat(length, length + 1)
        sign = np.where(closes, CLOSE, t.data[np.minimum(source, len(t.data) - 1)]).astype(np.uint64)
        more = np.empty((ORDERS, len(sign)), np.uint64)
        run = np.zeros(len(sign), np.uint64)
        more[0] = np.uint64(6)
        for k in (1, 2, 3):
            b = np.zeros(len(sign), np.uint64)
            b[k:] = sign[:-k] + np.uint64(1)
            b[place < k] = 0
            run = run * _C1 + b
            more[k] = mix64(run + np.uint64(6 + k))
        marks = mix64((sign + np.uint64(1)) * _C2 ^ place.astype(np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks)])
        head = np.cumsum(length + 1) - (length + 1)
        prefix = mix64(sums[:-1] - np.repeat(sums[head], length + 1) + np.uint64(10))
        more[4] = prefix
        more[5] = mix64(prefix * _C1 + np.repeat(t.topic[some[spelt]], length + 1))
        context = np.concatenate([context, more], axis=1)
        symbol = np.concatenate([symbol, len(codes.hashes) + 2 + sign.astype(np.int64)])
        owner = np.concatenate([owner, np.repeat(spelt, length + 1)])
    size = codes.size[symbol]
    order = np.argsort(-size.astype(np.int16), kind="stable")
    size, symbol, context = size[order], symbol[order], np.take(context, order, axis=1)
    deep = int(size[0]) if len(size) else 0
    live = len(size) - np.searchsorted(size[::-1], np.arange(deep), side="right")  # symbols with a decision at each depth
    bounds = [0, *np.cumsum(live).tolist()]
    begin = codes.start[symbol]
    where = np.empty(bounds[-1], np.int64)
    for d in range(deep):
        np.add(begin[: live[d]], d, out=where[bounds[d] : bounds[d + 1]])
    steps = np.take(codes.steps, where, mode="clip")
    bit = (steps & 1).astype(np.int8)
    node = (steps >> 1).view(np.uint64) * _C1
    mixed = np.empty((ORDERS, len(node)), np.uint64)
    for d in range(deep):
        np.bitwise_xor(context[:, : live[d]], node[bounds[d] : bounds[d + 1]], out=mixed[:, bounds[d] : bounds[d + 1]])
    mixed *= _C2
    mixed >>= np.uint64(64 - SLOT_BITS)
    return owner[order], mixed.view(np.int64), bit, symbol >= len(codes.hashes) + 2, bounds


def spread(of_symbols: np.ndarray, bounds: list[int], out: np.ndarray) -> np.ndarray:
    """Add each symbol's value to its decisions in ``out``, row by row."""
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[..., a:b] += of_symbols[..., : b - a]
    return out


def sizes(bounds: list[int]) -> np.ndarray:
    """How many decisions each symbol has."""
    live = np.diff(bounds)
    return np.searchsorted(-live, -np.arange(live[0] if len(live) else 0), side="left")


def gathered(of_decisions: np.ndarray, bounds: list[int]) -> np.ndarray:
    """The sum of each symbol's decisions, row by row."""
    out = np.zeros_like(of_decisions[..., : bounds[1] if len(bounds) > 1 else 0])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[..., : b - a] += of_decisions[..., a:b]
    return out


def count_tables(docs: DataFrame, codes, size: int) -> np.ndarray:
    """ORDERS x slots x 2: how often either bit came under each hashed context, over all documents, in 64 bits. Tables are summed part by part in Spark."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, one, done = np.zeros((ORDERS, 2 << SLOT_BITS), np.int32), np.int32(1), 0
        for batch in it:
            for _, data, off in slices(batch):
                t = tokens_of(data, off, codes.value)
                for a in range(0, len(t.code), SOME_TOKENS):
                    _, slots, bit, _, _ = decisions(t, np.arange(a, min(len(t.code), a + SOME_TOKENS)), codes.value)
                    slots <<= 1
                    slots |= bit
                    for k in range(ORDERS):
                        np.add.at(table[k], slots[k], one)
                    done += len(bit)
                    if done > MOST_COUNTED:  # a count in 32 bits can't pass 2^31 before its table is handed on
                        yield from table_parts(table, PARTS)
                        table[:], done = 0, 0
        yield from table_parts(table, PARTS)

    tasks = max(1, math.ceil(size / TABLE_BYTES))  # fewer tasks than the scan has only where a task would read less than TABLE_BYTES
    return summed(docs.select("text").coalesce(tasks).mapInArrow(batches, PART), PARTS, ORDERS * (2 << SLOT_BITS)).reshape(ORDERS, 1 << SLOT_BITS, 2)


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + SMOOTH) / (n0 + SMOOTH))


def level(n: np.ndarray) -> np.ndarray:
    """0 to 3: nothing seen, little, some, much."""
    return np.searchsorted([0.5, 1.5, 6], n).astype(np.int8)


def gate(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """The longest context that has seen anything, and how much it has; spelt signs have gates of their own, 13 further on."""
    return np.maximum(np.maximum(one, two + np.int8(3) * (two > 0)), three + np.int8(6) * (three > 0))


@dataclass
class Mixer:
    """What scoring needs, the predictors' logits as a table: broadcast, 12 MiB whatever the corpus."""

    logits: np.ndarray  # ORDERS x slots; the last two bits of those of the contexts 1 to 3 tell their levels
    weights: np.ndarray  # GATES x (ORDERS + 1)

    def inputs(self, slots: np.ndarray, spelt: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty(slots.shape, np.float32)
        for k in range(ORDERS):
            np.take(self.logits[k], slots[k], out=x[k], mode="clip")
        levels = (x[1:4].view(np.int32) & 3).astype(np.int8)
        return x, spread(13 * spelt.astype(np.int8), bounds, gate(*levels))


def first_weights() -> np.ndarray:
    return np.tile(np.array([0.2, 0.3, 0.3, 0.3, 0.1, 0.1, 0.0]), (GATES, 1))


def leave_one_out(counts: np.ndarray) -> np.ndarray:
    """For occurrences in training documents, each without itself, by slot and bit (ORDERS x 2 slots): four times the logit in 64ths, plus the level."""
    out = np.empty(counts.shape, np.int16)
    for k in range(ORDERS):
        n0, n1 = counts[k, :, 0].astype(np.float32), counts[k, :, 1].astype(np.float32)
        out[k, :, 0] = np.rint(stretch(np.maximum(n0 - 1, 0), n1) * UNIT)
        out[k, :, 1] = np.rint(stretch(n0, np.maximum(n1 - 1, 0)) * UNIT)
        out[k] <<= 2
        out[k] |= level(np.maximum(counts[k].sum(1) - 1, 0))[:, None]
    return out.reshape(ORDERS, -1)


def first_errors() -> tuple[np.ndarray, np.ndarray]:
    """The probability that the first weights give and its variance, in steps, by ten times their sum over inputs in 64ths; the middle is 0."""
    z = np.arange(-(1 << 15), 1 << 15) / (10 * UNIT)
    p = 1 / (1 + np.exp(-np.clip(z, -CLIP, CLIP)))
    return np.rint(p * STEPS).astype(np.int16), np.rint(p * (1 - p) * STEPS).astype(np.int16)


class WeightSums:
    """By gate the loss's second derivatives in the weights and, in the last column, the first ones, at the first weights.

    Inputs, errors and variances are whole multiples of their units, so sums don't depend on how documents are dealt over tasks.
    """

    def __init__(self, told: np.ndarray):
        self.told = told.copy()  # an array of its own may lie in large pages, which an unpickled one doesn't
        self.total = np.zeros((GATES, ORDERS + 1, ORDERS + 2), np.int64)
        self.tenths = np.rint(first_weights()[0, :ORDERS] * 10).astype(np.int16)  # the first weights are the same for all gates
        self.chance, self.variance = first_errors()
        self.held: list[tuple] = []
        self.size = 0

    def see(self, t: Tokens, codes: Codes) -> None:
        for a in range(0, len(t.code), SOME_TOKENS):
            _, slots, bit, spelt, bounds = decisions(t, np.arange(a, min(len(t.code), a + SOME_TOKENS)), codes)
            slots <<= 1
            slots |= bit
            x = np.empty(slots.shape, np.int16)
            for k in range(ORDERS):
                np.take(self.told[k], slots[k], out=x[k], mode="clip")
            g = spread(13 * spelt.astype(np.int8), bounds, gate(*(x[1:4] & 3).astype(np.int8)))
            x >>= 2
            z = np.zeros(len(bit), np.int16)
            for row, w in zip(x, self.tenths, strict=True):
                z += row * w
            z = z.astype(np.int64) + (1 << 15)
            self.held.append((x, g, np.take(self.chance, z) - bit * np.int16(STEPS), np.take(self.variance, z)))
            self.size += len(bit)
            if self.size >= AT_ONCE:
                self.add()

    def add(self) -> None:
        if not self.size:
            return
        x, g, err, var = (np.concatenate(c, axis=-1) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(g, kind="stable")
        bound = np.searchsorted(g[order], np.arange(GATES + 1))
        for k in np.flatnonzero(np.diff(bound)).tolist():
            for a in range(bound[k], bound[k + 1], ROWS):
                own = order[a : min(a + ROWS, bound[k + 1])]
                rows, told = np.full((ORDERS + 1, len(own)), float(UNIT)), np.empty((ORDERS + 2, len(own)))
                rows[:ORDERS] = np.take(x, own, axis=1)
                np.multiply(rows, var[own], out=told[:-1])
                told[-1] = err[own]
                self.total[k] += (rows @ told.T).astype(np.int64)


def weight_sums(docs: DataFrame, codes, told) -> np.ndarray:
    """GATES x (ORDERS + 1) x (ORDERS + 2): the ``WeightSums`` over every decision of all documents."""
    n = ORDERS + 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = WeightSums(told.value)
        for batch in it:
            for _, data, off in slices(batch):
                out.see(tokens_of(data, off, codes.value), codes.value)
        out.add()
        yield from table_parts(out.total, 1)

    sums = summed(docs.select("text").mapInArrow(batches, PART), 1, GATES * n * (n + 1)).reshape(GATES, n, n + 1).astype(np.float64)
    return np.concatenate([sums[:, :, :n] / (UNIT * UNIT * STEPS), sums[:, :, n:] / (UNIT * STEPS)], axis=2)


def learned_weights(sums: np.ndarray) -> np.ndarray:
    """One Newton step from the first weights; those of a gate that has seen little stay near them."""
    step = np.linalg.solve(sums[:, :, :-1] + RIDGE * np.eye(ORDERS + 1), sums[:, :, -1:])[:, :, 0]
    return first_weights() - step


def mixer_of(counts: np.ndarray, weights: np.ndarray) -> Mixer:
    logits = stretch(counts[:, :, 0].astype(np.float32), counts[:, :, 1].astype(np.float32)).astype(np.float32)
    for k in (1, 2, 3):
        told = logits[k].view(np.int32)
        told &= ~3
        told |= level(counts[k].sum(1))
    return Mixer(logits, weights)


def log10_probabilities(data: np.ndarray, off: np.ndarray, mixer: Mixer, codes: Codes) -> np.ndarray:
    """log10 probability of each text. All texts go forward together, block by block; each adapts weights of its own."""
    t = tokens_of(data, off, codes)
    n = len(off) - 1
    size = np.diff(t.first)
    weights = np.ascontiguousarray(mixer.weights.T, np.float32)
    out, own = np.zeros(n), np.zeros((ORDERS + 1, 2 * n))  # each text's changes of the weights, apart for spelt signs
    at, step = 0, FIRST_BLOCK
    live = np.arange(n)
    while len(live):
        length = np.minimum(size[live] - at, step)
        upto = np.cumsum(length)
        for some in np.split(np.arange(len(live)), np.flatnonzero(np.diff((upto - 1) // SOME_TOKENS)) + 1):  # texts don't touch each other, so a few go at once
            texts = live[some]
            owner, slots, bit, spelt, bounds = decisions(t, ranges(t.first[texts] + at, length[some]), codes)
            text = np.repeat(texts, length[some])[owner]
            kind = text + n * spelt
            x, g = mixer.inputs(slots, spelt, bounds)
            mixed = np.empty((ORDERS + 1, len(bit)), np.float32)
            g = g.astype(np.intp)
            for k in range(ORDERS + 1):
                np.take(weights[k], g, out=mixed[k], mode="clip")
            spread(np.take(own, kind, axis=1).astype(np.float32), bounds, mixed)
            mixed[:ORDERS] *= x
            z = np.clip(mixed.sum(0), -CLIP, CLIP)
            sign = (1 - 2 * bit).astype(np.float32)  # -1 for a set bit
            odds = np.exp(z * sign)  # of the other bit
            err = mixed[ORDERS]
            np.multiply(odds / (1 + odds), sign, out=err)
            np.multiply(x, err, out=mixed[:ORDERS])
            out -= np.bincount(text, gathered(np.log1p(odds), bounds), n)
            many = np.sqrt(np.maximum(np.bincount(kind, sizes(bounds), 2 * n), 1))
            for k, change in enumerate(gathered(mixed, bounds)):
                own[k] -= RATE * np.bincount(kind, change, 2 * n) / many
        at += step
        step = min(2 * step, LAST_BLOCK)
        live = live[size[live] > at]
    return out / math.log(10)


# ------------------------------------------------------------------- query


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``bits_per_byte`` is the model's total of bits over the bytes of the text. Null and empty
    texts are the end token alone. Repeated rows count as often as they stand there. Without training documents the tables are
    empty and the weights stay as they start. Rows with a null id are held out. Other columns, of whatever name, are left out.
    """
    spark = docs.sparkSession
    chunks = spool(_chunks(docs), "chunks")
    known = spool(chunks.where("kind = 0").groupBy("hash").agg(F.sum("n").alias("n")), "vocabulary")
    ends, size = chunks.where("kind = 1").agg(F.count(F.when(~F.col("held"), 1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    sums = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    n_train, distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    common = known.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "hash").limit(VOCABULARY).toArrow()  # at most VOCABULARY rows
    hashes, counts = common.column("hash").to_numpy().view(np.uint64), common.column("n").to_numpy()
    signs = np.zeros(256, np.int64)
    for byte, n in chunks.where("kind = 2").groupBy("place").agg(F.sum("n")).collect():
        signs[byte] = n
    signs[[*range(0x09, 0x0E), CLOSE]] = 0  # no word holds these; every word has a closing sign
    signs[CLOSE] = int(sums[0])
    codes = spark.sparkContext.broadcast(Codes.build(hashes, counts, int(sums[0]) - int(counts.sum()), ends, signs))
    train = docs.where(~held_out(F.col("doc_id"), 10)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = count_tables(train, codes, size)
    told_once = spark.sparkContext.broadcast(leave_one_out(table))
    sums_of_weights = weight_sums(train, codes, told_once)
    told_once.unpersist()
    mixer = spark.sparkContext.broadcast(mixer_of(table, learned_weights(sums_of_weights)))
    below = n_train + 0.1 * (distinct + 1)
    end_base = math.log10((ends + 0.1) / below)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer(mixer.value.logits.copy(), mixer.value.weights)  # as in WeightSums
        for batch in it:
            for part, data, off in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(log10_probabilities(data, off, own, codes.value))], names=["doc_id", "tk", "score"])

    def base(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(left.num_rows, np.int64)
        n[left.column("place").to_numpy()] = left.column("n").to_numpy()
        logs, seen = np.log10((n + 0.1) / below), (n > 0).astype(np.int64)
        out: tuple[list, list, list] = ([], [], [])
        for raw in right.column("tokens"):
            t = np.frombuffer(raw.as_buffer(), np.int32)
            for column, value in zip(out, (len(t) + 1, int(seen[t].sum()) + (ends > 0), float(logs[t].sum()) + end_base), strict=True):
                column.append(value)
        return pa.table([right.column("doc_id"), right.column("tk"), right.column("held"), right.column("size"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["doc_id", "tk", "held_out", "size", "n_tokens", "n_known", "base_score"])

    told = chunks.where("kind = 0").select("chunk", "place", "hash").join(known, "hash").select("chunk", "place", "n")
    rows = chunks.where("kind = 1").select(F.col("chunk").alias("of_chunk"), "doc_id", "tk", "held", "size", "tokens")
    based = told.groupBy("chunk").cogroup(rows.groupBy("of_chunk")).applyInArrow(base, "doc_id long, tk long, held_out boolean, size long, n_tokens long, n_known long, base_score double")
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").mapInArrow(score, "doc_id long, tk long, score double")
    scored = scored.groupBy("doc_id", "tk").agg(F.first("score").alias("score"))  # rows that repeat have one score
    both = based.join(scored, based["doc_id"].eqNullSafe(scored["doc_id"]) & (based["tk"] == scored["tk"]))
    bits = -F.col("score") / math.log10(2) / F.greatest(F.col("size"), F.lit(1))
    return both.select(based["doc_id"], "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
