"""Byte-level BPE with a lexicon of frequent words (operator 8).

Words (the pieces that the tokenizer's pattern cuts a text into, found by array operations, see ``wordcache``) are counted over all documents. The most frequent ones are
merged once and compiled into a minimal acyclic transducer: one automaton that shares prefixes and suffixes, whose arcs count
the words they skip, so that a word's walk gives its place in a table of ids. The transducer is one file of plain arrays that
Spark hands to every executor and every Python worker maps into memory. Words that it lacks are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.spool import spool
from marlstone.llm.textbytes import byte_alphabet, slices, span_digest, strings
from marlstone.llm.wordcache import WordEncoder, code_point_classes, cut_words
from marlstone.llm.workers import HELD as _HELD  # noqa: F401
from marlstone.llm.workers import keep, release

LEXICON_WORDS = 1 << 17  # bound on the words in the transducer
KNOWN_WORDS = 1 << 17  # bound on the words that a worker remembers between batches; some 250 bytes each, for as long as the worker lives
COUNTED_WORDS = 1 << 17  # distinct words after which a counting task hands on what it has; Spark sums them within the task
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Vocabulary:
    """tokens: bytes by id; pairs: (left id, right id) to (rank, merged id); special: texts that are one token."""

    tokens: dict[int, bytes]
    pairs: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        ids = spec["model"]["vocab"]
        pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[ids[a], ids[b]] = (rank, ids[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(of[c] for c in t) for t, i in ids.items() if t not in special}
        return Vocabulary(tokens | {i: t.encode() for t, i in special.items()}, pairs, special)

    def single(self) -> list[int]:
        """The id of each byte."""
        found = {t[0]: i for i, t in self.tokens.items() if len(t) == 1}
        return [found[b] for b in range(256)]


def merge_word(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the lowest-ranked pair, leftmost first, until none is left; a heap keeps long words from costing their square."""
    if len(ids) < 2:
        return ids
    ids = list(ids)
    right = [*range(1, len(ids)), -1]
    left = [-1, *range(len(ids) - 1)]
    heap = []
    for i in range(len(ids) - 1):
        if (m := pairs.get((ids[i], ids[i + 1]))) is not None:
            heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = new, -1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (m := pairs.get((new, ids[k]))) is not None:
                heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
        if (h := left[i]) >= 0 and (m := pairs.get((ids[h], new))) is not None:
            heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
    return [x for x in ids if x >= 0]


class Transducer:
    """keys: sorted (state << 8 | byte) of all arcs; target, skip: by arc; final: by state; first, ids: the outputs by word."""

    NAMES = ("keys", "target", "skip", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def build(words: list[bytes], outputs: list[list[int]]) -> Transducer:
        """words: sorted and distinct. Incremental construction: a state is frozen, and shared with an equal one, once no later word can pass it."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]
        before = b""

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                s = path.pop()
                form = (final[s], tuple(arcs[s].items()))
                if (same := register.get(form)) is None:
                    register[form] = s
                else:
                    arcs[path[-1]][before[len(path) - 1]] = same

        for w in words:
            shared = len(os.path.commonprefix([before, w]))
            freeze(shared)
            for b in w[shared:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][b] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            before = w
        freeze(0)
        count: dict[int, int] = {}
        for s in [*sorted(register.values(), key=lambda s: s, reverse=True), 0]:
            stack = [s]
            while stack:
                x = stack[-1]
                todo = [t for t in arcs[x].values() if t not in count]
                if todo and x not in count:
                    stack.extend(todo)
                else:
                    count[x] = int(final[x]) + sum(count[t] for t in arcs[x].values())
                    stack.pop()
        live = {s: k for k, s in enumerate(dict.fromkeys([0, *sorted(register.values())]))}
        keys, target, skip = [], [], []
        for s, k in live.items():
            passed = int(final[s])
            for b, t in sorted(arcs[s].items()):
                keys.append(k << 8 | b)
                target.append(live[t])
                skip.append(passed)
                passed += count[t]
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        first = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int64)
        return Transducer({
            "keys": np.array(keys, np.int64)[order], "target": np.array(target, np.int32)[order], "skip": np.array(skip, np.int32)[order],
            "final": np.array([final[s] for s in live], bool), "first": first, "ids": np.array([i for o in outputs for i in o], np.int32),
        })

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the output table, -1 for words that it lacks; all words step together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        length = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        live, state, passed, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            done = length[live] == depth
            ends = done & self.final[state]
            out[live[ends]] = passed[ends]
            go = ~done
            live, state, passed = live[go], state[go], passed[go]
            key = state << 8 | data[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            has = self.keys[at] == key
            live, at = live[has], at[has]
            state, passed = self.target[at].astype(np.int64), passed[has] + self.skip[at]
            depth += 1
        return out

    def save(self, folder: str) -> str:
        """One file: a line of JSON with names, types and lengths, then the arrays, each from a multiple of 64 bytes."""
        head, at = {}, 0
        for name in self.NAMES:
            a = getattr(self, name)
            head[name] = (a.dtype.str, len(a), at)
            at += -(-a.nbytes // 64) * 64
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 1) % 64) + b"\n"
        path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.bin")
        with open(path, "wb") as f:
            f.write(text)
            for name in self.NAMES:
                raw = getattr(self, name).tobytes()
                f.write(raw + bytes(-len(raw) % 64))
        return path

    @staticmethod
    def load(path: str) -> Transducer:
        """The arrays mapped into memory: pages are shared by all workers of a machine."""
        with open(path, "rb") as f:
            line = f.readline()
        raw = np.memmap(path, np.uint8, "r") if os.path.getsize(path) > len(line) else np.zeros(len(line), np.uint8)
        return Transducer({k: raw[len(line) + at : len(line) + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in json.loads(line).items()})


def counted(it: Iterator[pa.RecordBatch], classes: np.ndarray, text: str) -> Iterator[pa.RecordBatch]:
    """The words of a task's texts and how often they stand there; a word may come more than once."""
    release()
    seen: Counter[bytes] = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in it:
        for _, data, off in slices(batch, text):
            starts = cut_words(data, off, classes)
            ends = np.append(starts[1:], len(data))
            _, at, n = np.unique(span_digest(data, starts, ends)[0], return_index=True, return_counts=True)
            raw = data.tobytes()
            for a, b, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                seen[raw[a:b]] += k
            if len(seen) > COUNTED_WORDS:
                yield hand_on()
    yield hand_on()


def count_words(docs: DataFrame, classes, text: str = "text") -> DataFrame:
    """(word, n) over all documents, summed within tasks before the shuffle. Special tokens' strings count as ordinary text: counts only choose the lexicon."""
    return docs.select(text).mapInArrow(lambda it: counted(it, classes.value, text), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, classes, size: int = LEXICON_WORDS) -> Transducer:
    """The most frequent words of all documents, ``size`` at most, as a transducer.

    A histogram of counts by eighths of a power of two gives the count from which on words fit in; no task sorts them all.
    Words that stand in the corpus once are never among them.
    """
    counts = spool(count_words(docs, classes).where(F.col("n") >= 2), "words")
    level = F.floor(F.log2("n") * 8).cast("int")
    total, cut = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > size:
            break
        cut = row["level"]
    words = sorted(w.encode() for w in counts.where(level >= cut).select("word").toArrow().column(0).to_pylist()) if cut is not None else []
    single = vocabulary.single()
    return Transducer.build(words, [merge_word([single[b] for b in w], vocabulary.pairs) for w in words])


class Encoder(WordEncoder):
    """Encodes in a worker. Of a word met before, its ids as text joined by commas, as the digest is of that, and the bytes that these ids decode to are kept."""

    SLOTS = 1 << 19

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer, classes: np.ndarray):
        self.vocabulary, self.lexicon, self.classes, self.single = vocabulary, lexicon, classes, vocabulary.single()
        self.cut = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.texts: list[str] = []
        self.decoded: list[bytes] = []

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        first, ids = self.lexicon.first, self.lexicon.ids
        return [ids[first[at] : first[at + 1]].tolist() if at >= 0 else merge_word([self.single[x] for x in w], self.vocabulary.pairs) for w, at in zip(words, self.lexicon.places(words).tolist(), strict=True)]

    def _learn(self, words: list[bytes], keys: np.ndarray, checks: np.ndarray) -> None:
        tokens = self.vocabulary.tokens
        base = len(self.texts)
        for found in self._ids(words):
            self.texts.append(",".join(map(str, found)))
            self.decoded.append(b"".join([tokens[i] for i in found]))
        self.check = np.concatenate([self.check, checks])
        self.by_key.update(zip(keys.tolist(), range(base, len(self.texts)), strict=True))

    def _plain(self, data: np.ndarray, off: np.ndarray) -> list[tuple[str, bytes]]:
        if len(self.texts) > KNOWN_WORDS:
            self.forget()
        starts = cut_words(data, off, self.classes)
        place = self._places(data, starts, np.append(starts[1:], len(data))).tolist() if len(starts) else []
        bound = np.searchsorted(starts, off).tolist()
        text, raw = self.texts.__getitem__, self.decoded.__getitem__
        return [(",".join(map(text, place[a:b])), b"".join(map(raw, place[a:b]))) for a, b in zip(bound[:-1], bound[1:], strict=True)]

    def encode(self, column: pa.Array) -> list[tuple[str, bytes]]:
        """Ids of each text joined by commas, and the bytes that they decode to. Null counts as empty."""
        out = self._plain(*strings(column))
        holds = np.zeros(len(column), bool)
        for s in self.vocabulary.special:
            holds |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(holds).tolist():  # special tokens in a text are words of their own
            t, at, parts = column[i].as_py(), 0, []
            for m in self.cut.finditer(t):
                between = self._plain(*strings(pa.array([t[at : m.start()]])))[0]
                parts += [between, (str(self.vocabulary.special[m[0]]), m[0].encode())]
                at = m.end()
            parts += self._plain(*strings(pa.array([t[at:]])))
            out[i] = ",".join(p[0] for p in parts if p[0]), b"".join(p[1] for p in parts)
        return out


def held_encoder(name: str, vocabulary: Vocabulary, classes: np.ndarray) -> Encoder:
    """One encoder for all tasks of a worker, so that words stay known from task to task."""
    return keep(name, lambda: Encoder(vocabulary, Transducer.load(SparkFiles.get(name)), classes))


def share(lexicon: Transducer, docs: DataFrame) -> str:
    """Hand the lexicon's file to all executors, also to those that come later; returns its name there."""
    path = lexicon.save(tempfile.mkdtemp(prefix="lexicon-"))
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_documents(docs: DataFrame, path: str, size: int = LEXICON_WORDS, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """``keep`` (doc_id, if not given), n_tokens, ids_sha256, decoded_sha256; ``with_text`` adds ``ids`` (array) and ``decoded``.

    Null and empty texts have no tokens and the digests of the empty string. Repeated rows give repeated results, an empty
    table an empty one; other columns are left out.
    """
    vocabulary = Vocabulary.load(path)
    keep = keep or ["doc_id"]
    classes = docs.sparkSession.sparkContext.broadcast(code_point_classes())
    name = share(build_lexicon(docs, vocabulary, classes, size), docs)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the tokenizer's vocabulary: as large as its file, whatever the corpus
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    at = [rows.columns.index(k) for k in keep]
    more = ["ids", "decoded"] if with_text else []

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(name, sent.value, classes.value)
        for batch in it:
            for part, _, _ in slices(batch):
                got = encoder.encode(part.column(part.schema.get_field_index("text")))
                ids, decoded = [g[0] for g in got], [g[1].decode("utf-8", "replace") for g in got]
                out = [
                    pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                ]
                if with_text:
                    out += [pa.array([[int(x) for x in i.split(",")] if i else [] for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *out], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *more])

    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + (["ids array<int>, decoded string"] if with_text else []))
    return rows.mapInArrow(batches, schema)
