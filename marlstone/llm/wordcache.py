"""Byte-level BPE by the tokenizers library at the speed of a table: texts are cut into the tokenizer's words by array operations,
the library encodes each distinct word that a worker meets, and words met before are looked up by a 128-bit digest.

The vocabulary's pattern cuts by letters, numbers, white space and the rest. Which code points belong where is asked of the
library itself, so that both follow one edition of Unicode. A text that contains a special token is encoded by the library as a whole.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Regex, Tokenizer, pre_tokenizers

from marlstone.llm.textbytes import byte_alphabet, span_digest, strings

# The endings that the pattern cuts off after an apostrophe, and the code points that UTF-16 keeps for itself.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
SURROGATES = (0xD800, 0xE000)

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
KNOWN_WORDS = 1 << 20  # words that a worker remembers; then it starts afresh
BYTE_SIGNS = {b: ord(sign) for sign, b in byte_alphabet().items()}


@dataclass(frozen=True)
class Spec:
    """What a worker needs, as large as the tokenizer's file whatever the corpus: that file's text, the class of each code point, special texts."""

    text: str
    classes: np.ndarray
    special: list[str]
    size: int

    @staticmethod
    def load(path: str) -> Spec:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        special = [t["content"] for t in spec["added_tokens"]]
        return Spec(text, code_point_classes(), special, 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))

    def tokenizer(self, plain_specials: bool) -> Tokenizer:
        t = Tokenizer.from_str(self.text)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = plain_specials
        return t

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id; special tokens' own texts, and nothing for ids that are not there."""
        of, spec = byte_alphabet(), json.loads(self.text)
        out = [b""] * self.size
        for t in spec["added_tokens"]:
            out[t["id"]] = t["content"].encode()
        for t, i in spec["model"]["vocab"].items():
            out[i] = out[i] or bytes(of[c] for c in t)
        return out


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of each code point, asked of the library's own patterns."""
    low, high = SURROGATES
    out = np.zeros(0x110000, np.uint8)
    for at in range(0, len(out), 1 << 13):
        points = np.arange(at, at + (1 << 13))
        points = points[(points < low) | (points >= high)]
        if not len(points):
            continue
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            member = np.ones(len(points), bool)
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
                member[a:b] = False
            out[points[member]] = kind
    return out


def cut_words(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The byte at which each word starts; every byte is in a word, and words don't cross texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    if data.max() < 128:
        points, at, first = data, None, off[:-1]
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(at, off[:-1])
        n = len(points)
    first = first[first < n]
    kind = classes[points]
    begins = np.zeros(n + 1, bool)  # of texts; the end counts as one
    begins[first], begins[n] = True, True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last blank of a run that isn't the text's end is a word of its own, or belongs to what follows if it is a plain space
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n])
    start[last] = True
    joined = last[points[last] == 0x20]
    start[joined + 1] = False
    # endings after an apostrophe at which a word starts
    mark = np.flatnonzero((points == 0x27) & start)
    for ending in ENDINGS:
        hit = mark[mark + len(ending) < n]
        for k, sign in enumerate(ending, 1):
            hit = hit[(points[hit + k] == ord(sign)) & ~begins[hit + k]]
        start[hit + 1] = False
        after = hit + len(ending) + 1
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    found = np.flatnonzero(start)
    return found if at is None else at[found]


class WordEncoder:
    """Encodes in a worker. ``plain_specials``: special tokens' strings are ordinary text."""

    SLOTS = 1 << 21  # places of the lookup table; a word may stand in either of two

    def __init__(self, spec: Spec, plain_specials: bool):
        self.spec, self.plain = spec, plain_specials
        self.tokenizer = spec.tokenizer(plain_specials)
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.place = np.full(self.SLOTS, -1, np.int32)
        self.by_key: dict[int, int] = {}
        self.check = np.zeros(0, np.uint64)
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[bytes], keys: np.ndarray, checks: np.ndarray) -> None:
        found = [[t.id for t in self.tokenizer.model.tokenize(w.decode("latin-1").translate(BYTE_SIGNS))] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        base = len(self.count)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))])
        self.count = np.concatenate([self.count, size])
        self.check = np.concatenate([self.check, checks])
        self.by_key.update(zip(keys.tolist(), range(base, base + len(found)), strict=True))

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The known word that each word is; unknown ones are learnt first."""
        one, two = span_digest(data, starts, ends)
        slot_a, slot_b = (one & np.uint64(self.SLOTS - 1)).astype(np.int64), ((one >> np.uint64(24)) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = np.where(self.key[slot_a] == one, self.place[slot_a], np.where(self.key[slot_b] == one, self.place[slot_b], -1))
        miss = np.flatnonzero(out < 0)
        if len(miss):
            keys, at, inverse = np.unique(one[miss], return_index=True, return_inverse=True)
            fresh = np.array([k not in self.by_key for k in keys.tolist()], bool)
            if fresh.any():
                rows = miss[at[fresh]]
                self._learn([data[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)], keys[fresh], two[rows])
            places = np.array([self.by_key[k] for k in keys.tolist()], np.int64)
            for slot in ((keys & np.uint64(self.SLOTS - 1)).astype(np.int64), ((keys >> np.uint64(24)) & np.uint64(self.SLOTS - 1)).astype(np.int64)):
                free = self.place[slot] < 0
                self.key[slot[free]], self.place[slot[free]] = keys[free], places[free]
            out[miss] = places[inverse]
        if (self.check[out] != two).any():
            raise ValueError("two words share one 64-bit hash but not the other")
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the place at which each text's begin (n + 1 entries). Null counts as empty."""
        data, off = strings(column)
        if len(self.count) > KNOWN_WORDS:
            self.forget()
        starts = cut_words(data, off, self.spec.classes)
        if len(starts):
            ends = np.concatenate([starts[1:], [len(data)]])
            place = self._places(data, starts, ends)
            size = self.count[place]
            upto = np.cumsum(size)
            ids = self.flat[np.repeat(self.first[place] - (upto - size), size) + np.arange(upto[-1])]
            begin = np.concatenate([[0], upto])[np.searchsorted(starts, off)]
        else:
            ids, begin = np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        return (ids, begin) if self.plain else self._with_specials(column, ids, begin)

    def _with_specials(self, column: pa.Array, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        holds = np.zeros(len(column), bool)
        for s in self.spec.special:
            holds |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        if not holds.any():
            return ids, begin
        parts = np.split(ids, begin[1:-1])
        for i in np.flatnonzero(holds).tolist():
            parts[i] = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_HELD: dict[tuple[int, bool], WordEncoder] = {}


def encoder(spec: Spec, plain_specials: bool) -> WordEncoder:
    """One encoder for all tasks of a worker, so that words stay known from task to task."""
    key = (hash(spec.text), plain_specials)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = WordEncoder(spec, plain_specials)
    return _HELD[key]
