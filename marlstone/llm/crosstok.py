"""Alignment of two tokenizers' tokens over the bytes of a text (operator 13).

Both tokenizations of a text are incidence matrices, tokens by bytes, in compressed rows. The product A B^T, made row by row
(Gustavson: the rows of B^T that a row of A picks, added up), holds for each pair of tokens how many bytes they share: the overlap links.
Pairs whose byte ranges end together are the links proper; such ends cut the text into groups. With incidence matrices of
groups by tokens, Ga^T Gb holds the pairs that share a group. Its entries are as many as the groups' token numbers multiply to, which
the row lengths tell without making them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.spool import spool
from marlstone.llm.tables import join_split
from marlstone.llm.textbytes import slices, strings
from marlstone.llm.wordcache import Spec, encoder

BROADCAST_PAIRS = 1 << 22  # distinct linked pairs of ids up to which their counts go to every worker; beyond, a join finds them
HELD_PAIRS = 1 << 20  # distinct pairs after which a counting task hands on what it has
BLANK = "▁"


@dataclass(frozen=True)
class Csr:
    """Compressed rows: row i holds columns ``cols[ptr[i]:ptr[i + 1]]`` with ``vals``."""

    ptr: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    width: int

    @staticmethod
    def runs(sizes: np.ndarray) -> Csr:
        """Row i has ones in the ``sizes[i]`` columns after those of the row before."""
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        return Csr(ptr, np.arange(ptr[-1]), np.ones(ptr[-1], np.int64), int(ptr[-1]))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        count = np.bincount(self.cols, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(count)]), self.rows()[order], self.vals[order], len(self.ptr) - 1)

    def dot(self, other: Csr) -> Csr:
        """The product by Gustavson's rows: each entry of a row picks a row of ``other``; what falls on one column is added up."""
        size = np.diff(other.ptr)[self.cols]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        at = np.arange(total) + np.repeat(other.ptr[self.cols] - (upto - size), size)
        key = np.repeat(self.rows(), size) * other.width + other.cols[at]
        val = np.repeat(self.vals, size) * other.vals[at]
        if total and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        row, col = np.divmod(key[first], max(other.width, 1))
        ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.ptr) - 1))])
        return Csr(ptr, col, np.add.reduceat(val, first) if total else val, other.width)


@dataclass(frozen=True)
class Aligned:
    """A run of texts: token ids and the tokens' places by text (``a_at``, ``b_at``: n + 1 entries), overlap counts, and the links
    (``link_a``, ``link_b``: places of tokens that end together; ``link_at`` by text). ``group_a``, ``group_b``: tokens of each group."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    overlap: Csr
    link_a: np.ndarray
    link_b: np.ndarray
    link_at: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def shared_groups(self) -> Csr:
        """Pairs of tokens that share a group: as many entries as groups have pairs, so only for texts whose groups are small."""
        return Csr.runs(self.group_a).transposed().dot(Csr.runs(self.group_b))


def expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of ``size[i]`` places each, one after another."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class TokenTable:
    """Bytes by id, laid out flat."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[expand(self.first[ids], self.size[ids])]


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, a byte piece its byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(BLANK, " ").encode())
    return out


def same_bytes(table: TokenTable, ids: np.ndarray, at: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text whether its tokens' bytes, joined, are the text's."""
    size = np.concatenate([[0], np.cumsum(table.size[ids])])[at]
    out = np.diff(size) == np.diff(off)
    if out.all():  # the usual case: compared as a whole
        differs = np.flatnonzero(table.joined(ids) != data)
        out[np.searchsorted(off, differs, side="right") - 1] = False
        return out
    for i in np.flatnonzero(out).tolist():
        out[i] = np.array_equal(table.joined(ids[at[i] : at[i + 1]]), data[off[i] : off[i + 1]])
    return out


class Aligner:
    """Both tokenizers in a worker."""

    def __init__(self, spec: Spec, model: bytes):
        self.words = encoder(spec, plain_specials=True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table_a, self.table_b = TokenTable(spec.token_bytes()), TokenTable(piece_bytes(self.pieces))

    def align(self, texts: pa.Array) -> Aligned:
        """Null and empty texts, and those that a tokenizer's tokens don't give back, have no tokens."""
        texts = pc.fill_null(texts, "")
        spaced = pc.binary_join_element_wise(" ", texts, "")
        data, off = strings(spaced)
        a, a_at = self.words.encode(spaced)
        found = self.pieces.encode(texts.to_pylist(), num_threads=1)
        b_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        b = np.fromiter((i for f in found for i in f), np.int64, int(b_at[-1]))
        good = same_bytes(self.table_a, a, a_at, data, off) & same_bytes(self.table_b, b, b_at, data, off) & (np.diff(off) > 1)
        if not good.all():
            size_a, size_b = np.where(good, np.diff(a_at), 0), np.where(good, np.diff(b_at), 0)
            a, b = a[expand(a_at[:-1], size_a)], b[expand(b_at[:-1], size_b)]
            a_at, b_at = np.concatenate([[0], np.cumsum(size_a)]), np.concatenate([[0], np.cumsum(size_b)])
        rows_a, rows_b = Csr.runs(self.table_a.size[a]), Csr.runs(self.table_b.size[b])
        overlap = rows_a.dot(rows_b.transposed())
        over_a, over_b = overlap.rows(), overlap.cols
        together = rows_a.ptr[1:][over_a] == rows_b.ptr[1:][over_b]
        link_a, link_b = over_a[together], over_b[together]
        return Aligned(a, b, a_at, b_at, overlap, link_a, link_b, np.searchsorted(link_a, a_at), np.diff(link_a, prepend=-1), np.diff(link_b, prepend=-1))


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to size - 1, left-aligned, and their number."""
    text = [str(i).encode() for i in range(size)]
    count = np.fromiter(map(len, text), np.int64, size)
    return np.frombuffer(b"".join(t.ljust(int(count.max()), b"\0") for t in text), np.uint8).reshape(size, -1), count


def group_texts(x: Aligned, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of all texts as one byte buffer, each text with a last separator, and the byte at which each begins (n + 1 entries)."""
    sign, count = digits
    ends_a, ends_b = np.cumsum(x.group_a), np.cumsum(x.group_b)
    total = len(x.a) + len(x.b)
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    place_a = np.arange(len(x.a)) + np.repeat(ends_b - x.group_b, x.group_a)
    place_b = np.arange(len(x.b)) + np.repeat(ends_a, x.group_b)
    ids[place_a], ids[place_b] = x.a, x.b
    mark[place_a[ends_a - 1]], mark[place_b[ends_b - 1]] = ord("|"), ord(";")
    size = count[ids]
    end = np.cumsum(size + 1)
    out = np.empty(end[-1] if total else 0, np.uint8)
    first = end - size - 1
    for k in range(sign.shape[1]):
        has = np.flatnonzero(size > k)
        out[first[has] + k] = sign[ids[has], k]
    out[end - 1] = mark
    return out, np.concatenate([[0], end])[x.a_at + x.b_at]


def packed(keys: np.ndarray, counts: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Sorted keys and their counts, small: differences and counts byte by byte of their significance."""
    both = np.concatenate([np.diff(keys, prepend=0), counts]).astype("<u8")
    return pack.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


PARTS = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs binary"


def align_texts(docs: DataFrame, tokenizer: str, model: str) -> tuple[DataFrame, int]:
    """doc_id, row (a number of its own), the counts of each text and its linked pairs of ids, and how many ids B has."""
    spec = Spec.load(tokenizer)
    with open(model, "rb") as f:
        proto = f.read()
    n_b = sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size()
    sent = docs.sparkSession.sparkContext.broadcast((spec, proto))  # both tokenizers' files, whatever the corpus

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pack = Aligner(*sent.value), zstandard.ZstdCompressor(level=1)
        digits = decimals(max(len(aligner.table_a.size), len(aligner.table_b.size)))
        for batch in it:
            for rows, _, _ in slices(batch):
                x = aligner.align(rows.column(2))
                text, at = group_texts(x, digits)
                sha = [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n_links = np.diff(x.link_at)
                # pairs of each text, sorted within it
                doc = np.repeat(np.arange(len(n_links)), n_links)
                key = x.a[x.link_a].astype(np.int64) * n_b + x.b[x.link_b]
                order = np.lexsort((key, doc))
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
                counts, keys = np.diff(first, append=len(key)), key[first]
                cut = np.searchsorted(first, x.link_at)
                pairs = [packed(keys[s:e], counts[s:e], pack) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                shared = np.concatenate([[0], np.cumsum(x.group_a * x.group_b)])[x.link_at]
                cols = [rows.column(0), rows.column(1), *map(pa.array, (np.diff(x.a_at), np.diff(x.b_at), n_links, n_links, np.diff(shared))), pa.array(sha, pa.string()), pa.array(pairs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs"])

    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("`text`").alias("text"))
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, {PARTS}"), n_b


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best) of every linked pair of ids: its links in the corpus, and whether no other pair of its B id has more."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = (np.concatenate([p[i] for p in [(keys, counts), *waiting]]) for i in (0, 1))
            waiting.clear()
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            return k[first], np.add.reduceat(c, first) if len(k) else c

        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
        for batch in it:
            for raw in batch.column(0):
                waiting.append(unpacked(raw.as_py()))
                size += len(waiting[-1][0])
                if size > HELD_PAIRS:
                    (keys, counts), size = merged(), 0
                    if len(keys) > HELD_PAIRS:
                        yield out()
                        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = merged()
        yield out()

    total = spool(aligned.select("pairs").mapInArrow(batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    total = total.withColumn("b", F.pmod("pair", F.lit(n_b)))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """n_best and count_sum by a table of all pairs in every worker; its size is bounded by ``BROADCAST_PAIRS``."""
    table = pairs.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in it:
            found = [unpacked(raw.as_py()) for raw in batch.column(batch.num_columns - 1)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k, _ in found])]).astype(np.int64)
            at = np.searchsorted(pair, np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)]))
            c = np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)])
            run = lambda v: np.concatenate([[0], np.cumsum(v)])[ends]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(run(c * best[at]))), pa.array(np.diff(run(c * n[at])))], names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    return aligned.drop("row").mapInArrow(batches, f"doc_id {kind}, " + PARTS.replace("pairs binary", "n_best long, count_sum long"))


def _joined(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by a join on the pairs, frequent ones split; texts without links keep zeros."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k, c = unpacked(raw.as_py())
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row, np.int64)), pa.array(k), pa.array(c)], names=["row", "pair", "c"])

    links = aligned.select("row", "pairs").mapInArrow(batches, "row long, pair long, c long")
    sums = join_split(links, pairs, ["pair"], "n").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("n_best"), F.sum(F.col("c") * F.col("n")).alias("count_sum"))
    return aligned.drop("pairs").join(sums, "row", "left").drop("row").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def align_documents(docs: DataFrame, tokenizer: str, model: str, most_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_shared (pairs of tokens that share a group) of every text.

    Null and empty texts and those whose tokens don't join to the text with a space before it have zeros and an empty groups_sha256.
    Repeated rows each count and each have their row; an empty table gives no rows; other columns are left out. ``most_pairs`` decides
    how counts reach the texts, not what they are.
    """
    rows, n_b = align_texts(docs, tokenizer, model)
    aligned = spool(rows, "aligned")
    pairs = spool(pair_counts(aligned, n_b), "pairs")
    kind = aligned.schema["doc_id"].dataType.simpleString()
    out = _looked_up(aligned, pairs, kind) if pairs.count() <= most_pairs else _joined(aligned, pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
