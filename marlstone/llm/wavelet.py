"""Token ids of a corpus as one wavelet matrix per shard (operator 12).

Documents are dealt by ranges of their ids, sorted, encoded and written in order; a shard file holds a run of documents. Each
bit of an id has a plane: the first plane has the top bits in order of the tokens, every further one the next bits after a
stable split by the bit before. With the number of ones before each block of a plane a file answers access (the id at a
place), rank and counting (how often an id stands before a place), and select (where it stands for the k-th time) by reading one
block per plane. Blocks are compressed one by one.

Shard file: the magic bytes, the length of a JSON header, the header, then its sections, all numbers little-endian.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.spool import shared_dir, spool
from marlstone.llm.textbytes import SLICE_BYTES, slices
from marlstone.llm.wordcache import Spec, encoder

MAGIC = b"MSWAVE01"
BLOCK = 1 << 13  # bytes of a plane that are compressed together
SHARD_TOKENS = 1 << 22  # a shard ends with the run of documents that reaches so many ids
END = 0  # the id after each document


class Shard:
    """One shard file's contents: ``n`` ids, documents with their ids and ends, planes to look into. ``data``: bytes, or a memory map."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(bytes(data[16 : 16 + size]))
        self._data, self._base = data, 16 + size
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self._at = head["sections"]
        self._block = lru_cache(256)(self._read_block)

    @staticmethod
    def build(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, bits: int) -> bytes:
        """``ends``: the ids up to and with each document's last; ``known``: where a document has an id at all."""
        pack = zstandard.ZstdCompressor(level=1)
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        body, sections, zeros, at = [], {}, [], 0

        def add(name: str, raw: bytes) -> None:
            nonlocal at
            sections[name] = (at, len(raw))
            body.append(raw)
            at += len(raw)

        for level in range(bits):
            one = (rest >> (bits - 1 - level) & 1).astype(bool)
            plane = np.packbits(one, bitorder="little")
            blocks = [pack.compress(plane[k : k + BLOCK].tobytes()) for k in range(0, len(plane), BLOCK)]
            ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
            add(f"ones{level}", np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes())
            add(f"where{level}", np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8").tobytes())
            add(f"plane{level}", b"".join(blocks))
            zeros.append(int(len(rest) - ones.sum()))
            rest = np.concatenate([rest[np.flatnonzero(~one)], rest[np.flatnonzero(one)]])  # places, as masks branch at every id
        for name, a in (("ends", np.diff(ends, prepend=0).astype("<i8")), ("docs", np.diff(doc_ids, prepend=0).astype("<i8")), ("known", known.astype(np.uint8))):
            add(name, pack.compress(a.tobytes()))
        head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "sections": sections}).encode()
        return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])

    def _section(self, name: str) -> bytes:
        at, size = self._at[name]
        return bytes(self._data[self._base + at : self._base + at + size])

    @lru_cache(None)  # noqa: B019 (directories are small, and a shard is short-lived)
    def _table(self, name: str) -> np.ndarray:
        return np.frombuffer(self._section(name), "<i8")

    def _read_block(self, level: int, k: int) -> np.ndarray:
        where = self._table(f"where{level}")
        at = self._base + self._at[f"plane{level}"][0]
        return np.frombuffer(zstandard.decompress(bytes(self._data[at + int(where[k]) : at + int(where[k + 1])])), np.uint8)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, known, ends) of the documents, in order."""
        load = lambda name, kind: np.frombuffer(zstandard.decompress(self._section(name)), kind)
        return np.cumsum(load("docs", "<i8")), load("known", np.uint8).astype(bool), np.cumsum(load("ends", "<i8"))

    def _ones(self, level: int, place: int) -> int:
        """Ones of a plane before a place."""
        k, byte = divmod(place >> 3, BLOCK)
        total = int(self._table(f"ones{level}")[k])
        if byte or place & 7:
            block = self._block(level, k)
            total += int(np.bitwise_count(block[:byte]).sum())
            if place & 7:
                total += (int(block[byte]) & ((1 << (place & 7)) - 1)).bit_count()
        return total

    def _bit(self, level: int, place: int) -> int:
        k, byte = divmod(place >> 3, BLOCK)
        return int(self._block(level, k)[byte]) >> (place & 7) & 1

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, place), self._ones(level, place)
            place = self.zeros[level] + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the last split has put the id's occurrences among the places [low, high)."""
        for level in range(self.bits):
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + self._ones(level, low), self.zeros[level] + self._ones(level, high)
            else:
                low, high = low - self._ones(level, low), high - self._ones(level, high)
            if low == high:
                break
        return low, high

    def rank(self, token: int, place: int) -> int:
        """How often an id stands before a place."""
        if token < 0 or token >> self.bits:
            return 0
        low, high = self._range(token, 0, min(max(place, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind in a plane: its block by the directory, then the place in it."""
        ones = self._table(f"ones{level}")
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK * 8, self.n) - ones
        b = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, b), bitorder="little")[: self.n - b * BLOCK * 8]
        return b * BLOCK * 8 + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def select(self, token: int, k: int) -> int:
        """The place at which an id stands for the k-th time, from 0."""
        if token < 0 or token >> self.bits or not 0 <= k < self.count(token):
            raise IndexError(k)
        low, _ = self._range(token, 0, self.n)
        at = low + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, in order; a plane at a time, from the last split back."""
        total = self.count(token)
        if not total:
            return np.zeros(0, np.int64)
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high)
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            at = np.flatnonzero(self._plane(level) == bit)[at - self.zeros[level] if bit else at]
        return at

    def _plane(self, level: int) -> np.ndarray:
        where = self._table(f"where{level}")
        packed = [self._read_block(level, k) for k in range(len(where) - 1)]
        return np.unpackbits(np.concatenate(packed), bitorder="little", count=self.n).astype(bool) if packed else np.zeros(0, bool)

    def decode(self) -> np.ndarray:
        """All ids in order: splits are undone from the last plane on."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            one = self._plane(level)
            before = np.empty_like(out)
            before[np.flatnonzero(~one)] = out[: self.zeros[level]]
            before[np.flatnonzero(one)] = out[self.zeros[level] :] | out.dtype.type(1 << (self.bits - 1 - level))
            out = before
        return out


def open_shard(uri: str) -> Shard:
    """A shard file of any file system that Arrow knows; local ones are mapped, so that only the blocks asked for are read."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return Shard(np.memmap(path, np.uint8, "r"))
    with fs.open_input_file(path) as f:
        return Shard(f.read())


def write_shard(uri: str, data: bytes) -> None:
    """Written under another name and then moved: a task that runs twice leaves one whole file, the same in both cases."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts and write the shard files; returns (part, shard, file, docs, tokens, before): ``before`` counts the ids of all earlier shards.

    Documents are in ascending order of doc_id, those without one first; rows that share an id by a hash of the text, and
    equal rows as they come. A range of equal ids can be cut anywhere, so a frequent id doesn't fall on one task.
    """
    spark = docs.sparkSession
    spec = Spec.load(tokenizer)
    sent = spark.sparkContext.broadcast(spec)
    bits = max(1, (spec.size - 1).bit_length())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(sent.value, plain_specials=False), TaskContext.get().partitionId()
        held: list[tuple] = []
        made = 0

        def close() -> pa.RecordBatch:
            nonlocal made
            ids, sizes, names = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
            known = np.concatenate([h[3] for h in held])
            held.clear()
            file = f"{folder}/shard-{part:06d}-{made:05d}.wave"
            write_shard(file, Shard.build(ids, np.cumsum(sizes), names, known, bits))
            made += 1
            row = [[part], [made - 1], [file], [len(sizes)], [len(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "shard", "file", "docs", "tokens"])

        for batch in it:
            for rows, _, _ in slices(batch, most=min(SLICE_BYTES, 2 * shard_tokens)):
                ids, begin = enc.encode(rows.column(1))
                ids = np.insert(ids, begin[1:], END).astype(np.int32)
                name = rows.column(0).cast(pa.int64())
                held.append((ids, np.diff(begin) + 1, name.fill_null(0).to_numpy(), name.is_valid().to_numpy(zero_copy_only=False)))
                if sum(len(h[0]) for h in held) >= shard_tokens:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")).withColumn("h", F.xxhash64("text")).withColumn("k", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("k")]
    manifest = spool(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(batches, "part int, shard int, file string, docs long, tokens long"), "shards")
    # ids of the parts before, one row a part, then of the shards before in the part
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    return manifest.join(ahead, "part").select("part", "shard", "file", "docs", "tokens", (F.col("ahead") + own).alias("before"))


def _each_shard(manifest: DataFrame, of, schema: str) -> DataFrame:
    """``of(shard, before)`` of every file, a table of columns each; tasks get whole files, few of them however small the list of files is."""
    context = manifest.sparkSession.sparkContext
    tasks = min(max(manifest.count(), 1), 4 * max(context.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield of(open_shard(file), before)

    return manifest.select("file", "before").repartition(tasks).mapInArrow(batches, schema)


def token_positions(manifest: DataFrame, token: int) -> DataFrame:
    """(doc_id, place, start): every occurrence of an id, by its place in the document and in the corpus; only planes' blocks are read, no text."""

    def of(shard: Shard, before: int) -> pa.RecordBatch:
        at = shard.occurrences(token)
        names, known, ends = shard.documents()
        doc = np.searchsorted(ends, at, side="right")
        begin = np.concatenate([[0], ends])[doc]
        return pa.RecordBatch.from_arrays([pa.array(names[doc], pa.int64(), mask=~known[doc]), pa.array(at - begin), pa.array(at + before)], names=["doc_id", "place", "start"])

    return _each_shard(manifest, of, "doc_id long, place long, start long")


def token_count(manifest: DataFrame, token: int) -> int:
    """How often an id stands in the corpus: two ranks a plane and shard."""
    of = lambda shard, before: pa.RecordBatch.from_arrays([pa.array([shard.count(token)], pa.int64())], names=["n"])
    return _each_shard(manifest, of, "n long").agg(F.sum("n")).first()[0] or 0


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def of(shard: Shard, before: int) -> pa.RecordBatch:
        ids = shard.decode().astype("<u4")
        names, known, ends = shard.documents()
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64(), mask=~known), pa.array(begin + before), pa.array(ends - begin), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _each_shard(manifest, of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def index_documents(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Write the corpus as shard files in ``folder`` (in the shared folder, if not given) and read each document's place and checksum back.

    Null and empty texts have the end id alone. Repeated rows are documents of their own; rows without an id come first and keep none. An
    empty table writes no file and returns no rows. Other columns are left out. doc_id must be an integer.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    return read_documents(write_shards(docs, tokenizer, folder, shard_tokens))
