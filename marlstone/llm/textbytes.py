"""UTF-8 texts of an Arrow batch as one byte buffer: words, hashes and sums without a Python step per word.

Words are maximal runs of bytes other than space and 0x09-0x0D, so a code point is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size; a longer text is a slice of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), 0xD6E8FEB86659FD93, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about ``most`` bytes of text, each with its bytes and offsets."""
    data, off = strings(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at), data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each text (n + 1 entries). Words don't cross texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    cuts = off[:-1][off[:-1] < len(data)]
    before[cuts] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def _span_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each span, and byte by byte its value times a power of its place in the span."""
    lengths = ends - starts
    pos = np.arange(starts[0], ends[-1], dtype=np.int64)
    gaps = np.empty_like(lengths)
    gaps[:-1], gaps[-1] = starts[1:] - starts[:-1], lengths[-1]
    pos -= np.repeat(starts, gaps)
    long = np.repeat(lengths, gaps)
    part = (data[starts[0] : ends[-1]].astype(np.uint64) + np.uint64(1)) * _powers(int(gaps.max()) + 1)[pos]
    part[pos >= long] = 0
    return lengths, part


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are disjoint, not empty and in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths, part = _span_parts(data, starts, ends)
    return mix64(np.add.reduceat(part, starts - starts[0]) ^ (lengths.astype(np.uint64) * _MULT))


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte the integer of the 8 bytes from there on, zeros beyond the end; a view with a stride of one byte."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))


def span_digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span, by eight bytes at a time; the second one mixes them otherwise and so doesn't follow from the first."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    length = ends - starts
    count = (length + 7) >> 3
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    value = eights(data)[np.repeat(starts, count) + (place << 3)]
    rest = (length & 7).astype(np.uint64) * np.uint64(8)
    cut = np.flatnonzero(rest)
    value[(first + count - 1)[cut]] &= (np.uint64(1) << rest[cut]) - np.uint64(1)
    key = (place.astype(np.uint64) + np.uint64(1)) * _MULT
    size = length.astype(np.uint64) * _MULT
    one = np.add.reduceat(mix64(value + key), first)
    two = np.add.reduceat(mix64((value ^ mix64(key)) * np.uint64(0xD6E8FEB86659FD93)), first)
    return mix64(one ^ size), mix64(two + size)


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without the blanks at both ends; one of blanks alone ends where it starts."""
    starts, ends = starts.copy(), ends.copy()
    for at, other, step in ((starts, ends, 1), (ends, starts, -1)):
        live = np.flatnonzero(starts < ends)
        reach = 1
        while len(live):
            # runs of blanks are read in stretches that double, so a long run takes few rounds
            near = np.arange(reach) * step - (step < 0)
            seen = at[live][:, None] + near
            inside = (seen < ends[live][:, None]) & (seen >= starts[live][:, None])
            blank = _SPACE[data[np.clip(seen, 0, len(data) - 1)]] & inside
            run = np.where(blank.all(axis=1), reach, np.argmin(blank, axis=1))
            at[live] += run * step
            live = live[(run == reach) & (starts[live] < ends[live])]
            reach = min(2 * reach, max(1, (1 << 20) // max(len(live), 1)))
    return starts, ends


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` hashes, by its first place; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i; empty runs give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
