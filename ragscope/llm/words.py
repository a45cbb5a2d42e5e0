"""Words of whole texts as numpy arrays, for use inside tasks.

A slice of an Arrow batch is tokenised in one go: byte positions of word
starts and ends, the document each word belongs to, and a 64-bit hash of each
word's bytes.  Only ASCII separators are used, so working on UTF-8 bytes gives
the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text handled at a time inside a task (a longer document is a slice of its own).
SLICE_BYTES = 4 << 20
_LONG = 2048  # bytes from which a span is hashed on its own

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_S29 = np.uint64(29)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def class_table(separators: bytes) -> np.ndarray:
    """Lookup by byte: True for a byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Words are runs of anything but ASCII white space.
NON_SPACE = class_table(WHITE)
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LINE = class_table(b"\n")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = (h ^ (h >> _S32)) * _C1
    h = (h ^ (h >> _S29)) * _C2
    return h ^ (h >> _S32)


def text_column(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes of all spans at a time."""
    length = end - start
    h = mix(length.astype(np.uint64) + np.uint64(seed) * _C2 + _C1)
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    at, rest, where = start, length, None
    long = np.flatnonzero(length > _LONG)
    if len(long):
        where = np.flatnonzero(length <= _LONG)
        at, rest = start[where], length[where]
    while len(at):
        part = (h if where is None else h[where]) ^ ((eight[at] & _KEEP[np.minimum(rest, 8)]) * _C2)
        part = (part ^ (part >> _S32)) * _C1
        part ^= part >> _S29
        if where is None:
            h = part
        else:
            h[where] = part
        more = rest > 8
        where = np.flatnonzero(more) if where is None else where[more]
        at, rest = at[more] + 8, rest[more] - 8
    for i in long:
        h[i] = np.uint64(xxhash.xxh3_64_intdigest(data[start[i]: end[i]].tobytes(), seed=seed))
    return mix(h)


@dataclass
class Words:
    """Words of a slice of documents; ``first[i]:first[i + 1]`` are those of document i."""

    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # byte range of document i is offsets[i]:offsets[i + 1]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs, dtype=np.int64), self.count)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)

    def room(self, n: int) -> np.ndarray:
        """Positions at which n consecutive words of one document start."""
        if len(self.start) < n:
            return np.zeros(0, dtype=np.int64)
        last = np.repeat(self.first[1:], self.count)
        return np.flatnonzero(np.arange(len(self.start)) + n <= last)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]: self.end[i]].tobytes()


def find_words(texts: pa.Array | pa.ChunkedArray, table: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """Words of each text (null: none)."""
    arr = text_column(texts)
    n = len(arr)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=n + 1 + arr.offset)[arr.offset:] if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    if lower:
        data = LOWER[data]
    inside = table[data]
    size = len(data)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < size)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def ngram_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions from ``Words.room``)."""
    h = np.full(len(at), n * int(_C2) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j in range(n):
        h = h * _C1 + hashes[at + j]
    return mix(h)


def covered(at: np.ndarray, length: np.ndarray | int, size: int) -> np.ndarray:
    """True for each of ``size`` positions that a span [at, at + length) covers."""
    depth = np.bincount(at, minlength=size + 1) - np.bincount(at + length, minlength=size + 1)
    return np.cumsum(depth)[:size] > 0


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags are set within each document's positions."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over keys: occurs twice or more; occurs at an earlier position too."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, many = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later
