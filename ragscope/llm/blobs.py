"""Arrays packed into one compressed blob: many keyed numbers travel as one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.itemsize, len(a))]], dtype="<i4")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack_arrays(blob: bytes, *dtypes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(data, "<i4", 1)[0])
    sizes = np.frombuffer(data, "<i4", 2 * count, 4).reshape(-1, 2)
    at, out = 4 * (1 + 2 * count), []
    for (_, n), d in zip(sizes.tolist(), dtypes, strict=True):
        out.append(np.frombuffer(data, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def split_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the positions that have it."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(key[part[0]]), part


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], .., start[0] + count[0] - 1, start[1], .."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(before - start, count)
