"""A Bloom filter of fixed size, built by Spark and sent to tasks before a shuffle join.

It only spares the shuffle rows that cannot join; the join behind it decides, so
results do not depend on how full it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ragscope.llm.blobs import pack_arrays, unpack_arrays
from ragscope.llm.words import mix

#: Bits of a filter (16 MB) and positions set for a key; fewer than one key in a thousand
#: passes wrongly up to about ten million keys.
BITS, HASHES = 1 << 27, 4
_SLOT = 1 << 16


class Bloom:
    def __init__(self, data: np.ndarray | None = None):
        self.data = np.zeros(BITS >> 3, np.uint8) if data is None else data

    @staticmethod
    def _places(keys: np.ndarray) -> list[np.ndarray]:
        h = mix(keys.astype(np.int64).view(np.uint64))
        step = mix(h) | np.uint64(1)
        return [((h + np.uint64(i) * step) >> np.uint64(37)).astype(np.int64) for i in range(HASHES)]

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self._places(keys):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of a frame's only column (integers)."""
    name = keys.columns[0]

    def build(batches):
        own = Bloom()
        for batch in batches:
            own.add(batch.column(name).drop_null().to_numpy(zero_copy_only=False))
        parts = [(i, p) for i, p in enumerate(np.split(own.data, len(own.data) // _SLOT)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([pack_arrays(p) for _, p in parts], pa.binary())], names=["slot", "part"])

    def unite(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([unpack_arrays(x, "u1")[0] for x in table.column("part").to_pylist()])
        return pa.table([table.column("slot")[:1], pa.array([pack_arrays(total)], pa.binary())], names=["slot", "part"])

    out = Bloom()
    for row in keys.mapInArrow(build, "slot int, part binary").groupBy("slot").applyInArrow(unite, "slot int, part binary").collect():
        out.data[row.slot * _SLOT: (row.slot + 1) * _SLOT] = unpack_arrays(row.part, "u1")[0]
    return out
