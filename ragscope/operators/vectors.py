"""Vector tables as packed blocks that meet in tasks, for exact top-k search.

Queries are packed into blocks and index rows into parts of bounded size, one row
each; a task holds one block and one part.  A search has two rounds: every block
meets its home part first, which gives each query a k-th score; then it meets the
other parts and takes those scores along, so a part returns only rows that can still be
among the best.  Nothing passes through the driver but counts.

Rows of a part may be in cells of near vectors.  A cell's centre c and radius r bound
the score of every row x in it: q.x <= q.c + |q| r, and |q - x| >= |q - c| - r.  In a
task the cells are visited in the order of their bounds, each by the queries whose
k-th score does not beat its bound yet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragscope.operators.ordering import written

METRICS = ("cosine", "ip", "l2")
#: Relative room for rounding when a bound is held against a score.
SLACK = 1e-9
#: Queries and rows whose scores a task holds at once.
SCAN_QUERIES, SCAN_ROWS = 1024, 2048
#: Blocks, and parts, that a table is cut into, while each stays between the least and ``MOST_BYTES``: what meets in
#: tasks is then this many times the table, and not its square.
GRID, MOST_BYTES = 12, 32 << 20
HITS = "query_id long, doc_id long, score double, visited int"


@dataclass
class Pack:
    """Ids and vectors (unit ones for cosine), sorted by cell, and where each cell starts."""

    ids: np.ndarray
    m: np.ndarray
    first: np.ndarray  # of each cell, and the end
    centre: np.ndarray
    radius: np.ndarray
    given: np.ndarray  # the vectors as they came, in which they travel: floats of 32 bits where those hold them exactly

    @staticmethod
    def of(table: pa.Table, metric: str) -> Pack:
        ids, cell = table.column("id").to_numpy(), table.column("cell").to_numpy()
        v = table.column("v").combine_chunks()
        given = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((ids, cell))
        ids, cell, given = ids[order], cell[order], given[order]
        with np.errstate(over="ignore"):
            short = given.astype(np.float32)
        given = short if np.array_equal(short, given, equal_nan=True) else given
        m = Pack.rows(given, metric)
        first = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(ids))
        centre = np.add.reduceat(m, first[:-1], axis=0) / np.diff(first)[:, None]
        away = np.sqrt(((m - np.repeat(centre, np.diff(first), axis=0)) ** 2).sum(axis=1))
        return Pack(ids, m, first, centre, np.maximum.reduceat(away, first[:-1]), given)

    @staticmethod
    def rows(given: np.ndarray, metric: str) -> np.ndarray:
        m = given.astype(np.float64)
        return unit(m) if metric == "cosine" else m

    def blob(self) -> bytes:
        sizes = np.array([len(self.ids), self.given.shape[1], len(self.radius), self.given.dtype.itemsize], np.int64)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (sizes, self.ids.astype(np.int64), self.first.astype(np.int64), self.centre, self.radius, self.given))

    @staticmethod
    def read(blob: bytes, metric: str | None = None) -> Pack:
        """Without ``metric`` the vectors stay as they came."""
        n, d, c, width = np.frombuffer(blob, np.int64, 4).tolist()
        at, out = 32, []
        for kind, shape in ((np.int64, (n,)), (np.int64, (c + 1,)), (np.float64, (c, d)), (np.float64, (c,)), (np.float32 if width == 4 else np.float64, (n, d))):
            count = int(np.prod(shape))
            out.append(np.frombuffer(blob, kind, count, at).reshape(shape))
            at += np.dtype(kind).itemsize * count
        ids, first, centre, radius, given = out
        return Pack(ids, given if metric is None else Pack.rows(given, metric), first, centre, radius, given)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays zero and is similar to nothing."""
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def products(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Higher is better for every metric (l2: the negated squared distance)."""
    s = q @ d.T
    if metric == "l2":
        s = 2 * s - (q * q).sum(1)[:, None] - (d * d).sum(1)[None, :]
    return s


def scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Rounded to 12 places, so that equal vectors tie wherever they lie."""
    return np.round(products(q, d, metric), 12)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """For each query and cell a score that no row of the cell exceeds."""
    if metric == "l2":
        away = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (centre * centre).sum(1)[None, :] - 2 * q @ centre.T))
        out = -np.maximum(0, away * (1 - SLACK) - radius[None, :]) ** 2
    else:
        out = q @ centre.T + np.linalg.norm(q, axis=1)[:, None] * radius[None, :]
    return out + SLACK * (1 + np.abs(out))


def scan(q: Pack, part: Pack, k: int, metric: str, exclude_self: bool, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the part's best k rows for each query that may be among its best, and
    how many cells each query visited; ``known``: scores that a query's k-th best reaches."""
    n = len(q.ids)
    ids, got = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)  # the hits of each query, the best first
    best, visited = known.copy(), np.zeros(n, np.int32)
    above = bounds(q.m, part.centre, part.radius, metric)
    for c in np.argsort(-above.max(axis=0), kind="stable").tolist():
        asked = np.flatnonzero(above[:, c] >= best)
        visited[asked] += 1
        for a in range(0, len(asked), SCAN_QUERIES):
            ask = asked[a : a + SCAN_QUERIES]
            for b in range(int(part.first[c]), int(part.first[c + 1]), SCAN_ROWS):
                own = slice(b, min(b + SCAN_ROWS, int(part.first[c + 1])))
                s = products(q.m[ask], part.m[own], metric)
                if exclude_self:
                    s[q.ids[ask][:, None] == part.ids[own][None, :]] = -np.inf
                floor = best[ask]
                new = np.flatnonzero(floor == -np.inf)
                if len(new) and s.shape[1] > k:
                    floor[new] = np.partition(s[new], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                # only what may reach the floor is rounded, which moves a score by half a place at most
                i, j = np.nonzero(s >= (floor - 1e-12 - SLACK * SLACK - 1e-15 * np.abs(np.where(np.isfinite(floor), floor, 0)))[:, None])
                found = np.round(s[i, j], 12)
                ok = (found >= best[ask[i]]) & (found > -np.inf)
                i, j, found = i[ok], j[ok], found[ok]
                if not len(i):
                    continue
                some = np.unique(i)
                held = ask[some]
                at = np.concatenate([np.repeat(held, k), ask[i]])
                all_ids, all_got = np.concatenate([ids[held].ravel(), part.ids[own][j]]), np.concatenate([got[held].ravel(), found])
                order = np.lexsort((all_ids, -all_got, at))
                at, all_ids, all_got = at[order], all_ids[order], all_got[order]
                keep = np.searchsorted(at, held)[:, None] + np.arange(k)
                ids[held], got[held] = all_ids[keep], all_got[keep]
                best[held] = np.maximum(best[held], got[held, k - 1])
    at, place = np.nonzero(got > -np.inf)
    return at, ids[at, place], got[at, place], visited


def cut_at(total: int, least: int, most: int) -> int:
    """The size of a block or part of a table of ``total`` (bytes or rows)."""
    return max(least, min(most, -(-total // GRID)))


def packed(rows: DataFrame, name: str, metric: str) -> DataFrame:
    """(name, blob): the rows of each number packed; ``rows``: name, id, v, cell."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table([table.column(name)[:1], pa.array([Pack.of(table, metric).blob()], pa.binary())], names=[name, name + "_blob"])

    return rows.groupBy(name).applyInArrow(run, f"{name} int, {name}_blob binary")


def met(blocks: DataFrame, parts: DataFrame, pairs: DataFrame, k: int, metric: str, exclude_self: bool, known: DataFrame | None = None) -> DataFrame:
    """The hits of each pair of a block and a part, and a row without hit for the cells that a query visited.
    ``known``: (block, floor), the k-th scores that a block's queries have reached."""
    left = pairs.join(blocks, "block")
    if known is not None:
        left = left.join(known, "block", "left")
    left = left if known is not None else left.withColumn("floor", F.lit(None).cast("binary"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.int32())], names=["query_id", "doc_id", "score", "visited"])
        q, part, floor = Pack.read(a.column("block_blob")[0].as_py(), metric), Pack.read(b.column("part_blob")[0].as_py(), metric), a.column("floor")[0].as_py()
        reached = np.full(len(q.ids), -np.inf) if floor is None else np.frombuffer(floor, np.float64)
        at, ids, got, visited = scan(q, part, k, metric, exclude_self, reached)
        n = len(q.ids)
        return pa.table([pa.array(np.concatenate([q.ids[at], q.ids]), pa.int64()), pa.array(np.concatenate([ids, np.zeros(n, np.int64)]), pa.int64(), mask=np.arange(len(at) + n) >= len(at)),
                         pa.array(np.concatenate([got, np.zeros(n)]), pa.float64(), mask=np.arange(len(at) + n) >= len(at)),
                         pa.array(np.concatenate([np.zeros(len(at), np.int32), visited]), pa.int32())], names=["query_id", "doc_id", "score", "visited"])

    mine = pairs.select(F.col("block").alias("to"), F.col("part").alias("from"))
    right = parts.join(mine, F.col("part") == F.col("from")).select(F.col("to").alias("block"), F.col("from").alias("part"), "part_blob")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, HITS)


def floors(hits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(block, floor): the k-th scores that each block's queries have reached (-inf: fewer hits)."""
    kth = best(hits, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth")).where("kth IS NOT NULL")

    def queries(batches):
        for batch in batches:
            for number, blob in zip(batch.column("block").to_pylist(), batch.column("block_blob").to_pylist(), strict=True):
                ids = Pack.read(blob).ids
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int32()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64())], names=["block", "place", "query_id"])

    def pack(table: pa.Table) -> pa.Table:
        out = np.full(table.num_rows, -np.inf)
        out[table.column("place").to_numpy()] = table.column("kth").fill_null(-np.inf).to_numpy()
        return pa.table([table.column("block")[:1], pa.array([out.tobytes()], pa.binary())], names=["block", "floor"])

    own = blocks.mapInArrow(queries, "block int, place int, query_id long")
    return own.join(kth, "query_id", "left").select("block", "place", "kth").groupBy("block").applyInArrow(pack, "block int, floor binary")


def best(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best hits, ties by the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return hits.where("doc_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def two_rounds(blocks: DataFrame, parts: DataFrame, first: DataFrame, rest, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """Hits of the ``first`` pairs and of ``rest(known)``, the pairs that the scores known after them leave."""
    hits = written(met(blocks, parts, first, k, metric, exclude_self), "hits")
    known = written(floors(hits, blocks, k), "floors")
    return hits.unionByName(met(blocks, parts, rest(known), k, metric, exclude_self, known))
