"""Hard negatives by spanning-tree bounds over the anchors.

For each anchor the nearest rows of its own label are its positives; for each
positive, the highest-scoring rows of other labels whose score lies in a window
below the positive's are its hard negatives.  Scores are integer inner products
of quantised vectors, so ranks and windows are exact.

Anchors are put in blocks; a block's anchors form a minimum spanning tree by
Euclidean distance.  A block meets a part of the candidate rows in one task: the
root's scores are computed for every candidate; along an edge of length e a
child's score with candidate c lies within e * |c| of its parent's, so each
candidate has an interval for each anchor, and only those whose interval reaches
the window (the best few of the same label; between the bounds for negatives)
are scored again.  Where that is most of a part, the whole part is scored, which makes
the next bounds tight.

Jobs: (1) one row for each id, written; (2) packed parts of candidates and blocks
of anchors, written; (3) blocks against parts: the best of the same label, merged
by rank; (4) blocks with their windows against parts, merged by rank.  A stated
set of anchors meets all rows in blocks: a task holds one block and one part, of
fixed size whatever the labels and vectors are.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; rows that repeat an id are one (the least label, then
vector); ties rank by smaller id; a shorter vector counts as filled up with zeros;
an anchor with fewer rows in reach gives fewer rows; a positive with a negative score
has an empty window; an empty table gives no rows; other columns are ignored.
Scores have to fit a long (an overflow is an error).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragscope.llm.blobs import pack_arrays, unpack_arrays
from ragscope.llm.jobs import saved

POSITIVES, NEGATIVES = 5, 3
#: The window, in per cent of the positive's score.
LOW, HIGH = 50, 95
SCALE = 256
#: Candidate rows of a part, anchors of a block.
PART, BLOCK = 8192, 512
#: Share of a part from which all of it is scored.
MOST = 0.25


# -- vectors -----------------------------------------------------------------------------

def _matrix(table: pa.Table) -> np.ndarray:
    """The rows' vectors, shorter ones filled up with zeros."""
    col = table.column("q").combine_chunks()
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """As floats where every inner product is an exact float, else as Python integers; all with the same width."""
    width = max(m.shape[1] for m in matrices)
    top = max([1, *(int(np.abs(m).max()) for m in matrices if m.size)])
    kind = np.float64 if top * top * max(width, 1) < 1 << 53 else object
    return [np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(kind) for m in matrices]


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1).astype(np.float64)) * (1 + 1e-9)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): the rows with parents first, each one's parent (as a row; the root its own)
    and the distance to it, rounded up."""
    v = vectors.astype(np.float64)
    n = len(v)
    parent, best, out = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, dtype=bool)
    order, length, at = [0], np.zeros(n), 0
    out[0] = True
    for _ in range(n - 1):
        near = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        closer = ~out & (near < best)
        best[closer], parent[closer] = near[closer], at
        at = int(np.argmin(np.where(out, np.inf, best)))
        out[at], length[at] = True, best[at] * (1 + 1e-9)
        order.append(at)
    return np.array(order), parent, length


class Tree:
    """A block's anchors, parents first, walked with the intervals of a part's scores."""

    def __init__(self, blob: bytes):
        self.ids, self.labels, self.parent, self.length, flat = unpack_arrays(blob, "<i8", "<i8", "<i8", "<f8", "<i8")
        self.vectors = flat.reshape(len(self.ids), -1)

    @staticmethod
    def pack(table: pa.Table) -> bytes:
        ids, labels, m = table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table)
        order, parent, length = spanning_tree(m)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pack_arrays(ids[order].astype("<i8"), labels[order].astype("<i8"), place[parent[order]].astype("<i8"), length[order].astype("<f8"), m[order].astype("<i8").ravel())

    def walk(self, rows: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, their scores): ``wanted(anchor, lo, hi)`` tells which candidates'
        intervals reach what is looked for; those are scored."""
        rows, anchors = _exact(rows, self.vectors)
        norms = _norms(rows)
        waiting = np.bincount(self.parent[1:], minlength=len(self.ids))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for a in range(len(self.ids)):
            if a:
                up = int(self.parent[a])
                reach = self.length[a] * norms + 1
                lo, hi = known[up][0] - reach, known[up][1] + reach
                waiting[up] -= 1
                if not waiting[up]:
                    del known[up]
                at = np.flatnonzero(wanted(a, lo, hi))
            if not a or len(at) > MOST * len(rows):
                lo = hi = rows @ anchors[a]
                at = np.flatnonzero(wanted(a, lo, hi))
                scores = lo[at]
            else:
                scores = rows[at] @ anchors[a]
                lo[at] = hi[at] = scores.astype(np.float64)
            if waiting[a]:
                known[a] = (lo.astype(np.float64), hi.astype(np.float64))
            yield a, at, scores


class Part:
    """Candidate rows of a part."""

    def __init__(self, blob: bytes):
        self.ids, self.labels, flat = unpack_arrays(blob, "<i8", "<i8", "<i8")
        self.vectors = flat.reshape(len(self.ids), -1)

    @staticmethod
    def pack(table: pa.Table) -> bytes:
        return pack_arrays(table.column("id").to_numpy().astype("<i8"), table.column("label").to_numpy().astype("<i8"), _matrix(table).astype("<i8").ravel())


def best_same(tree: Tree, part: Part, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): the part's first k rows of the anchor's label, itself left out."""

    def wanted(a, lo, hi):
        own = (part.labels == tree.labels[a]) & (part.ids != tree.ids[a])
        low = lo[own]
        return own & (hi >= np.partition(low, len(low) - k)[len(low) - k]) if len(low) > k else own

    for a, at, scores in tree.walk(part.vectors, wanted):
        first = np.lexsort((part.ids[at], -scores))[:k]
        yield a, at[first], scores[first]


def best_between(tree: Tree, part: Part, windows: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window number, rows, scores): the part's first k rows of other labels with a score in the window."""

    def wanted(a, lo, hi):
        out = np.zeros(len(part.ids), dtype=bool)
        for low, high in windows[a]:
            out |= (hi >= low) & (lo <= high)
        return out & (part.labels != tree.labels[a])

    for a, at, scores in tree.walk(part.vectors, wanted):
        order = np.lexsort((part.ids[at], -scores))
        at, scores = at[order], scores[order]
        for j, (low, high) in enumerate(windows[a]):
            first = np.flatnonzero((scores <= high) & (scores >= low))[:k]
            if len(first):
                yield a, j, at[first], scores[first]


# -- jobs ----------------------------------------------------------------------------------

def _packed(rows: DataFrame, name: str, count: int, pack) -> DataFrame:
    """Rows dealt by a hash of their id to ``count`` packages, one row each."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table([table.column(name)[:1], pa.array([pack(table)], pa.binary())], names=[name, name + "_blob"])

    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).groupBy(name).applyInArrow(run, f"{name} int, {name}_blob binary")


def _met(parts: DataFrame, blocks: DataFrame, n_parts: int, n_blocks: int, run, schema: str) -> DataFrame:
    """Each block with each part, one task's worth at a time."""
    left = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_pylist([], schema=_arrow(schema))
        return run(Part(a.column("part_blob")[0].as_py()), b)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(both, schema)


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the columns of ``rows``; ``scale`` turns components into
    integers, floor(scale * x); the window is from ``low`` to ``high`` per cent of the positive's score.
    """
    x = lambda c: c.cast("double")
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    own = rows.where(sound).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                                   F.transform(F.col(vector), lambda c: F.floor(x(c) * scale).cast("long")).alias("q")).where("label IS NOT NULL")
    own = saved(own.groupBy("id").agg(F.min(F.struct("label", "q", "anchor")).alias("r")).select("id", "r.label", "r.q", "r.anchor"), "vectors")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).first()
    n_parts, n_blocks = max(1, -(-size.n // part)), max(1, -(-size.anchors // block))
    parts = saved(_packed(own, "part", n_parts, Part.pack), "parts")
    blocks = saved(_packed(own.where("anchor"), "block", n_blocks, Tree.pack), "blocks")
    found = "block long, place long, anchor_id long, id long, score long"

    def same(p: Part, table: pa.Table) -> pa.Table:
        tree, number = Tree(table.column("block_blob")[0].as_py()), table.column("block")[0].as_py()
        out = [(number, a, int(tree.ids[a]), i, int(s)) for a, at, scores in best_same(tree, p, positives) for i, s in zip(p.ids[at].tolist(), scores.tolist(), strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=_arrow(found))

    by_score = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    first = _met(parts, blocks, n_parts, n_blocks, same, found).withColumn("k", by_score("anchor_id")).where(F.col("k") <= positives)
    first = saved(first, "positives")

    def pack(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy().astype("<i8") for c in ("place", "id", "score")]
        order = np.lexsort((table.column("k").to_numpy(), columns[0]))
        return pa.table([table.column("block")[:1].cast(pa.int32()), pa.array([pack_arrays(*[c[order] for c in columns])], pa.binary())], names=["block", "windows"])

    windowed = saved(blocks.join(first.groupBy("block").applyInArrow(pack, "block int, windows binary"), "block"), "windows")
    mined = "anchor_id long, positive_id long, positive_score long, id long, score long"

    def other(p: Part, table: pa.Table) -> pa.Table:
        tree = Tree(table.column("block_blob")[0].as_py())
        own: list[list[tuple[int, int]]] = [[] for _ in tree.ids]
        for a, *positive in zip(*[c.tolist() for c in unpack_arrays(table.column("windows")[0].as_py(), "<i8", "<i8", "<i8")], strict=True):
            own[a].append(tuple(positive))
        windows = [[(-(-low * s // 100), high * s // 100) for _, s in w] for w in own]
        out = [(int(tree.ids[a]), *own[a][j], i, int(s)) for a, j, at, scores in best_between(tree, p, windows, negatives)
               for i, s in zip(p.ids[at].tolist(), scores.tolist(), strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=_arrow(mined))

    return _met(parts, windowed, n_parts, n_blocks, other, mined).withColumn("rank", by_score("anchor_id", "positive_id")).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
