"""Top-k through an index of cells that prunes, exact on every metric.

Index rows are filed in the cell of their nearest centroid; centroids come from
k-means on a bounded sample of the index (``SAMPLE_ROWS`` rows, at most ``MOST_CELLS``
cells), all rows are filed.  Cells are laid end to end in parts of
``PART_ROWS`` rows or more, queries likewise in blocks, so near queries share a block and near
rows a part.  A block first meets the part in which its queries' bounds are highest;
the k-th scores found there rule out most cells of clustered vectors, and only
parts with a cell that some query may still gain from are met at all.  The bounds decide
what is read, never what is found: results equal ``retrieval.top_k``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.operators import vectors
from ragscope.operators.ordering import written
from ragscope.operators.retrieval import EMPTY, check, vector_rows

SAMPLE_ROWS, MOST_CELLS, ROUNDS = 20_000, 4096, 8
#: The least; larger tables are cut into ``vectors.GRID`` parts and blocks, until these have ``MOST_ROWS`` rows.
PART_ROWS, BLOCK_ROWS, MOST_ROWS = 8192, 1024, 65_536


def centroids(rows: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by k-means, from evenly spread rows."""
    out = rows[np.linspace(0, len(rows) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        near = nearest(rows, out)
        sums, count = np.zeros_like(out), np.bincount(near, minlength=len(out))
        np.add.at(sums, near, rows)
        out = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], out)
    return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * rows @ centres.T, axis=1)


def slices(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[i : i + 1024] for i in range(0, len(rows), 1024)]


def _filed(rows: DataFrame, centres, metric: str) -> DataFrame:
    """(id, v, cell): every row with its nearest cell."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.concatenate([nearest(vectors.unit(x) if metric == "cosine" else x, centres.value) for x in np.array_split(m, -(-len(m) // 1024))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["id", "v", "cell"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int")


def _dealt(filed: DataFrame, name: str, limit: int) -> tuple[DataFrame, int]:
    """(name, id, v, cell), and how many numbers: cells end to end in bins of about ``limit`` rows; a larger cell
    takes several bins.  The counts are one row for each cell (at most ``MOST_CELLS``)."""
    counts = sorted((r["cell"], r["count"]) for r in filed.groupBy("cell").count().collect())
    first, many, at, room = {}, {}, 0, limit
    for cell, n in counts:
        if n > room and room < limit:
            at, room = at + 1, limit
        first[cell], many[cell] = at, max(1, -(-n // limit))
        at, room = (at, room - n) if n <= limit else (at + many[cell], limit)
    places = filed.sparkSession.createDataFrame([(c, first[c], many[c]) for c in first], "cell int, first int, many int")
    return filed.join(F.broadcast(places), "cell").select(  # bounded by MOST_CELLS
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int").alias(name), "id", "v", "cell"), max([1, *(first[c] + many[c] for c in first)])


def search(queries: DataFrame, index: DataFrame, k: int = 3, metric: str = "cosine", query_id: str = "query_id", query_vec: str = "embedding",
           doc_id: str = "doc_id", doc_vec: str = "embedding", exclude_self: bool = False, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The hits like ``retrieval.top_k``, and ``query_id, visited, cells``: how many cells each query visited of how
    many there are (a cell that lies in several parts counts in each)."""
    check(k, metric)
    spark = queries.sparkSession
    asked, held = vector_rows(queries, query_id, query_vec), vector_rows(index, doc_id, doc_vec)
    sample = held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], EMPTY), spark.createDataFrame([], "query_id long, visited long, cells long")
    rows = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sample.num_rows, -1)
    rows = vectors.unit(rows) if metric == "cosine" else rows
    n_held, n_asked = held.count(), asked.count()
    cells = min(len(rows), MOST_CELLS, cells or max(1, math.isqrt(n_held)))
    centres = spark.sparkContext.broadcast(centroids(rows, cells))
    filed = written(_filed(held, centres, metric), "filed")
    own, n_parts = _dealt(filed, "part", vectors.cut_at(n_held, PART_ROWS, MOST_ROWS))
    parts = written(vectors.packed(own, "part", metric), "index-parts")
    own, _ = _dealt(written(_filed(asked, centres, metric), "asked"), "block", vectors.cut_at(n_asked, BLOCK_ROWS, MOST_ROWS))
    blocks = written(vectors.packed(own, "block", metric), "query-blocks")

    def outlines(batches):
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("part_blob").to_pylist(), strict=True):
                p = vectors.Pack.read(blob)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(p.radius), pa.int32()), pa.array(list(p.centre), pa.list_(pa.float64())), pa.array(p.radius, pa.float64())],
                                                 names=["part", "centre", "radius"])

    # one row for each cell of a part: bounded by MOST_CELLS and the number of parts
    shape = parts.mapInArrow(outlines, "part int, centre array<double>, radius double").toArrow()
    number = shape.column("part").to_numpy()
    outline = spark.sparkContext.broadcast((number, np.stack(shape.column("centre").to_pylist()), shape.column("radius").to_numpy()))

    def home(batches):
        number, centre, radius = outline.value
        for batch in batches:
            at = [int(number[np.argmax(sum(vectors.bounds(x, centre, radius, metric).sum(axis=0) for x in slices(vectors.Pack.read(b, metric).m)))]) for b in batch.column("block_blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(at, pa.int32())], names=["block", "part"])

    def reached(batches):
        number, centre, radius = outline.value
        for batch in batches:
            for block, blob, floor in zip(*[batch.column(c).to_pylist() for c in ("block", "block_blob", "floor")], strict=True):
                gain = np.any([(vectors.bounds(x, centre, radius, metric) >= y[:, None]).any(axis=0) for x, y in zip(
                    slices(vectors.Pack.read(blob, metric).m), slices(np.frombuffer(floor, np.float64)), strict=True)], axis=0)
                some = np.unique(number[gain])
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int32()), pa.array(some, pa.int32())], names=["block", "part"])

    first = written(blocks.mapInArrow(home, "block int, part int"), "homes")
    rest = lambda known: written(blocks.join(known, "block").mapInArrow(reached, "block int, part int").join(first, ["block", "part"], "left_anti"), "pairs")
    hits = written(vectors.two_rounds(blocks, parts, first, rest, k, metric, exclude_self), "found") if n_parts > 1 else written(
        vectors.met(blocks, parts, first, k, metric, exclude_self), "found")
    seen = hits.where("doc_id IS NULL").groupBy("query_id").agg(F.sum("visited").alias("visited"), F.lit(len(number)).cast("long").alias("cells"))
    return vectors.best(hits, k), seen


def top_k_cells(queries: DataFrame, index: DataFrame, *args, **options) -> DataFrame:
    """``query_id, rank, doc_id, score`` like ``retrieval.top_k``, through the cells."""
    return search(queries, index, *args, **options)[0]
