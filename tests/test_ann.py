"""Search by cells and block-by-part search against all scores."""

import numpy as np
import pytest

from ragscope.operators import ann, vectors
from ragscope.operators.ann import search, top_k_cells
from ragscope.operators.retrieval import top_k
from tests.conftest import SF_SMALL


def ranked(df):
    return [(r.query_id, r.rank, r.doc_id) for r in df.orderBy("query_id", "rank").collect()]


def brute(queries, index, k, metric, exclude_self=False):
    ids, d = np.array([i for i, v in index if v is not None]), np.array([v for _, v in index if v is not None])
    out = []
    for i, v in queries:
        if v is None:
            continue
        q = np.array(v)
        s = d @ q if metric != "l2" else -((d - q) ** 2).sum(1)
        if metric == "cosine":
            size = np.linalg.norm(d, axis=1) * np.linalg.norm(q)
            s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
        s = np.round(s, 9)
        order = [j for j in np.lexsort((ids, -s)) if not (exclude_self and ids[j] == i)][:k]
        out += [(i, r + 1, int(ids[j])) for r, j in enumerate(order)]
    return sorted(out)


def data(clustered=False):
    rng = np.random.default_rng(4)
    m = rng.integers(-20, 20, (300, 6)).astype(float)
    if clustered:
        m = np.repeat(np.round(rng.normal(size=(10, 6)) * 50), 30, axis=0) + rng.integers(-3, 4, (300, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return rows + [(900, [0.0] * 6), (901, None)] + [(1000 + i, rows[7][1]) for i in range(100)]  # one very common vector


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_equal_to_all_scores(spark, monkeypatch, metric):
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 25)
    rows = data()
    df = spark.createDataFrame(rows, "query_id long, embedding array<double>").repartition(3)
    idx = df.withColumnRenamed("query_id", "doc_id")
    want = brute(rows, rows, 4, metric)
    assert ranked(top_k(df, idx, 4, metric, block_bytes=2000, part_bytes=3000)) == want
    hits, seen = search(df, idx, 4, metric, cells=9)
    assert ranked(hits) == want
    assert seen.count() == 401
    assert ranked(top_k(df.limit(50), idx, 4, metric, exclude_self=True)) == brute([(r.query_id, r.embedding) for r in df.limit(50).collect()], rows, 4, metric, True)


def test_clustered_vectors_visit_few_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    rows = data(clustered=True)
    df = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    for metric, most in (("l2", 0.5), ("cosine", 0.6)):
        hits, seen = search(df, df.withColumnRenamed("query_id", "doc_id"), 3, metric, cells=30)
        assert ranked(hits) == brute(rows, rows, 3, metric)
        assert sum(r.visited for r in seen.collect()) < most * sum(r.cells for r in seen.collect())


def test_whole_table_and_empty(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    args = dict(k=5, query_id="vec_id", doc_id="vec_id", exclude_self=True)
    assert ranked(top_k_cells(emb, emb, **args)) == ranked(top_k(emb, emb, **args))
    for f in (top_k, top_k_cells):
        assert f(emb, emb.limit(0), **args).count() == 0 and f(emb.limit(0), emb, **args).count() == 0
        with pytest.raises(ValueError):
            f(emb, emb, k=0)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, rows = rng.normal(size=(50, 8)), rng.normal(size=(200, 8))
    centre = rows.mean(axis=0)[None]
    radius = np.sqrt(((rows - centre) ** 2).sum(1)).max()[None]
    for metric in ("ip", "l2"):
        assert (vectors.scores(q, rows, metric).max(axis=1) <= vectors.bounds(q, centre, radius, metric)[:, 0]).all()


def test_pairs_grow_with_the_table_and_not_with_its_square():
    """Bytes that meet in tasks: a table of n bytes goes n_parts + n_blocks times."""
    def met(total):
        block, part = vectors.cut_at(total, 1 << 20, vectors.MOST_BYTES), vectors.cut_at(total, 4 << 20, vectors.MOST_BYTES)
        return -(-total // block) * part + -(-total // part) * block

    assert all(-(-n // vectors.cut_at(n, 1 << 20, vectors.MOST_BYTES)) <= vectors.GRID for n in (1, 5 << 20, 336 << 20))
    assert met(336 << 20) <= 6.5 * met(56 << 20)


def test_cells_fill_bins_of_bounded_size(spark):
    """Many cells that are smaller than a bin, and one that is larger."""
    sizes = [30] * 20 + [250] + [30] * 5
    filed = spark.createDataFrame([(1000 * c + i, [1.0], c) for c, n in enumerate(sizes) for i in range(n)], "id long, v array<double>, cell int")
    dealt, n = ann._dealt(filed, "part", 100)
    found = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    assert sum(found.values()) == sum(sizes) and max(found) < n and max(found.values()) <= 150
    assert max(v for k, v in found.items() if k < 7) <= 100


def test_packs_keep_every_bit_of_their_vectors():
    import numpy as np
    import pyarrow as pa

    for m, kind in (([[0.5, 0.25], [3.0, 1.0]], np.float32), ([[0.1, 0.25], [3.0, 1e300]], np.float64)):
        table = pa.table({"id": [7, 3], "v": pa.array(m, pa.list_(pa.float64())), "cell": pa.array([0, 0], pa.int32())})
        own = vectors.Pack.of(table, "cosine")
        back = vectors.Pack.read(own.blob(), "cosine")
        assert back.given.dtype == kind and (back.m == own.m).all() and back.given.tolist() == m[::-1] and back.ids.tolist() == [3, 7]
