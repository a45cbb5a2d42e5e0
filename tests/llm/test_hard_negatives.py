"""Hard negatives by tree bounds against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragscope.llm.blobs import pack_arrays
from ragscope.llm.hard_negatives import Part, Tree, best_same, mine, spanning_tree

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, id string"


def brute(rows, positives=5, negatives=3):
    usable = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        usable[i] = min(usable.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (y, q) in usable.items():
        if a % 50:
            continue
        scored = sorted((-dot(q, p), i, z) for i, (z, p) in usable.items() if i != a)
        for s, i, _ in [r for r in scored if r[2] == y][:positives]:
            fits = [r for r in scored if r[2] != y and -50 * s <= -100 * r[0] <= -95 * s][:negatives]
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


def data(seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(600):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(3)))
    rows += [(1000 + i, list(centres[0]), i % 3) for i in range(200)]  # one very common vector
    odd = [(None, [1.0] * 6, 1), (2001, None, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] * 6, 0), (2005, [1.0] * 6, None),
           (2050, [], 1), (2051, [2.0, 1.0], 1), (2100, [0.0] * 6, 0), (2150, [-1.0] * 8, 2), rows[50], (50, [9.0] * 6, 2), (50, [0.5] * 6, 0)]
    return rows + odd


@pytest.mark.parametrize("part, block", [(100, 4), (8192, 512)])
def test_against_brute_force(spark, part, block):
    rows = data(part)
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)
    got = mine(df, F.col("vec_id") % 50 == 0, part=part, block=block)
    assert dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_components(spark):
    rows = [(i, [float(2 ** 20 + 3 * i), 1.0 - i], i % 2) for i in range(120)]
    got = mine(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA), F.col("vec_id") % 50 == 0, low=0, high=100)
    assert got.count() > 0 and all(r.positive_score > 1 << 53 for r in got.collect())


def test_empty(spark):
    rows = [(1, [1.0], 1, "a", "b")]
    assert mine(spark.createDataFrame(rows, SCHEMA).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_spares_scores():
    rng = np.random.default_rng(3)
    centres = rng.integers(-256, 256, (40, 16))
    rows = np.concatenate([c + rng.integers(-4, 5, (50, 16)) for c in centres])
    pick = np.arange(0, len(rows), 10)
    order, parent, length = spanning_tree(rows[pick])
    assert order[0] == 0 and all(np.isclose(length[c], np.linalg.norm(rows[pick][c] - rows[pick][parent[c]])) for c in order[1:])
    place = np.argsort(order)
    tree = Tree(pack_arrays(pick[order], np.zeros(len(pick), "<i8"), place[parent[order]], length[order], rows[pick][order].ravel()))
    part = Part(pack_arrays(np.arange(len(rows)), np.zeros(len(rows), "<i8"), rows.ravel()))
    scored = sum(len(at) for _, at, _ in tree.walk(part.vectors, lambda a, lo, hi: hi >= np.partition(lo, -6)[-6]))
    assert scored < 0.25 * len(pick) * len(rows)
    for a, at, scores in best_same(tree, part, 5):
        exact = rows @ tree.vectors[a]
        keep = np.flatnonzero(np.arange(len(rows)) != tree.ids[a])
        assert at.tolist() == keep[np.lexsort((keep, -exact[keep]))[:5]].tolist() and scores.tolist() == exact[at].tolist()
