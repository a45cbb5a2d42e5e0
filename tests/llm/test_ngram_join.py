"""Components against all pairs, and the group bound against plain sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ragscope.llm.bloom import Bloom, bloom_of
from ragscope.llm.components import components
from ragscope.llm.ngram_join import Group, _bucket, _meet, _prefixes, extra, join, keep_one, least_shared, needed, prefix_length, prefix_of, set_id, token_sets


def shingles(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 85 * (len(sets[i]) + len(sets[j]) - inter):
                root[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if top(j) == top(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def data():
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(80)]
    docs = []
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 150]))] for _ in range(20)] + [passage]
    for i in range(420):
        b = list(rng.choice(bases) if i % 3 else passage)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = rng.choice(vocab).upper()
        if i % 7 == 0:
            b += passage[: rng.randint(10, 80)]
        docs.append((i * 3, " ".join(b)))
    docs += [(5000 + i, docs[1][1]) for i in range(20)] + [(6000, None), (6001, ""), (6002, " \n"), (6003, "one"), (6004, "ONE"), (6005, "two words")]
    return docs + [(None, docs[2][1]), (None, "null alone a b c d"), docs[4], (docs[5][0], "same id other text x y z")]


@pytest.mark.parametrize("group,hot", [(256, 64), (5, 4)])
def test_against_all_pairs(spark, group, hot):
    docs = data()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, sid string").repartition(5)
    got = [(r[0], r[1], r[2]) for r in join(df, group=group, hot=hot).collect()]
    want = brute(docs)
    assert len({c for _, _, c in want}) > 15
    assert sorted(got, key=str) == sorted(want, key=str)


def test_keep_one(spark):
    docs = data()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, label int").repartition(5)
    out = keep_one(df)
    assert out.columns == df.columns
    kept = sorted([r.doc_id for r in out.collect()], key=str)
    want = brute(docs)
    full = {(d, t) for (d, t), (_, n, c) in zip(docs, want, strict=True) if n == 0 or d == c}
    assert kept.count(6000) == kept.count(6001) == kept.count(6002) == 1
    assert set(kept) >= {d for d, t in full if d is not None and d != docs[5][0]}
    components_ = {c for (_, n, c) in want if n}
    assert len(kept) == len(components_) + 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert join(df).count() == 0 and keep_one(df).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r[:3]) for r in join(nulls).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_group_bound_and_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 40)).astype("<u8")) for _ in range(60)]
    g = Group.unpack(Group.of([(i, s.tobytes()) for i, s in enumerate(sets)]).pack())
    for q in sets[::3]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))]
        assert g.linked(q, 60).tolist() == want
    for x in range(1, 60):
        for y in range(1, 60):
            i = needed(x, y)
            assert 100 * i >= 85 * (x + y - i) and 100 * (i - 1) < 85 * (x + y - i + 1)
        assert all(needed(x, y) > x - prefix_length(x) for y in range(-(-85 * x // 100), x * 100 // 85 + 1))


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: top(i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_sets_share_enough_prefix_tokens():
    rng, sketch = np.random.default_rng(9), np.zeros(1 << 18, np.int64)
    found = 0
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, len(x) - int(rng.integers(0, 1 + n // 8))), replace=False), rng.integers(0, 1 << 60, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        i = len(np.intersect1d(x, y))
        if 100 * i >= 85 * (len(x) + len(y) - i):
            found += 1
            shared = len(np.intersect1d(prefix_of(x, sketch), prefix_of(y, sketch)))
            assert shared >= min(extra(len(x)), extra(len(y))) + 1
            assert shared >= max(least_shared(len(x)), least_shared(len(y)))
    assert found > 500


def test_bloom(spark):
    keys = np.random.default_rng(1).integers(-1 << 62, 1 << 62, 5000)
    b = bloom_of(spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(3))
    assert b.may_have(keys).all() and b.may_have(keys + 1).mean() < 0.01
    own = Bloom()
    own.add(keys)
    assert (own.data == b.data).all()
    assert not bloom_of(spark.createDataFrame([], "k long")).data.any()


def test_hot_token_keeps_sets_unlike_its_stand_in():
    """Sets of one slice share a passage, most are much longer; their near copies are in a slice where it is not hot."""
    first, second, near = [], [], []
    for f in range(6):
        text = lambda name, n: [f"f{f}{name}{i}" for i in range(n)]  # noqa: B023, E731
        rare, common, long_ = text("p", 20), text("c", 43), text("l", 400)
        near.append(" ".join(rare + common))
        first += [near[-1], *[" ".join(rare + long_ + text(f"u{i}", 3)) for i in range(5)], *[" ".join(common)] * 20, *[" ".join(long_)] * 20]
        second.append(" ".join([*rare, *common[:-1], "other"]))
    sketch = np.bincount(_bucket(np.concatenate(token_sets(pa.array(first + second)))), minlength=1 << 18)
    blobs = [b for part in (first, second) for _, b in _prefixes(pa.RecordBatch.from_arrays([pa.array(part)], names=["_text"]), 4, 85, sketch, 1, 4)]
    sid, _, _, token = _meet(blobs, 85)
    for x, y in zip(token_sets(pa.array(second)), token_sets(pa.array(near)), strict=True):
        inter = len(np.intersect1d(x, y))
        assert 100 * inter >= 85 * (len(x) + len(y) - inter)
        both = np.intersect1d(token[sid == set_id(x)], token[sid == set_id(y)])
        assert len(both) >= max(least_shared(len(x)), least_shared(len(y)))
