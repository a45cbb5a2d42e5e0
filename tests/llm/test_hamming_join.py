"""Near-duplicate components against all pairs, and the multi-index against all distances."""

import random
import re

import numpy as np
import pytest

from ragscope.llm import hamming_join as H


def shingles(t, n=5):
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
    tops = [top(i) for i in range(len(docs))]
    least = {}
    for (d, _), r in zip(docs, tops, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(r) if s else d) for (d, _), s, r in zip(docs, sets, tops, strict=True)]


def data():
    rng = random.Random(33)
    vocab = [f"w{i}" for i in range(400)]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = line(120)
    bases = [line(rng.choice([3, 8, 60, 150, 300])) for _ in range(20)] + [passage]
    docs = []
    for i in range(500):
        b = list(rng.choice(bases) if i % 3 else passage)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = rng.choice(vocab).upper()
        if i % 7 == 0:
            b += passage[: rng.randint(10, 120)]
        docs.append((i * 3, " ".join(b)))
    for i in range(120):  # a third of the rows: one passage with little else, mostly not linked
        docs.append((4000 + i, " ".join(passage + [f"own{i}_{j}" for j in range(rng.randint(10, 60))])))
    chain = line(200)
    for i in range(60):  # each a few words from the one before, the ends far apart
        docs.append((4500 + i, " ".join(chain)))
        at = rng.randrange(190)
        chain = chain[:at] + line(3) + chain[at + 3:]
    docs += [(5000 + i, docs[1][1]) for i in range(20)] + [(6000, None), (6001, ""), (6002, " \n"), (6003, "one"), (6004, "ONE"), (6005, "two words")]
    return docs + [(None, docs[2][1]), (None, "null alone a b c d"), docs[4], (docs[5][0], "same id other text x y z")]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, small, monkeypatch):
    if small:  # every way to deal out large groups
        for name, value in {"BLOCK": 4, "QUERIES": 3, "TOGETHER": 5, "MANY": 2, "TASK_ROWS": 60, "TASK_BYTES": 1 << 14}.items():
            monkeypatch.setattr(H, name, value)
    docs = data()
    df = spark.createDataFrame([(d, t, 1, "x", b"") for d, t in docs], "doc_id long, text string, n int, sid string, sig binary").repartition(5)
    got = [tuple(r) for r in H.join(df).collect()]
    want = brute(docs)
    assert len({c for _, _, c in want}) > 30
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert H.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in H.join(nulls).collect()) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        H.join(nulls, t=80)


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(4)
    assert 2 * H.CHUNKS - 1 >= H.DISTANCE and sum(H._CUTS) == H.VALUES
    for _ in range(300):
        a = rng.integers(0, 1 << H.BITS, (1, H.VALUES)).astype("<u2")
        b = a.copy()
        at = rng.choice(H.VALUES, H.DISTANCE, replace=False)
        b[0, at] ^= rng.integers(1, 1 << H.BITS, H.DISTANCE).astype("<u2")
        assert H.distances(a[0], b)[0] == H.DISTANCE
        assert len(np.intersect1d(H.chunk_keys(a), H.chunk_keys(b)))
    c = rng.integers(0, 1 << H.BITS, (2000, H.VALUES)).astype("<u2")
    assert len(np.unique(H.chunk_keys(c))) == c.size


def test_linked_sets_lie_within_the_distance():
    rng = np.random.default_rng(8)
    for size in (20, 200, 2000):
        most = []
        for _ in range(400):
            both = rng.integers(0, 1 << 63, int(size * 0.85)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            own = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64) * np.uint64(2)
            rest = size - len(both)
            a, b = np.concatenate([both, own(rest // 2)]), np.concatenate([both, own(rest - rest // 2)])
            sa, sb = H.signatures([a, b])
            most.append(int(H.distances(sa, sb[None])[0]))
        assert max(most) <= H.DISTANCE and abs(np.mean(most) - 0.15 * H.VALUES) < 1.0
    assert H.signatures([np.zeros(0, np.uint64)]).tolist() == [[0] * H.VALUES]
