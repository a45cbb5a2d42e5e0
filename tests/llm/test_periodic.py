"""Runs by Lyndon roots against every period tried at every position."""

import random
import zlib

import numpy as np
import pytest

from ragscope.llm.periodic import P, find_runs, lyndon_lengths, rewrite_rule, runs_of


def brute_runs(w, least=24, times=3):
    """Every period in ascending order; a stretch that a smaller period of it has is no run of the larger one."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_lyndon(s):
    n = len(s)
    return [next(j for j in range(i + 1, n + 1) if j == n or s[j:] < s[i:]) - i for i in range(n)]


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_lyndon_array(letters):
    rng = random.Random(letters)
    for n in [*range(12), 60]:
        for _ in range(30):
            s = [rng.randrange(letters) for _ in range(n)]
            assert lyndon_lengths(s).tolist() == brute_lyndon(s)


def test_runs_of_small_texts():
    rng = random.Random(2)
    for least, times in [(2, 2), (6, 3), (24, 3)]:
        for _ in range(150):
            s = []
            while len(s) < 70:
                s += [rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))] * rng.choice([1, 1, 2, 5, 12])
            got = [tuple(map(int, r)) for r in zip(*runs_of(np.array([0, *s, 0]), len(s), least, times))]
            assert [(a - 1, n, q) for a, n, q in got] == brute_runs(s, least, times)


def words(t):
    return (t or "").replace("\x0b", " ").replace("\x0c", " ").encode().decode().translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")


def rewritten(key, w):
    if key is None or not w or zlib.crc32(str(key).encode()) % 10:
        return w
    g = zlib.crc32(str(key).encode()) // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]


def brute(key, text):
    w = rewritten(key, [x for x in words(text) if x])
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in drop)


def data():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "é", "the", "日本", "x" * 40])
    docs = []
    for i in range(200):
        parts = []
        while rng.random() < 0.8:
            parts += [word() for _ in range(rng.randrange(1, 12))] * rng.choice([1, 1, 1, 3, 4, 9, 30])
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    long = " ".join(f"w{k % 997}" for k in range(9970))
    return docs + [(300, None), (301, ""), (302, " \n "), (None, "a b " * 20), (5, docs[5][1]), (5, docs[5][1]),
                   (303, long), (304, "z " * 5000 + " ".join(f"u{k}" for k in range(3000))), (305, "y\x0by\x0c" * 30 + "no\xa0break"), (306, "q" * 200_000)]


def test_against_brute_force(spark):
    docs = data()
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, start string").repartition(3)
    got = find_runs(df, rewrite=rewrite_rule).collect()
    assert all(r.start == "s" for r in got)
    mine = sorted(((r.doc_id, r[P + "words"], [tuple(x) for x in r[P + "runs"]], r[P + "kept"]) for r in got), key=str)
    want = sorted(((d, *brute(d, t)) for d, t in docs), key=str)
    assert mine == want
    assert sum(len(r[P + "runs"]) > 1 for r in got) > 5


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_runs(df, rewrite=rewrite_rule).count() == 0
