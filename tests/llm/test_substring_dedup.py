"""Relative parsing against a dictionary of windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ragscope.llm.blobs import pack_arrays, unpack_arrays
from ragscope.llm.substring_dedup import _RUN, P, factors_of, parse, window_runs
from ragscope.llm.words import find_words


def brute(docs, n=13):
    first = {}
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i: i + n])
            first[k] = min(first.get(k, (True, 0)), (d is None, d or 0))
    out = []
    for d, t in docs:
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i: i + n])] < (d is None, d or 0):
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def data():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "é", "1", "zz"])
    text = lambda n: [word() for _ in range(n)]
    passages = [text(rng.choice([12, 13, 14, 20, 60])) for _ in range(8)]
    docs = []
    for i in range(160):
        parts = [text(rng.randint(0, 20)), rng.choice(passages)[rng.randint(0, 3):], text(3), rng.choice(passages)[: rng.randint(10, 60)], text(rng.randint(0, 9))]
        docs.append((i * 7 % 1000, " ".join(sum(parts, []))))
    docs += [(2000 + i, docs[5][1]) for i in range(30)] + [(3000, "x " * 300), (3001, "x " * 40)]
    return docs + [(4000, None), (4001, ""), (4002, "a b c"), (None, docs[9][1]), (None, docs[9][1] + " end"), docs[3], (docs[4][0], docs[3][1] + " more")]


@pytest.mark.parametrize("hot", [64, 3])
def test_against_brute_force(spark, hot):
    docs = data()
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, key string").repartition(6)
    out = parse(df, hot=hot).collect()
    assert all(r.key == "k" for r in out)
    assert sorted(((r.doc_id, r[P + "words"], r[P + "removed"], r[P + "kept"]) for r in out), key=str) == brute(docs)
    by = {}
    for d, t in docs:
        by.setdefault(d, []).append((t or "").split())
    for r in out:
        own = (r.text or "").split()
        for f in r[P + "factors"]:
            assert f.length >= 13 and f.ref < (r.doc_id if r.doc_id is not None else 1 << 62)
            assert any(own[f.start: f.start + f.length] == w[f.ref_start: f.ref_start + f.length] for w in by[f.ref])


def test_empty(spark):
    df = spark.createDataFrame(data(), "doc_id long, text string")
    assert parse(df.limit(0)).count() == 0


def test_runs_cover_all_windows_and_equal_windows_meet():
    w = find_words(pa.array([t for _, t in data()]))
    seed, first, count, tails = window_runs(w)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count, strict=True)])
    assert starts.tolist() == w.room(13).tolist() and len(tails) == len(starts) and count.max() <= 9
    seeds, seen = np.repeat(seed, count), {}
    for i, s, t in zip(starts.tolist(), seeds.tolist(), tails.tolist(), strict=True):
        k = tuple(w.word(j) for j in range(i, i + 13))
        assert seen.setdefault(k, (s, t)) == (s, t)
    assert len(set(seen.values())) == len(seen)


def brute_factors(docs, n=13):
    """Greedy parse against a reference that has each window once, at its first place; ids differ."""
    place = {}
    for d, t in sorted(docs):
        w = t.split()
        for i in range(len(w) - n + 1):
            place.setdefault(tuple(w[i: i + n]), (d, i))
    out = {}
    for d, t in docs:
        w = t.split()
        where = [place[tuple(w[i: i + n])] for i in range(len(w) - n + 1)]
        where = [p if p[0] < d else None for p in where]

        def longest(i, to):
            k = 1
            while i + k < to and where[i + k] == (where[i][0], where[i][1] + k):
                k += 1
            return k

        i, found = 0, []
        while i < len(where):
            if where[i] is None:
                i += 1
                continue
            k = longest(i, len(where))
            found.append((i, k + n - 1, *where[i], False))
            end, j = i + k + n - 1, i + k
            while j < min(end, len(where)):
                if where[j] is None:
                    j += 1
                    continue
                k = longest(j, min(end, len(where)))
                found.append((j, k + n - 1, *where[j], True))
                j += k
            i = end
        out[d] = sorted(found)
    return out


@pytest.mark.parametrize("hot", [64, 3])
def test_greedy_parse_against_brute_force(spark, hot):
    docs = list({d: t for d, t in data() if d is not None and t is not None}.items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_factors(docs)
    got = {r.doc_id: sorted(tuple(f) for f in r[P + "factors"]) for r in parse(df, hot=hot).collect()}
    assert got == want
    assert any(f[4] for own in want.values() for f in own) and any(f[1] >= 20 for own in want.values() for f in own)
    for own in got.values():  # factors of the parse follow each other, boundary factors reach over one's end
        ends = [(a, a + n) for a, n, _, _, over in own if not over]
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))
        assert all(any(a < e < a + n for _, e in ends) for a, n, _, _, over in own if over)


def test_factors_are_the_longest_and_boundaries_are_checked():
    # windows 0-2 and 3 of one passage, 4-5 of another over its end (word 16), 16-17 go on there, 30 is apart
    rec = np.array([(0, 3, 50, 1, 5), (3, 1, 53, 1, 5), (4, 2, 7, 1, 9), (6, 12, 90, 2, 9), (30, 1, 0, 1, 5)], _RUN)
    assert factors_of(rec.tobytes()) == [
        (0, 16, 5, 50, False), (4, 14, 9, 7, True), (6, 22, 9, 90, True), (16, 14, 9, 100, False), (30, 13, 5, 0, False)]


def test_packed_arrays():
    a, b = np.arange(5, dtype="<u4"), np.zeros(0, "<i8")
    x, y = unpack_arrays(pack_arrays(a, b), "<u4", "<i8")
    assert x.tolist() == a.tolist() and len(y) == 0
