"""Forward-backward against enumeration of state paths; counts and base scores
against Python; held-out likelihood against the unigram's."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ragscope.llm.hmm import ENDINGS, Block, Model, Steps, expected_counts, forward, score


def model(states, n_words, seed):
    rng = np.random.default_rng(seed)
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    words = np.sort(rng.integers(2, 1 << 60, n_words).astype(np.uint64))
    none = np.zeros(ENDINGS, np.int64)
    return Model(words, np.ones(n_words, np.int64), none, none, norm(rng.random(states), 0), norm(rng.random((states, states)), 1),
                 norm(rng.random((ENDINGS + n_words, states)), 0))


def test_likelihood_and_counts_by_enumeration():
    m = model(3, 4, 1)
    rng = np.random.default_rng(2)
    size = np.array([1, 4, 3, 4, 2])
    symbol = rng.integers(ENDINGS, ENDINGS + 4, size.sum())
    start, move, emit, like = np.zeros(3), np.zeros((3, 3)), np.zeros((m.symbols, 3)), 0.0
    at = 0
    for n in size:
        s = symbol[at: at + n]
        at += n
        total, paths = 0.0, []
        for path in itertools.product(range(3), repeat=int(n)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for i in range(1, n):
                p *= m.move[path[i - 1], path[i]] * m.emit[s[i], path[i]]
            paths.append((path, p))
            total += p
        like += math.log10(total)
        for path, p in paths:
            start[path[0]] += p / total
            for i, x in enumerate(path):
                emit[s[i], x] += p / total
                if i:
                    move[path[i - 1], x] += p / total
    got = expected_counts(m, size, symbol)
    for a, b in zip(got, (start, move, emit, like), strict=True):
        assert np.allclose(a, b)
    steps = Steps.of(size)
    scale, _ = forward(m, symbol[steps.where], steps, False)
    assert np.isclose(np.log10(scale).sum(), like)


def test_rounds_never_lose_likelihood():
    m, rng = model(3, 6, 3), np.random.default_rng(4)
    size = rng.integers(1, 30, 40)
    symbol = rng.integers(ENDINGS, ENDINGS + 6, size.sum())
    likes = []
    for _ in range(8):
        start, move, emit, like = expected_counts(m, size, symbol)
        likes.append(like)
        norm = lambda x, a: x / np.maximum(x.sum(axis=a, keepdims=True), 1e-300)
        m = Model(m.words, m.count, m.ending_tokens, m.ending_words, norm(start, 0), norm(move, 1), norm(emit, 0))
    assert all(b >= a - 1e-9 for a, b in zip(likes, likes[1:], strict=False))


def test_block_round_trip():
    texts = pa.array(["The the end.", None, "", "ümlaut a a a"])
    b = Block.unpack(Block.of(texts, np.array([False, True, False, False])).pack())
    assert b.size.tolist() == [4, 1, 1, 5] and b.held.tolist() == [False, True, False, False]
    assert b.token[0] == b.token[1] and len(b.hash) == 5
    assert b.training_counts().sum() == 10


def docs():
    rng = random.Random(13)
    langs = [["der", "die", "und", "haus", "zeit"], ["the", "of", "and", "house", "time"], ["el", "la", "casa", "tiempo", "y"]]
    rare = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    out = []
    for i in range(600):
        lang = rng.choice(langs)
        out.append((i, " ".join(rng.choice(lang) if rng.random() < 0.9 else rare() for _ in range(rng.randint(1, 60))).title()))
    return [*out, (1000, None), (1001, ""), (None, "The of and"), (1002, "the " * 3000), out[5], (5, "other text")]


def test_base_scores_and_held_out_likelihood(spark):
    rows = docs()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int").repartition(4)
    got = score(df, rounds=4).collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not out(d) for w in words(t))
    n = sum(c.values())
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words(t))
    want = sorted(((d, out(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(base(t), 6)) for d, t in rows), key=str)
    assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held) and len(held) > 30
    assert all(r.score < 0 for r in got)
    again = score(df, rounds=4).collect()
    assert np.allclose(sorted(r.score for r in got), sorted(r.score for r in again))


def test_empty_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score(df).count() == 0
    only = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    got = score(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert len(got) == 5 and all(r.n_known == 0 and r.train_tokens == 0 and r.held_out and math.isfinite(r.score) for r in got)
