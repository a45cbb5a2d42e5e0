"""Suffix order, rank, search and locate against plain Python."""

import numpy as np
import pytest

from ragscope.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def naive_order(text):
    def key(i):
        out = []
        for j in range(i, len(text)):
            out.append((int(text[j]), j if text[j] == 0 else 0))
            if text[j] == 0:
                break
        return out
    return sorted(range(len(text)), key=key)


@pytest.mark.parametrize("top,size,seed", [(1, 60, 0), (3, 300, 1), (40, 500, 2), (70000, 200, 3)])
def test_order_search_locate(top, size, seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([[0], rng.integers(0, top + 1, size), np.full(40, 1), [0], np.full(40, 1), [0]]).astype(np.int64)
    text = np.concatenate([text, text])
    assert suffix_order(text, top).tolist() == naive_order(text)
    index = FMIndex(text, top, sample=4)
    for length in (1, 2, 5):
        starts = [i for i in range(len(text) - length) if (text[i: i + length] > 0).all()][::7]
        patterns = np.array([text[i: i + length] for i in starts])
        patterns = np.unique(np.concatenate([patterns, np.full((1, length), top)]), axis=0)
        which, at = index.occurrences(patterns)
        want = {(k, i) for k, p in enumerate(patterns) for i in range(len(text) - length + 1) if (text[i: i + length] == p).all()}
        assert set(zip(which.tolist(), at.tolist(), strict=True)) == want and len(which) == len(want)


def test_wavelet_rank():
    s = np.random.default_rng(5).integers(0, 9, 200)
    m = WaveletMatrix(s, 8)
    for c in range(9):
        i = np.arange(201)
        assert m.rank(np.full(201, c), i).tolist() == [int((s[:k] == c).sum()) for k in i]
