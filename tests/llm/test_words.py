"""Word arrays against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa

from ragscope.llm.words import ALNUM, find_words, ngram_hashes, slices

PIECES = ["a", "B", "é", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "zz", "word", "日本", "\x85", "_", "9", "Z"]


def texts():
    rng = random.Random(1)
    out = [None if rng.random() < 0.05 else "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [*out, "x" * 5000 + " y", "", "x" * 5000 + " " + "x" * 4999]


def words(w, i):
    return [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])]


def test_white_space_words_and_hashes():
    all_texts = texts()
    w = find_words(pa.array(all_texts))
    seen = {}
    for i, t in enumerate(all_texts):
        assert words(w, i) == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for j in range(len(w.start)):
        assert seen.setdefault(w.word(j), w.hashes[j]) == w.hashes[j]
    assert len(set(seen.values())) == len(seen)


def test_alphanumeric_words_in_lower_case():
    all_texts = texts()
    w = find_words(pa.array(all_texts).slice(3), ALNUM, lower=True)
    for i, t in enumerate(all_texts[3:]):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        assert words(w, i) == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_windows_stay_in_a_document_and_slices_cover_a_batch():
    batch = pa.record_batch({"text": pa.array(["a b c", "a b", None, "b c d e", "x" * 100])})
    w = find_words(batch.column("text"))
    at = w.room(3)
    assert at.tolist() == [0, 5, 6]
    assert len(np.unique(ngram_hashes(w.hashes, at, 3))) == 3
    parts = list(slices(batch, "text", 8))
    assert [p.num_rows for p in parts] == [3, 1, 1] and pa.Table.from_batches(parts).num_rows == 5
    assert find_words(pa.array([], pa.string())).n_docs == 0
