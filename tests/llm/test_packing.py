"""Sum-of-squares packing: the placement rule, whole tokens, padding, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from ragscope.llm.packing import Packer, Piece, WordTokenizer, pack


def test_level_is_the_least_growth_of_squares():
    rng = random.Random(3)
    p = Packer(window=16)
    for h in rng.choices(range(1, 16), k=60):
        p.levels[h] += 1
    for size in range(1, 16):
        def growth(h):
            n = p.levels.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n[1:16] ** 2).sum() - (p.levels[1:16] ** 2).sum())
        options = [h for h in range(0, 17 - size) if h == 0 or p.levels[h]]
        best = min(growth(h) for h in options)
        assert growth(p.level_for(size)) == best
        assert p.level_for(size) == max(h for h in options if growth(h) == best)


@pytest.mark.parametrize("most_open", [10_000, 3])
def test_every_id_once_and_little_padding(most_open):
    rng = random.Random(1)
    p, docs, windows = Packer(64, most_open), [], []
    for i in range(500):
        docs.append(np.arange(rng.choice([1, 7, 30, 40, 63, 64, 65, 200])))
        windows += p.add(i, docs[-1])
    windows += p.flush()
    got = {}
    for w in windows:
        assert sum(len(x.ids) for x in w) <= 64
        for x in w:
            assert isinstance(x, Piece) and len(x.ids)
            got.setdefault(x.row, []).append(x)
    for i, d in enumerate(docs):
        own = sorted(got[i], key=lambda x: x.start)
        assert np.concatenate([x.ids for x in own]).tolist() == d.tolist()
    short = [n for w in windows if (n := sum(len(x.ids) for x in w)) < 64]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 6


def test_ids_of_words_are_ids_of_the_text():
    model = Tokenizer.from_file(path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = ["", None, "It's Über ΣΑΣ ς\x0bx\x1cy", "<|endoftext|> a", "<|ENDOFTEXT|> b", "é ́x 日本語　x \xa0 y\x85z", "İ   'll", "...", "a. b,' c'. d.\u0301 ,"]
    pieces = [*" \n\t'sé́Σσ9日!.,;<|>enDÅK‍İﬁ", "Word.", "x1,", " ", "a?!"]
    texts += ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(400)] + ["".join(rng.choice([*pieces, "<|endoftext|>"]) for _ in range(30)) for _ in range(50)]
    want = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    for limit in (2_000_000, 50):
        tok = WordTokenizer(path("word_bpe_49k.json"), limit)
        got = [x for at in range(0, len(texts), 40) for x in tok.ids(pa.array(texts[at: at + 40]))]
        assert [x.tolist() for x in got] == want


def test_frame(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "word " * 5000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = pack(docs.coalesce(1), path("word_bpe_49k.json"), with_ids=True).collect()
    assert sum(r.length for r in out) == 4 + 1 + 1 + 1 + 5001
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert pack(docs.limit(0), path("word_bpe_49k.json")).count() == 0
