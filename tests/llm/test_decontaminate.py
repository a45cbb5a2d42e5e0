"""Windows found with the FM-index against a word-by-word search."""

import random
import re

import pytest

from ragscope.llm.decontaminate import P, cut, find, n_hit

RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return RE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i: i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i: i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    got |= own
        out.append((d, len(w), len(hit), tuple(sorted(str(x) for x in got if x is not None))))
    return sorted(out, key=str)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "and", "a", "Ü", "b2", "x"])
    text = lambda n: rng.choice([" ", "-", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(1, 20) if i % 5] + [(50, ""), (51, None), (1, "of the"), (None, "b2 b2 b2 b2")]
    items = [(i, t) for i, t in items if t is None or len(words(t)) != 1]
    docs = [(i, text(rng.choice([0, 1, 5, 40])) + " zz " + rng.choice(items)[1].__str__() + " q " + text(5)) for i in range(120)]
    return docs + [(200, None), (201, ""), (202, "no such words"), (5, docs[5][1]), (None, docs[7][1])], items


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_against_brute_force(spark, block_bytes):
    docs, items = data()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find(df, bench, block_bytes=block_bytes)
    got = found.select("doc_id", P + "words", n_hit().alias("n"), P + "items", "spans").collect()
    assert all(r.spans == "x" for r in got)
    assert sorted(((r[0], r[1], r[2], tuple(r[3])) for r in got), key=str) == brute(docs, items)
    clean = {r.doc_id: r for r in cut(found).collect()}
    assert clean[202].text == "no such words" and clean[200].text is None and clean[201].text == ""
    for d, n_words, n, _ in brute(docs, items):
        if n and n < n_words:
            assert len(words(clean[d].text)) == n_words - n
        elif n:
            assert d not in clean


def test_empty(spark):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert find(df.limit(0), bench).count() == 0
    assert find(df, bench.limit(0)).where(n_hit() > 0).count() == 0
