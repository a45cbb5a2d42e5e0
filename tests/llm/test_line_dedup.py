"""Chunks, repeats and their extension against a dictionary of chunk bytes; recall against all repeated runs."""

import random

import numpy as np

from ragscope.llm.line_dedup import P, dedup, find_chunks, remove_repeats
from tests.conftest import SF_SMALL


def spans(lines):
    """(at, end, before, after) of the chunks of one document."""
    c = find_chunks(lines, np.array([0, len(lines)]))
    return list(zip(*[c[k].tolist() for k in ("at", "end", "before", "after")], strict=True))


def brute(docs):
    """Text and removed lines of each (id, text), in document order."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = {}, {}
    for d, t in order:
        lines, gone = (t or "").encode().split(b"\n"), set()
        for at, end, before, after in sorted(spans(lines)):
            body = b"\n".join(lines[at:end])
            own, there, start, left, right = seen.setdefault(body, (d, lines, at, before, after))
            if own == d and at < start + end - at:
                continue
            lo, hi = at, end
            while at - lo < min(before, left) and lines[lo - 1] == there[start + lo - at - 1]:
                lo -= 1
            while hi - end < min(after, right) and lines[hi] == there[start + hi - at]:
                hi += 1
            gone |= set(range(lo, hi))
        keep = [x for i, x in enumerate(lines) if i not in gone]
        out[(d, t)] = (None if t is None else b"\n".join(keep).decode(), len(gone))
    return out


def repeated_runs(docs):
    """Per id the lines in runs of which each neighbouring pair of lines occurs before."""
    first, out = {}, {}
    for d, t in sorted(docs):
        lines, out[d] = (t or "").split("\n"), set()
        for at in range(len(lines) - 1):
            pair = (lines[at], lines[at + 1])
            f = first.setdefault(pair, (d, at))
            if "".join(pair).strip() and (f[0] != d or at >= f[1] + 2):
                out[d] |= {at, at + 1}
    return out


def data():
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("abcdeé") for _ in range(5))
    passages = [[line() for _ in range(rng.randint(2, 12))] for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [[line() for _ in range(rng.randint(0, 5))], rng.choice(passages), [line()], [""] * rng.randint(0, 4)]
        rng.shuffle(parts)
        docs.append((i, "\n".join(sum(parts, []))))
    return docs + [(200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (204, "\n\n\n\n"), (205, "one line"), (206, "same\n" * 500), (206, "same\n" * 500), (None, docs[4][1])]


def test_chunks_are_shift_resistant():
    rng = random.Random(2)
    lines = [str(rng.random()).encode() for _ in range(400)]
    bodies = lambda ls: {b"\n".join(ls[a:e]) for a, e, _, _ in spans(ls)}
    assert bodies(lines[100:300]) <= bodies([b"new", *lines, b"end"])
    for ls in (lines, [b"x"] * 300, [b""], [b"x"] * 50 + [b"y"] * 50):
        for a, e, before, after in spans(ls):
            assert 0 <= a - before and a + 2 <= e and e + after <= len(ls)
        assert sum(e - a + b + f for a, e, b, f in spans(ls)) <= 8 * len(ls)


def test_documents_of_a_slice_do_not_mix():
    rng = random.Random(3)
    texts = [[rng.choice([b"a", b"b", b"", b"c d", b"e"]) for _ in range(rng.randint(1, 40))] for _ in range(50)]
    first = np.cumsum([0, *map(len, texts)])
    c = find_chunks([x for t in texts for x in t], first)
    for i, t in enumerate(texts):
        own = c["doc"] == i
        got = list(zip((c["at"][own] - first[i]).tolist(), (c["end"][own] - first[i]).tolist(), c["before"][own].tolist(), c["after"][own].tolist(), strict=True))
        assert got == spans(t)
        assert c["hash"][own].tolist() == find_chunks(t, np.array([0, len(t)]))["hash"].tolist()


def test_against_brute_force(spark):
    docs = data()
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, spans string, hash int").repartition(5)
    want = brute(docs)
    rows = df.collect()
    assert len(rows) == len(docs)
    got = remove_repeats(df).collect()
    assert len(got) == len(docs) and all(r.spans == "s" and r.hash == 1 for r in got)
    assert sorted(((r.doc_id, r.text, r[P + "removed"]) for r in got), key=str) == sorted(((d, *want[(d, t)]) for d, t in docs), key=str)
    left = dedup(df)
    assert left.columns == df.columns
    kept = {r.doc_id for r in left.collect()}
    assert {202, 203, 204, 205} <= kept and not {200, 201} & kept - {d for d, t in docs if (want[(d, t)][0] or '').strip()}
    assert remove_repeats(df.limit(0)).count() == 0


def _recall(docs, texts):
    """Share of the lines in repeated runs that were cut, and whether others were."""
    want, cut, all_ = repeated_runs(docs), 0, 0
    kept = brute(docs)
    assert texts == {d: kept[(d, t)][0] for d, t in docs}
    for d, t in docs:
        all_ += len(want[d])
        cut += kept[(d, t)][1]
        assert kept[(d, t)][1] <= len(want[d])
    return cut / all_


def test_repeated_runs_are_cut(spark):
    rng = random.Random(12)
    shared = [[f"passage {p} line {i}" for i in range(rng.choice([2, 2, 3, 5, 9, 30]))] for p in range(400)]
    docs = []
    for d in range(400):
        parts = [[f"own {d} {j}"] for j in range(6)] + rng.sample(shared, 3)
        rng.shuffle(parts)
        docs.append((d, "\n".join(sum(parts, []))))
    docs += [(900, "same\n" * 6), (901, "a\nb\na\nb\na"), (902, "\n\n\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert _recall(docs, {r.doc_id: r.text for r in remove_repeats(df).collect()}) >= 0.9


def test_repeated_runs_of_the_tables_are_cut(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert _recall(docs, {r.doc_id: r.text for r in remove_repeats(df).collect()}) >= 0.9


def test_extension_starts_at_chunks_only():
    """A repeated run without a chunk stays; one with a chunk goes whole."""
    rng = random.Random(5)
    for _ in range(300):
        run = [str(rng.random()) for _ in range(rng.randint(2, 5))]
        docs = [(0, "\n".join(["p", *run, "q"])), (1, "\n".join(["r", *run, "s"]))]
        has = bool(spans([x.encode() for x in run]))
        assert brute(docs)[docs[1]] == (("r\ns", len(run)) if has else (docs[1][1], 0))
