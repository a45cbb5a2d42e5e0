"""Stages on the smallest tables, each against a brute-force version on its own input."""

import pytest

import corpus_pipeline as cp
from ragscope.llm import quality_rules
from ragscope.llm.jobs import read, saved
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as repeats
from tests.llm.test_quality_rules import stats


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, SF_SMALL, "documents"), []
    for name, stage in cp.STAGES:
        nxt = saved(stage(spark, docs, SF_SMALL), "test")
        out.append((name, docs, nxt))
        docs = nxt
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == stages[0][1].columns and 0 < after.count() <= before.count()


def test_quality(spark, stages):
    _, before, after = stages[0]
    rules = quality_rules.learn(before, read(spark, SF_SMALL, "labels"))
    rejected = {r.doc_id for r in quality_rules.judge(before, rules).where("_q_rule > 0").select("doc_id").collect()}
    base = {d for d, t in rows(before) if (s := stats(t))["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]}
    assert {d for d, _ in rows(before)} - {d for d, _ in rows(after)} == rejected | base


def test_lines(stages):
    _, before, after = stages[1]
    want = {d: t for (d, _), (t, gone) in repeats(rows(before)).items() if not gone or t.strip()}
    assert dict(rows(after)) == want


def test_near_copies(stages):
    _, before, after = stages[2]
    docs, kept = rows(before), {d for d, _ in rows(after)}
    sets = {}
    for d, t in docs:
        w = t.lower().split()
        sets[d] = {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    by_token = {}
    for d in ids:
        for s in sets[d]:
            by_token.setdefault(s, []).append(d)
    for pair in {(a, b) for own in by_token.values() if len(own) > 1 for a in own for b in own if a < b}:
        a, b = (sets[x] for x in pair)
        i = len(a & b)
        if 100 * i >= 80 * (len(a) + len(b) - i):
            x, y = sorted(top(z) for z in pair)
            root[y] = x
    assert kept == {top(d) for d in ids}


def test_benchmark(spark, stages):
    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in read(spark, SF_SMALL, "benchmark").collect()]
    hit = {d: n for d, _, n, _ in leaks(rows(before), items)}
    kept = dict(rows(after))
    for d, t in rows(before):
        if not hit[d]:
            assert kept[d] == t
        elif d in kept:
            assert len(kept[d]) < len(t)
    assert any(hit.values())


def test_packed_whole(stages):
    _, before, after = stages[4]
    got = {}
    for r in after.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {d for d, _ in rows(before)}
    for own in got.values():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == own[0].doc_tokens


def test_run_gives_the_last_stage(spark, stages):
    count = lambda df: (df.count(), df.agg({"length": "sum"}).first()[0])
    assert count(cp.run(spark, SF_SMALL)) == count(stages[-1][2])
