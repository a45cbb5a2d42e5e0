"""Statistics against Python; rules on planted labels; edge cases."""

import random
import re

import numpy as np

from ragscope.llm.quality_rules import BASE, P, DecisionList, cover, held_out, judge, keep_good, learn, with_stats


def stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, where = set(), {}
    dup = 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i: i + 8]), []).append(i)
    hit = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(hit)}


def texts():
    rng = random.Random(17)
    pieces = ["a", "bé", "日", " ", " ", "\n", "\t", "#", "x|", "the same line", "\r", " "]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    return [*out, None, "", " \n ", "one " * 3000, "l1 a\nl2 b\nl1 a\nl1 a"]


def test_statistics(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, "x y", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    got = {r.doc_id: {c: r[P + c] for c in BASE} for r in with_stats(df, ["x"]).collect()}
    assert got == {d: stats(t) for d, t, _ in rows}


def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randint(25, 80))]
        kind = rng.choice(["good", "good", "symbols", "rude", "short"])
        if kind == "symbols":
            w = [x + rng.choice("#|") for x in w]
        if kind == "rude":
            w[3] = w[9] = rng.choice(["Nasty,", "vile"])
        if kind == "short":
            w = w[:10]
        docs.append((i, " ".join(w), kind))
        if i % 2:
            labels.append((i, int(kind not in ("symbols", "short")), int(kind == "rude")))
    return docs, labels


def test_learned_rules_find_planted_kinds(spark):
    docs, labels = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string, rule string")
    ldf = spark.createDataFrame([*labels, labels[0], (None, 0, 0), (1, None, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    rules = learn(df, ldf)
    assert {"nasty", "vile"} <= set(rules.words) and rules.rules
    got = judge(df, rules).collect()
    for kind in ("symbols", "rude"):
        own = [r for r in got if r.rule == kind]
        assert sum(not r[P + "kept"] for r in own) > 0.9 * len(own)
    good = [r for r in got if r.rule == "good"]
    assert sum(r[P + "kept"] for r in good) > 0.97 * len(good)
    assert all(r[P + "base_failed"] and not r[P + "kept"] for r in got if r.rule == "short")
    kept = keep_good(df, rules)
    assert kept.columns == df.columns and kept.count() == sum(r[P + "kept"] for r in got)


def test_no_labels_reject_nothing(spark):
    docs, _ = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string, rule string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = learn(df, none)
    assert rules.rules == [] and rules.sql() == "false"
    assert judge(df, rules).where(P + "rule <> 0").count() == 0
    assert keep_good(df.limit(0), rules).count() == 0


def test_covering_is_ordered_and_precise():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    y = (x["a"] > 0.8) | ((x["b"] <= 0.2) & (x["a"] > 0.4))
    rules = cover(x, y, np.arange(2000) % 3 == 0)
    hit = np.zeros(2000, dtype=bool)
    for r in rules:
        m = np.ones(2000, dtype=bool)
        for f, op, v in r:
            m &= x[f] <= v if op == "<=" else x[f] > v
        hit |= m
    assert (hit & ~y).sum() < 0.03 * y.sum() and (hit & y).sum() > 0.9 * y.sum()
    assert DecisionList([[("words", ">", 3.0)]], []).sql().startswith("CASE WHEN (CAST")


def test_listed_words_with_many_marks_count(spark):
    texts_ = ["word!!!!", "((((((word", "****word****", "word", "WORD?!?!?!", "!!!!!!", "wo!!!!rd", "\x01word", "x !!!! word.....\n-----word y", ""]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = {r.doc_id: r[P + "n_listed"] for r in with_stats(df, ["word"]).collect()}
    assert [got[i] for i in range(len(texts_))] == [1, 1, 1, 1, 1, 0, 0, 0, 2, 0]


def test_held_out_labels(spark):
    docs, labels = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    got = [held_out(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folds=3, fold=f) for f in range(3)]
    total = {k: sum(g[k] for g in got) for k in got[0]}
    assert total["rejected_bad"] >= 0.8 * (total["rejected_bad"] + total["kept_bad"])
    assert total["rejected_bad"] >= 0.9 * (total["rejected_bad"] + total["rejected_good"])
    assert total["kept_good"] > 0
