"""Hand-checked metric cases (dedup before the cut, MRR on the raw list)."""

import pytest
from pyspark.sql import functions as F

from ragscope.functions import irmetrics as M
from ragscope.functions.text import is_abstention
from ragscope.operators.scoring import abstention_rate, run_quality, score_runs


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def arr(xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


@pytest.mark.parametrize("ret,rel,k,exp", [
    (["d1", "d2", "d3"], ["d1", "d3", "d5", "d6"], 3, 0.5),
    (["d1", "d1", "d2"], ["d1", "d2"], 2, 1.0),
    (["d1", "d1"], ["d1", "d2"], 2, 0.5),
    (["d1"], [], 3, 0.0),
    ([], ["d1"], 3, 0.0),
])
def test_recall(spark, ret, rel, k, exp):
    assert _one(spark, M.recall_at_k(arr(ret), arr(rel), k)) == pytest.approx(exp)


@pytest.mark.parametrize("ret,rel,k,exp", [
    (["d1", "d1"], ["d1"], 2, 1.0),
    (["d1", "d1", "d2"], ["d2"], 2, 0.5),
    ([], ["d1"], 2, 0.0),
    (["d1", "d2", "d3"], ["d1", "d2"], 3, 2 / 3),
])
def test_precision(spark, ret, rel, k, exp):
    assert _one(spark, M.precision_at_k(arr(ret), arr(rel), k)) == pytest.approx(exp)


@pytest.mark.parametrize("ret,rel,exp", [
    (["d4", "d5", "d1"], ["d1"], 1 / 3),
    (["d4", "d5"], ["d1"], 0.0),
    (["d1", "d1", "d2"], ["d2"], 1 / 3),  # position on the raw list
    ([], ["d1"], 0.0),
    (["d1"], [], 0.0),
])
def test_mrr(spark, ret, rel, exp):
    assert _one(spark, M.mrr(arr(ret), arr(rel))) == pytest.approx(exp)


def test_k_must_be_positive():
    with pytest.raises(ValueError):
        M.recall_at_k(arr(["a"]), arr(["a"]), 0)


def test_runner_case_and_null_rule(spark):
    df = spark.createDataFrame(
        [("c1", ["doc_1", "doc_3", "doc_4"], ["doc_1", "doc_2"], "An answer"),
         ("c2", ["doc_1"], [], "  "),
         ("c3", ["doc_9"], ["doc_9"], "There is INSUFFICIENT information here")],
        "claim_id string, retrieved array<string>, relevant array<string>, output string")
    rows = {r["claim_id"]: r for r in score_runs(df, k=3).collect()}
    assert rows["c1"]["recall_at_k"] == pytest.approx(0.5)
    assert rows["c1"]["precision_at_k"] == pytest.approx(1 / 3)
    assert rows["c1"]["mrr"] == pytest.approx(1.0)
    assert rows["c1"]["retrieval_k"] == 3 and rows["c1"]["cited_doc_ids"] == "doc_1,doc_3,doc_4"
    assert rows["c2"]["recall_at_k"] is None and rows["c2"]["mrr"] is None
    assert rows["c2"]["is_abstention"] and rows["c3"]["is_abstention"] and not rows["c1"]["is_abstention"]
    q = run_quality(score_runs(df, k=3), keys=()).first()
    assert q["n_results"] == 3 and q["n_scored"] == 2 and q["abstentions"] == 2
    assert q["recall_at_k"] == pytest.approx(0.75)


def test_abstention_rate(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), ("a", "Insufficient information."), ("a", "ok")],
                               "k string, o string")
    assert abstention_rate(df, "o").first()["abstention_rate"] == pytest.approx(0.5)
    empty = spark.createDataFrame([], "k string, o string")
    assert abstention_rate(empty, "o").first()["abstention_rate"] == 0.0


def test_unicode_blank_is_abstention(spark):
    assert _one(spark, is_abstention(F.lit(" \n\t "))) is True
