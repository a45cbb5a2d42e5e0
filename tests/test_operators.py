"""Operator invariants against pandas / numpy brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragscope.operators.corpus import ragbench_corpus, scifact_corpus, scifact_truth
from ragscope.operators.ordering import group_rank, with_ordinal
from ragscope.operators.outliers import exclude_outliers, find_outliers, outlier_bounds
from ragscope.operators.quantiles import quantiles
from ragscope.operators.retrieval import top_k
from ragscope.operators.stats import stat_by_group


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = np.random.default_rng(3)
    n = 3000
    g = np.where(rnd.random(n) < 0.6, "hot", rnd.choice(["a", "b", "c"], n))  # one group holds most rows
    v = rnd.normal(10, 3, n).round(2)
    v[::37] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v, "w": rnd.integers(0, 50, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).select("g", F.nanvl("v", F.lit(None)).alias("v"), "w")


def test_quantiles_match_pandas(skewed):
    pdf, df = skewed
    got = quantiles(df, ["v", "w"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], by=["g"]).toPandas()
    for _, r in got.iterrows():
        exp = pdf.loc[pdf.g == r["g"], r["metric"]].quantile(r["p"])
        assert r["q"] == pytest.approx(exp, rel=1e-12, abs=1e-9)


def test_group_rank_matches_cumcount(skewed):
    pdf, df = skewed
    d = df.withColumn("id", F.monotonically_increasing_id()).cache()
    got = group_rank(d, ["g"], ["w", "id"], "rk").toPandas().sort_values(["g", "w", "id"])
    got["exp"] = got.groupby("g").cumcount()
    assert (got["rk"] == got["exp"]).all()
    o = with_ordinal(d, ["id"], "o").toPandas().sort_values("id")
    assert list(o["o"]) == list(range(len(o)))


def test_outliers_bounds_and_filter(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(i, v, 5.0) for i, v in enumerate(vals)], "id long, x double, flat double")
    b = outlier_bounds(df, ["x", "flat"], "iqr", 1.5).first()
    q1, q3 = np.nanpercentile([v for v in vals if v is not None], [25, 75])
    assert b["x__lower"] == pytest.approx(q1 - 1.5 * (q3 - q1))
    assert b["flat__lower"] is None  # zero spread disables the rule
    kept = exclude_outliers(df, ["x", "flat"], threshold=1.5)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]  # null kept
    f = find_outliers(df, ["x", "flat"], threshold=1.5, id_cols=["id"]).collect()
    assert [(r["outlier_col"], r["id"]) for r in f] == [("x", 7)]


def test_stat_by_group_reindex(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    rows = stat_by_group(df, ["x"], "g", order=["b", "zz", "a"], stat="p50", std=True).orderBy("_ord").collect()
    assert [r["g"] for r in rows] == ["b", "zz", "a"]
    assert rows[1]["value"] is None and rows[2]["value"] == 2.0


def test_topk_blocks_match_bruteforce(spark):
    rnd = np.random.default_rng(5)
    m = rnd.normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "id long, embedding array<float>")
    one = top_k(df, df, k=4, query_id="id", doc_id="id", exclude_self=True).toPandas()
    many = top_k(df, df, k=4, query_id="id", doc_id="id", exclude_self=True, block_bytes=2000).toPandas()
    x = m.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for q in range(len(m)):
        exp = list(np.lexsort((np.arange(len(m)), -s[q]))[:4])
        for got in (one, many):
            g = got[got.query_id == q].sort_values("rank")
            assert list(g.doc_id) == exp and list(g["rank"]) == [1, 2, 3, 4]


def test_ragbench_dedup_first_occurrence(spark):
    rows = [("r1", 0, "alpha"), ("r1", 1, ""), ("r2", 0, "beta"), ("r2", 1, "alpha"), ("r0", 5, "alpha")]
    df = spark.createDataFrame(rows, "row_id string, pos int, text string")
    out = {r["text"]: r for r in ragbench_corpus(df).collect()}
    assert set(out) == {"alpha", "beta"}
    assert out["alpha"]["first_row"] == "r0" and out["alpha"]["n_occurrences"] == 3
    assert out["alpha"]["doc_id"].startswith("doc_") and len(out["alpha"]["doc_id"]) == 16


def test_scifact_transforms(spark):
    corpus = spark.createDataFrame([(1, "T", ["A b.", "C d."], True), (2, "U", [], None)],
                                   "doc_id int, title string, abstract array<string>, structured boolean")
    c = {r["id"]: r for r in scifact_corpus(corpus).collect()}
    assert c["1"]["text"] == "A b. C d." and c["1"]["sentence_count"] == 2 and c["2"]["structured"] is False
    claims = spark.createDataFrame([
        (1, "x", [(10, [0, 1], "SUPPORT")], [10]),
        (2, "y", [], [11]),
        (3, "z", [(10, [2], "SUPPORT"), (12, [0], "CONTRADICT")], []),
        (4, "w", [], []),
        (5, "v", [(10, [1], None)], []),
    ], "id int, claim string, evidences array<struct<doc_id:int,sentence_ids:array<int>,label:string>>, "
       "cited_doc_ids array<int>")
    t = {r["id"]: r for r in scifact_truth(claims).collect()}
    assert [t[k]["expected_label"] for k in "12345"] == ["SUPPORT", "SUPPORT", "CONTRADICT", "NOT_ENOUGH_INFO",
                                                          "SUPPORT"]
    assert t["3"]["evidence"][1]["doc_id"] == "12"
    assert t["1"]["evidence"][0]["sentences"][0]["sentence_indices"] == [0, 1]


def test_quantiles_of_ties_and_null_groups(spark):
    """Nine tenths of all rows are one value; null is a group."""
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("a")).alias("g"),
        F.when(F.col("id") % 10 != 1, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("v"))
    ids = np.arange(n)
    v = np.where(ids % 10 != 1, 7.0, ids)
    got = {(r.g, r.p): r.q for r in quantiles(df, ["v"], [0.0, 0.5, 0.9, 0.95, 0.999, 1.0], by=["g"]).collect()}
    assert len(got) == 12
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(v[(ids % 3 == 0) == (g is None)], p), rel=1e-12)


@pytest.mark.parametrize("advisory", ["1m", "64m"])
def test_ranks_at_a_million_rows(spark, advisory):
    """A wide extra column, a hot key and ties: every row once, ranks without gaps."""
    n, key = 1_000_000, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, advisory)
    try:
        df = spark.range(n).select(
            "id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("b").alias("g"),
            (F.col("id") % 11).alias("w"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("text"))
        r = group_rank(df, ["g"], ["w"], "rk")
        own = r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rk").alias("d"), F.min("rk").alias("lo"), F.max("rk").alias("hi")).collect()
        assert sum(x.n for x in own) == n and all(x.n == x.d == x.hi + 1 and x.lo == 0 for x in own) and len(own) == 3
        o = with_ordinal(df.select("id", "text"), ["id"], "o").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == F.col("o")).alias("same")).first()
        assert o.n == o.same == n
    finally:
        spark.conf.set(key, before)


def test_evidence_helpers_and_loader_registry(spark):
    from ragscope.operators.corpus import evidence_for, evidence_sentences, load_dataset

    ev = ("array<struct<doc_id:string,doc_title:string,sentences:array<struct<sentence_indices:array<int>,"
          "sentence_texts:array<string>,label:string>>>>")
    df = spark.createDataFrame([([("d1", None, [([0], ["s1", "s2"], "SUPPORT")]),
                                  ("d2", "T", [([1], ["s3"], "SUPPORT"), ([2], ["s4"], "SUPPORT")])],)],
                               f"evidence {ev}")
    r = df.select(evidence_sentences("evidence").alias("s"), evidence_for("evidence", "d2").alias("e"),
                  evidence_for("evidence", "zz").alias("none")).first()
    assert r["s"] == ["s1", "s2", "s3", "s4"] and r["e"]["doc_title"] == "T" and r["none"] is None
    with pytest.raises(ValueError):
        load_dataset("nope", None)


def test_select_traces_and_lookup(spark):
    from ragscope.sources.files import iter_batches, lookup, select_traces

    spans = spark.createDataFrame([("t1", "rag.evaluation", 10), ("t1", "rag.retrieval", 10),
                                   ("t2", "rag.evaluation", 50)], "trace_id string, name string, start_time_unix_nano long")
    got = select_traces(spans, spark.createDataFrame([("t1",)], "trace_id string"), start_ns=0, end_ns=20).collect()
    assert [r["trace_id"] for r in got] == ["t1"]
    docs = spark.createDataFrame([(str(i), f"t{i}") for i in range(10)], "id string, text string")
    assert sorted(r["id"] for r in lookup(docs, ["3", "7", "x"]).collect()) == ["3", "7"]
    assert sum(len(b) for b in iter_batches(docs, 4)) == 10


def test_topk_hits_feed_array_metrics(spark):
    from ragscope.operators.retrieval import hits_arrays
    from ragscope.operators.scoring import score_runs

    rnd = np.random.default_rng(11)
    m = rnd.normal(size=(60, 6)).astype(np.float32)
    lab = rnd.integers(0, 4, 60)
    df = spark.createDataFrame([(i, m[i].tolist(), int(lab[i])) for i in range(60)],
                               "id long, embedding array<float>, label int")
    hits = hits_arrays(top_k(df, df, k=5, query_id="id", doc_id="id", exclude_self=True))
    rel = df.groupBy("label").agg(F.collect_list("id").alias("members"))
    q = (df.select(F.col("id").alias("query_id"), "label").join(rel, "label")
         .join(hits, "query_id").withColumn("relevant", F.array_remove("members", F.col("query_id")))
         .withColumn("output", F.lit("answer")))
    got = {r["query_id"]: r for r in score_runs(q, k=5).collect()}
    for qid, r in got.items():
        ret, relevant = list(r["retrieved"]), set(r["relevant"])
        top = list(dict.fromkeys(ret))[:5]
        hits_n = sum(1 for d in top if d in relevant)
        if not relevant:
            assert r["recall_at_k"] is None
            continue
        assert r["recall_at_k"] == pytest.approx(hits_n / len(relevant))
        assert r["precision_at_k"] == pytest.approx(hits_n / len(top))
        first = next((i for i, d in enumerate(ret, 1) if d in relevant), None)
        assert r["mrr"] == pytest.approx(1 / first if first else 0.0)


def test_heatmap_and_profiles_in_requested_order(spark):
    from ragscope.operators.reshape import cell_pivot, profiles

    df = spark.createDataFrame([("r1", "c1", 1.0), ("r1", "c2", 3.0), ("r2", "c2", 5.0), ("r2", "c2", 7.0), ("r3", "c3", 9.0)], "run string, claim string, x double")
    got = cell_pivot(df, "x", "run", "claim", "mean", ["r2", "r9", "r1"], ["c3", "c9", "c2"])
    assert got.columns == ["claim", "r2", "r1", "_row"]
    assert [tuple(r) for r in got.orderBy("_row").collect()] == [("c3", None, None, 0), ("c2", 6.0, 3.0, 2)]
    long = profiles(df, "x", "run", "claim", "max", ["r1", "r2"], False, ["c2"]).orderBy("_ord").collect()
    assert [(r.claim, r.run, r.value, r._row) for r in long] == [("c2", "r1", 3.0, 0), ("c2", "r2", 7.0, 0)]
    with pytest.raises(ValueError):
        cell_pivot(df, "x", "run", "claim", "mode")


def test_eval_grid_is_the_same_in_any_block_size(spark):
    from ragscope.operators.scoring import eval_grid

    cfg = spark.createDataFrame([(f"r{i}", i % 3 + 1 if i else None, i * 2 if i % 2 else None) for i in range(7)], "run_id string, repeat int, limit long")
    entries = spark.range(9).withColumnRenamed("id", "claim")
    rows = lambda n: sorted(map(tuple, eval_grid(cfg, entries, ["claim"], block_size=n).collect()))
    assert rows(2) == rows(100) and len(rows(100)) == sum(((i % 3 + 1) if i else 1) * (min(9, i * 2) if i % 2 else 9) for i in range(7))
    assert eval_grid(cfg.limit(0), entries, ["claim"]).count() == 0


def test_quantiles_of_small_and_hot_groups(spark):
    """Groups of one to a few rows, a value that fills a group, one group with most of the rows, NaN and infinities."""
    rng = np.random.default_rng(12)
    rows = [(g, float(x), None if x < -1 else float(round(x))) for g in range(12) for x in rng.normal(size=g)]
    rows += [(50, 1.0, 1.0)] * 3000 + [(50, float(x), 2.0) for x in range(7)] + [(51, float(x), float(x)) for x in rng.normal(size=30_000)]
    rows += [(52, float("nan"), None)] * 5 + [(53, 9.0, -8.5), (53, 2.0, 3.0), (53, float("nan"), 4.0)]
    pdf = pd.DataFrame(rows, columns=["metric", "v", "total"])  # names that the operator uses itself
    df = spark.createDataFrame(rows, "metric int, v double, total double").repartition(6)
    probs = [0.0, 0.001, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    got = {(r[0], r[1], r[2]): r[3] for r in quantiles(df.withColumnRenamed("metric", "g"), ["v", "total"], probs, by=["g"]).collect()}
    for g, own in pdf.groupby("metric"):
        for c in ("v", "total"):
            x = own[c].dropna()
            assert len(x) or (g, c, 0.5) not in got
            for p in probs if len(x) else []:
                want = x.quantile(p)
                assert got[g, c, p] == pytest.approx(want, rel=1e-12, nan_ok=True)
    whole = {r.p: r.q for r in quantiles(df, ["total"], probs).collect()}
    assert whole == {p: pytest.approx(pdf["total"].quantile(p), rel=1e-12) for p in probs}
