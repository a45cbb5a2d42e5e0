"""Embedding, catalog and scrape-counter operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragscope.functions.text import collection_name, glob_to_regex, model_name
from ragscope.operators.catalog import build_plan, config_fingerprint, resolve_collections, scrape_counters
from ragscope.operators.embed import HashingEmbedder, embed, with_progress


def test_hashing_embedder_unit_norm():
    v = HashingEmbedder(16)(["alpha beta", "", "alpha beta"])
    assert v.shape == (3, 16)
    assert np.allclose(np.linalg.norm(v[0]), 1.0) and np.allclose(v[0], v[2]) and not v[1].any()


def test_embed_batches_and_dimension_check(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "id long, text string")
    out, obs = with_progress(embed(df, HashingEmbedder(8), batch_size=32))
    rows = out.collect()
    assert len(rows) == 70 and all(len(r["embedding"]) == 8 for r in rows)
    assert obs.get["rows"] == 70
    with pytest.raises(Exception):
        embed(df, HashingEmbedder(8), dims=4).collect()


def test_naming(spark):
    df = spark.createDataFrame([("org/model-x", "q4", 384)], "m string, q string, d int")
    r = df.select(model_name(F.col("m")).alias("a"), collection_name(F.col("m"), F.col("q"), F.col("d")).alias("b")).first()
    assert (r["a"], r["b"]) == ("model-x", "model-x__q4__384")


def test_catalog_reuse_and_new_names(spark):
    cols = ["model", "quantization", "dimensions", "k"]
    cfg = spark.createDataFrame([("a", "m", "q4", 384, 3), ("b", "m", "q4", 384, 3), ("c", "m", "q4", 384, 5),
                                 ("d", "m", "q8", 384, 3)],
                                "run_id string, model string, quantization string, dimensions int, k int")
    cfg = cfg.withColumn("fingerprint", config_fingerprint(cols))
    first = cfg.where(F.col("run_id") == "a")
    catalog = resolve_collections(first, spark.createDataFrame([], "collection string, fingerprint string"))
    cat = catalog.select("collection", "fingerprint")
    res = {r["run_id"]: r for r in resolve_collections(cfg, cat).collect()}
    assert res["a"]["collection"] == "m__q4__384_1" and not res["a"]["is_new"]
    assert res["b"]["collection"] == "m__q4__384_1"          # same config -> same index
    assert res["c"]["collection"] == "m__q4__384_2" and res["c"]["is_new"]  # k is in the fingerprint
    assert res["d"]["collection"] == "m__q8__384_1"
    plan = {r["run_id"]: r for r in build_plan(resolve_collections(cfg, cat),
                                               spark.createDataFrame([("m__q4__384_1", 10)],
                                                                     "collection string, chunk_count long")).collect()}
    assert plan["a"]["skip_build"] and not plan["c"]["exists"]


def test_scrape_counters(spark):
    text = "# HELP x\nllamacpp:prompt_tokens_total 128\nllamacpp:tokens_predicted_total{a=\"b\"} 3.5\n"
    df = spark.createDataFrame([(text,)], "t string")
    r = scrape_counters(df, "t", ["llamacpp:prompt_tokens_total", "llamacpp:tokens_predicted_total",
                                  "llamacpp:missing"]).first()
    assert r["llamacpp_prompt_tokens_total"] == 128.0 and r["llamacpp_tokens_predicted_total"] == 3.5
    assert r["llamacpp_missing"] == 0.0


def test_glob_to_regex():
    import re
    rx = re.compile(glob_to_regex("run_1*_s[12]"))
    assert rx.match("run_15_s1") and not rx.match("run_15_s0") and not rx.match("xrun_15_s1")


def test_counters_with_types_and_patterns_in_names(spark):
    df = spark.createDataFrame([("a.b 7\naxb 9\n",), ("a.b{x=\"1\"} 2.5\n",)], "t string")
    got = [tuple(r)[1:] for r in scrape_counters(df, "t", {"a.b": "bigint", "axb": "double"}).collect()]
    assert got == [(7, 9.0), (0, 0.0)]


def test_chunk_signature_and_run_selection(spark):
    import pytest
    from pyspark.sql import functions as F

    from ragscope.operators.catalog import chunk_signature
    from ragscope.sources.files import select_runs

    df = spark.createDataFrame([("fixed", 5, 1, None), ("char_split", None, None, ". "), (None, None, None, None)], "run_id string, a int, b int, c string")
    got = [r[0] for r in df.select(chunk_signature(F.col("run_id"), F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["chunk_size=5;chunk_overlap=1", "split_sequence=. ", "none"]
    assert select_runs(df, "fixed").count() == 1 and select_runs(df, None).count() == 3
    with pytest.raises(ValueError):
        select_runs(df, "none")
