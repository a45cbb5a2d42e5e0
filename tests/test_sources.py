"""Data-model traps: mixed numeric types and missing columns across metric
files, all-null Parquet columns, NaN vs null."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragscope.operators.corpus import normalize_truth
from ragscope.session import scratch_path
from ragscope.sources import exports
from ragscope.sources.files import export_metrics, exported_sessions, load_metrics, read_exported
from ragscope.sources.tables import nan_to_null


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_load_metrics_widens_and_fills(spark):
    base = _local(scratch_path(spark, "t-load"))
    import os
    os.makedirs(base, exist_ok=True)
    pq.write_table(pa.table({"session_id": ["a", "a"], "latency_ms": [1, 2]}), f"{base}/x_langfuse_export_a.parquet")
    pq.write_table(pa.table({"session_id": ["b"], "latency_ms": [2.5], "score_x": [0.5]}),
                   f"{base}/y_langfuse_export_b.parquet")
    pq.write_table(pa.table({"session_id": ["c"], "latency_ms": [3]}), f"{base}/z_other.parquet")
    df = load_metrics(spark, folder=base)
    assert dict(df.dtypes)["latency_ms"] == "double"
    rows = sorted((r["session_id"], r["latency_ms"], r["score_x"]) for r in df.collect())
    assert rows == [("a", 1.0, None), ("a", 2.0, None), ("b", 2.5, 0.5)]
    # a file named explicitly and by the glob is read twice, like the reference
    both = load_metrics(spark, paths=[f"{base}/x_langfuse_export_a.parquet"], folder=base)
    assert both.count() == 5
    with pytest.raises(ValueError):
        load_metrics(spark)
    with pytest.raises(FileNotFoundError):
        load_metrics(spark, folder=base, pattern="*nothing*")


def test_incremental_export(spark):
    path = scratch_path(spark, "t-export")
    odd = "run:1 a=b%"  # needs escaping in a folder name
    df = spark.createDataFrame([("s1", 1.0), ("s2", 2.0), (odd, 3.0)], "session_id string, v double")
    names = lambda f: sorted(r[0] for r in f.collect())
    assert names(export_metrics(df.where("session_id <> 's2'"), path)) == [odd, "s1"]
    assert names(export_metrics(df, path, skip_existing=True)) == ["s2"]
    assert names(exported_sessions(spark, path)) == [odd, "s1", "s2"]
    assert names(read_exported(spark, path).select("session_id")) == [odd, "s1", "s2"]


def test_a_run_that_dies_before_its_commit_shows_nothing(spark, monkeypatch):
    path = scratch_path(spark, "t-export-dies")
    df = spark.createDataFrame([("s1", i) for i in range(50)] + [("s2", 9)], "session_id string, v int")

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(exports, "_commit", dies)
        with pytest.raises(OSError):
            export_metrics(df, path)
    with pytest.raises(FileNotFoundError):
        load_metrics(spark, folder=path)
    assert exported_sessions(spark, path).count() == 0
    assert export_metrics(df, path, skip_existing=True).count() == 2
    assert sorted(r.v for r in read_exported(spark, path).collect()) == sorted([*range(50), 9])
    with monkeypatch.context() as m:  # committed, but not moved
        m.setattr(exports, "_publish", lambda *_: None)
        export_metrics(spark.createDataFrame([("s3", 70), ("s1", 71)], "session_id string, v int"), path)
    rows = sorted((r.session_id, r.v) for r in load_metrics(spark, folder=path).collect())
    assert rows == [("s1", 71), ("s2", 9), ("s3", 70)]  # the last export of s1 replaces the first
    assert export_metrics(df, path, skip_existing=True).count() == 0  # moves what the run before left
    assert sorted((r.session_id, r.v) for r in load_metrics(spark, folder=path).collect()) == rows
    names = [f.rsplit("/", 1)[1] for f in exports.list_files(spark, path, "*.parquet")]
    assert sorted({n.split("_langfuse_export_")[1].split("_")[0] for n in names}) == ["s1", "s2", "s3"]
    recorded = {r.session: r.n for r in exports.current(spark, path).where("live").groupBy("session").agg(F.sum("rows").alias("n")).collect()}
    assert recorded == {"s1": 1, "s2": 1, "s3": 1}


def test_runs_at_the_same_time(spark):
    import threading

    path = scratch_path(spark, "t-export-both")
    df = spark.createDataFrame([(f"s{i % 5}", i) for i in range(200)], "session_id string, v int")
    runs = [threading.Thread(target=export_metrics, args=(df, path)) for _ in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert sorted(r.v for r in read_exported(spark, path).collect()) == list(range(200))
    assert exports.record(spark, path).select("run").distinct().count() == 2
    assert exports.list_files(spark, f"{path}/{exports.STAGING}", "*") == []


def test_all_null_columns_and_nan(spark):
    base = _local(scratch_path(spark, "t-truth"))
    import os
    os.makedirs(base, exist_ok=True)
    pq.write_table(pa.table({"id": ["1"], "expected_label": pa.array([None], pa.null()),
                             "evidence": pa.array([[]], pa.list_(pa.null()))}), f"{base}/gt.parquet")
    t = normalize_truth(spark.read.parquet(f"{base}/gt.parquet"))
    assert dict(t.dtypes)["expected_label"] == "string"
    assert t.schema["evidence"].dataType.elementType.fieldNames() == ["doc_id", "doc_title", "sentences"]
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,), (3.0,)], "x double"))
    r = df.agg(F.avg("x").alias("m"), F.max("x").alias("mx")).first()
    assert (r["m"], r["mx"]) == (2.0, 3.0)
