"""Custom stateful trace assembly (Python state, event-time timeout) on a
small fixture: complete traces emit at once, incomplete ones on timeout."""

import os

import pytest
from pyspark.sql import functions as F

from ragscope.plans.oracle_check import compare, duckdb_conn
from ragscope.plans.stream_q import DELIVERIES, QUERIES
from ragscope.session import _session_scratch, scratch_path
from ragscope.streaming import live as L
from tests.conftest import SF_SMALL


def test_assemble_custom_and_window(spark):
    base = scratch_path(spark, "t-stream")
    rows = [("t1", "rag.evaluation", 100), ("t1", "rag.retrieval", 101), ("t2", "rag.evaluation", 100),
            ("t1", "rag.generation", 102), ("__close__", "x", 10 ** 6)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "trace_id string, name string, sec long").write.parquet(f"{base}/in/f{i}")
    schema = "trace_id string, name string, sec long"
    results = {}
    for label, fn in (("custom", L.assemble_traces_custom), ("window", L.assemble_traces)):
        src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
               .withColumn("event_time", F.timestamp_seconds("sec")))
        out = f"{base}/out-{label}"
        L.run_append(fn(src), out, f"{base}/ck-{label}")
        results[label] = {r["trace_id"]: r for r in spark.read.parquet(out).collect()}
    for label, res in results.items():
        assert res["t1"]["complete"] and res["t1"]["n_spans"] == 3, label
        assert not res["t2"]["complete"], label


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_several_micro_batches(spark, name):
    """Every registered stream reads its state back: a batch for each delivery, and the oracle's rows."""
    before = set(os.listdir(_session_scratch(spark))) if os.path.isdir(_session_scratch(spark)) else set()
    r = compare(spark, name, SF_SMALL, duckdb_conn(SF_SMALL))
    assert r["status"] == "ok", r
    made = [d for d in set(os.listdir(_session_scratch(spark))) - before if "-ckpt-" in d]
    assert len(made) == 1
    assert L.batches(os.path.join(_session_scratch(spark), made[0]), spark) >= DELIVERIES


def test_copies_of_a_delivery_land_before_the_next(spark, tmp_path):
    import os

    df = spark.range(40).selectExpr("id", "timestamp_seconds(id) as at")
    L.stage_files(df, f"{tmp_path}/in", "at", 4, copies=2)
    at = {d: min(os.stat(f"{tmp_path}/in/{d}/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/in/{d}") if f.endswith(".parquet")) for d in os.listdir(f"{tmp_path}/in")}
    assert sorted(at, key=at.get) == sorted(at) and len(at) == 8
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/in/000-1").collect()] == [r["id"] for r in spark.read.parquet(f"{tmp_path}/in/000-0").collect()]


def test_deliveries_of_several_files_are_whole_batches(spark, tmp_path):
    # the first partition has early rows only, the last delivery none of its rows
    df = spark.range(0, 90, 1, 3).selectExpr("id", "case when id % 30 <> 7 then timestamp_seconds(id) end as at").coalesce(3)
    L.stage_files(df, f"{tmp_path}/in", "at", 3, parts=8)
    made = {d: spark.read.parquet(f"{tmp_path}/in/{d}") for d in sorted(os.listdir(f"{tmp_path}/in"))}
    n = L.delivery_files(spark, f"{tmp_path}/in/000", df.schema)
    assert n > 1 and len(made) == 3 and all(len(x.inputFiles()) == n for x in made.values())
    rows = [[(r["at"], r["id"]) for r in x.collect()] for x in made.values()]
    assert sorted(i for x in rows for _, i in x) == [*range(90)] and sum(t is None for t, _ in rows[0]) == 3
    times = [[t for t, _ in x if t] for x in rows]
    assert max(times[0]) < min(times[1]) and max(times[1]) < min(times[2])
    L.run_append(L.read_stream(spark, f"{tmp_path}/in/*", df.schema, max_files=n), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert L.batches(f"{tmp_path}/ckpt", spark) == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 90


def test_staging_shuffles_no_row_and_takes_tables_without_times(spark, tmp_path):
    from pyspark.sql import types as T

    empty = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType())])
    for k, rows in enumerate(([], [(1, None), (2, None)])):
        L.stage_files(spark.createDataFrame(rows, empty), f"{tmp_path}/{k}", "at", 4, copies=2, parts=4)
        assert len(os.listdir(f"{tmp_path}/{k}")) == 8
        assert spark.read.parquet(f"{tmp_path}/{k}/*").count() == 2 * len(rows)
    spark.range(1000).selectExpr("id", "timestamp_seconds(id % 10) as at").write.parquet(f"{tmp_path}/table")
    before = set(os.listdir(_session_scratch(spark)))
    L.stage_files(spark.read.parquet(f"{tmp_path}/table"), f"{tmp_path}/in", "at", 4, parts=4)
    assert set(os.listdir(_session_scratch(spark))) == before  # no copy of the rows beside the deliveries
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/in/*").collect()) == [*range(1000)]


def test_state_settings_are_taken_back(spark):
    key = next(iter(L.STATE))
    before = spark.conf.get(key, None)
    with pytest.raises(ValueError), L.configured(spark, L.STATE):
        assert spark.conf.get(key) == "zstd"
        raise ValueError
    assert spark.conf.get(key, None) == before


def test_span_lines_are_written_once_and_by_traces(spark):
    before = set(os.listdir(_session_scratch(spark)))
    QUERIES["span_quarantine"](spark, SF_SMALL).collect()
    new = {d.rsplit("-", 1)[0]: f"{_session_scratch(spark)}/{d}" for d in set(os.listdir(_session_scratch(spark))) - before}
    assert set(new) == {"evals-keyed", "repeated-rows", "span-lines", "span-lines-ckpt", "span-split"}
    lines = spark.read.text(f"{new['span-lines']}/*").select(F.get_json_object("value", "$.trace_id").alias("t"), F.input_file_name().alias("f"))
    one = lines.where("t <> 't'").withColumn("d", F.regexp_extract("f", r"/([0-9]+)/part", 1)).groupBy("t").agg(F.countDistinct("d").alias("n"), F.count(F.lit(1)).alias("k"))
    assert one.where("n <> 1 OR k < 3").count() == 0 and one.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
