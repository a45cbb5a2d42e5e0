"""Registered source/sink queries: per-session export and reload, incremental
export, session selection and dataset export with metadata counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.operators import corpus as CP
from ragscope.plans.common import r6
from ragscope.plans.oracle_analytics import EVALS_CTE
from ragscope.session import scratch_path
from ragscope.sources import exports as EX
from ragscope.sources import files as IO
from ragscope.sources.tables import EVALS_COLUMNS, evals, read_table

GLOB_SPEC = "run_1*_s[12]"
LIST_SPEC = " run_00_s0, ,run_03_s1,run_99_s9 "


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metric-export")
    IO.export_metrics(evals(spark, sf_dir), path)
    back = IO.load_metrics(spark, folder=path)
    return r6(back.select(*EVALS_COLUMNS))


def incremental_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evals(spark, sf_dir)
    path = scratch_path(spark, "metric-export-inc")
    IO.export_metrics(ev.where(F.col("session_id").endswith("_s0")), path)
    new = IO.export_metrics(ev, path, skip_existing=True).withColumn("added", F.lit(True))
    back = IO.read_exported(spark, path).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_e2e_latency_ms").alias("latency"), F.count_distinct("claim_id").alias("n_claims"))
    return r6(back.join(new, "session_id", "left").withColumn("added", F.coalesce("added", F.lit(False))))


def export_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record of two export runs, the second over all sessions, says of each session."""
    ev, path = evals(spark, sf_dir), scratch_path(spark, "metric-export-twice")
    IO.export_metrics(ev.where(F.col("session_id").endswith("_s0")), path)
    IO.export_metrics(ev, path)
    return EX.current(spark, path).groupBy(F.col("session").alias("session_id")).agg(
        F.sum(F.when(F.col("live"), F.col("rows"))).alias("live_rows"), F.count_distinct("run").alias("n_runs"))


def session_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evals(spark, sf_dir)
    g = IO.select_sessions(ev, GLOB_SPEC).withColumn("spec", F.lit("glob"))
    lst = IO.select_sessions(ev, LIST_SPEC).withColumn("spec", F.lit("list"))
    return g.unionByName(lst)


def dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    rows = conv.select(F.col("conv_id").alias("row_id"), F.col("turn").alias("pos"), "text")
    corpus = CP.ragbench_corpus(rows).select(F.col("doc_id").alias("id"), "text")
    lists = CP.supporting_lists(CP.ragbench_truth_long(rows))
    truth = conv.select(F.col("conv_id").cast("string").alias("id")).distinct().join(lists, "id", "left")
    base = scratch_path(spark, "datasets")
    IO.export_dataset(corpus, truth, base, "conversations", about={"source": "tables", "split": "all"})
    # what a reader of the export finds: rows, and the counts its metadata claims
    back = IO.read_corpus(spark, base, "conversations").select(F.lit("corpus").alias("part"), "id", F.md5("text").alias("value"))
    lists = spark.read.parquet(IO.dataset_path(base, "conversations", "ground_truth")).select(
        F.lit("truth").alias("part"), "id", F.array_join("supporting_documents", ",").alias("value"))
    meta = IO.read_metadata(spark, base, "conversations")
    claimed = F.when(F.col("part") == "corpus", meta["corpus_count"]).otherwise(meta["ground_truth_count"])
    return back.unionByName(lists).withColumn("claimed", claimed.cast("long"))


QUERIES = {
    "export_roundtrip": export_roundtrip,
    "incremental_export": incremental_export,
    "export_record": export_record,
    "session_select": session_select,
    "dataset_export": dataset_export,
}

ORACLES = {
    "export_roundtrip": f"with {EVALS_CTE} select run_id, session_id, claim_id, "
    + ", ".join(f"round({c}, 6) as {c}" for c in EVALS_COLUMNS[3:]) + " from evals where session_id is not null",
    "incremental_export": f"""with {EVALS_CTE}
select session_id, count(*) as n, round(sum(latency_e2e_latency_ms), 6) as latency, count(distinct claim_id) as n_claims,
       not ends_with(session_id, '_s0') as added from evals where session_id is not null group by session_id""",
    "export_record": f"""with {EVALS_CTE}
select session_id, count(*) as live_rows, case when ends_with(session_id, '_s0') then 2 else 1 end as n_runs
from evals where session_id is not null group by session_id""",
    "session_select": f"""with {EVALS_CTE}
select distinct session_id, 'glob' as spec from evals where session_id glob '{GLOB_SPEC}'
union all
select distinct session_id, 'list' as spec from evals where session_id in ('run_00_s0', 'run_03_s1', 'run_99_s9')""",
    "dataset_export": """
with t as (select cast(conv_id as varchar) as id, turn, 'doc_' || substr(md5(text), 1, 12) as doc, md5(text) as m
           from conversations where text is not null and text <> ''),
c as (select distinct doc, m from t),
l as (select id, string_agg(doc, ',' order by turn) as value from t group by id),
g as (select distinct cast(conv_id as varchar) as id from conversations)
select 'corpus' as part, doc as id, m as value, (select count(*) from c) as claimed from c
union all
select 'truth', g.id, l.value, (select count(*) from g) from g left join l on g.id = l.id""",
}
