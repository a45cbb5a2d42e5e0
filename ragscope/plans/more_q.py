"""Registered queries of functions that other queries do not reach: run selection, medians by group,
files of different schemas, context strings, loaders by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.operators import corpus as CP
from ragscope.operators import scoring as SC
from ragscope.operators import stats as S
from ragscope.plans.common import r6
from ragscope.plans.index_q import _retrieval_configs
from ragscope.plans.oracle_analytics import EVALS_CTE
from ragscope.plans.shapes_q import ORACLES as SHAPES, _claims, _sentences
from ragscope.session import scratch_path
from ragscope.sources import files as IO
from ragscope.sources.tables import evals, read_table

MEDIANS = ["latency_e2e_latency_ms", "generation_tokens_per_second", "score_correctness"]


def run_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's configuration by its id."""
    return IO.select_runs(_retrieval_configs(spark, sf_dir), "run_nation_7").select("run_id", "model", "quantization", "dimensions")


def group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each metric by run."""
    return r6(S.stat_by_group(evals(spark, sf_dir), MEDIANS, group_by="run_id", stat="median")).select("run_id", "metric", "value")


def mixed_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files with different columns read as one table by column name."""
    path, ev = scratch_path(spark, "mixed"), evals(spark, sf_dir)
    odd = F.col("session_id").endswith("1")
    ev.where(odd).drop("score_correctness").write.parquet(f"{path}/a")
    ev.where(~odd).select(*reversed(ev.columns)).write.parquet(f"{path}/b")
    both = IO.load_metrics(spark, [f"{path}/a", f"{path}/b"])
    return r6(both.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("score_correctness").alias("n_correctness"), F.sum("generation_prompt_tokens").alias("prompt_tokens"),
        F.max("latency_ttft_ms").alias("max_ttft")))


def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context string and cited ids of every conversation, its turns taken as the retrieved chunks."""
    own = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(own.alias("c")).select(
        "conv_id", F.transform("c", lambda x: x["turn"].cast("string")).alias("retrieved"), F.array(F.lit("0")).alias("relevant"),
        F.element_at("c", -1)["text"].alias("output"), F.transform("c", lambda x: x["text"]).alias("chunks"))
    return SC.score_runs(rows, chunks="chunks").select("conv_id", F.md5("retrieval_context").alias("context_md5"), "cited_doc_ids", "retrieval_k")


def loaded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of a dataset loaded by its loader's name."""
    corpus, _ = CP.load_dataset("scifact", (_sentences(spark, sf_dir), _claims(spark, sf_dir)))
    return corpus.select("id", F.md5("text").alias("text"), "title", "structured", "sentence_count")


QUERIES = {f.__name__: f for f in (run_select, group_median, mixed_schemas, retrieval_context, loaded_corpus)}

ORACLES = {
    "run_select": """
select 'run_' || lower(n_name) as run_id, 'org/embedder-' || (n_regionkey % 2) as model, case when n_nationkey % 3 = 0 then 'q8' else 'q4' end as quantization,
       cast(case when n_regionkey < 3 then 384 else 768 end as integer) as dimensions from nation where lower(n_name) = 'nation_7'""",
    "group_median": f"with {EVALS_CTE} " + " union all ".join(
        f"select run_id, '{c}' as metric, round(quantile_cont({c}, 0.5), 6) as value from evals where run_id is not null group by run_id" for c in MEDIANS),
    "mixed_schemas": f"""with {EVALS_CTE}
select session_id, count(*) as n, count(case when session_id not like '%1' then score_correctness end) as n_correctness,
       cast(sum(generation_prompt_tokens) as bigint) as prompt_tokens, round(max(latency_ttft_ms), 6) as max_ttft from evals group by session_id""",
    "retrieval_context": """
select conv_id, md5(string_agg(text, chr(10) || '---' || chr(10) order by turn, text)) as context_md5,
       string_agg(cast(turn as varchar), ',' order by turn, text) as cited_doc_ids, cast(count(*) as integer) as retrieval_k
from conversations where text is not null group by conv_id""",
    "loaded_corpus": SHAPES["sentence_corpus"],
}
