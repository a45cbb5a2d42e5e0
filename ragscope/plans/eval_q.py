"""Registered evaluation-flow queries: grid, scoring, abstention, timing,
hardware fold, prompts and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.functions.text import doc_id
from ragscope.operators import quality as Q
from ragscope.operators import scoring as SC
from ragscope.operators import timing as TM
from ragscope.operators.prompts import rag_prompt as build_prompts
from ragscope.operators.retrieval import top_k
from ragscope.plans.common import event_metrics, r6
from ragscope.plans.retrieval_q import _TOPK_SQL
from ragscope.sources.tables import read_table

# Run configurations derived from ``nation`` (one text for Spark SQL and DuckDB).
CONFIG_SQL = """
select 'run_' || lower(n_name) as run_id,
       case when n_regionkey = 0 then null else n_regionkey % 3 + 1 end as repeat,
       case when n_nationkey % 4 = 0 then null else n_nationkey + 5 end as entry_limit,
       n_regionkey as k,
       n_nationkey * 16 as dimensions,
       case when n_nationkey % 3 = 0 then 'fixed' when n_nationkey % 3 = 1 then 'char_split' end as strategy,
       case when n_nationkey % 5 = 0 then null else 500 end as chunk_size,
       case when n_nationkey % 7 = 0 then null else '. ' end as split_sequence
from nation
"""
SCORE_K = 3
PROMPT_K = 3


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONFIG_SQL.replace("from nation", "from {nation}"), nation=read_table(spark, sf_dir, "nation"))


def eval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = read_table(spark, sf_dir, "benchmark")
    return SC.eval_grid(configs(spark, sf_dir), bench, ["item_id"], limit_col="entry_limit")


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.dry_run(configs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), limit_col="entry_limit")


def _conv_evals(spark, sf_dir):
    """Conversations as evaluations: retrieved = ids of all turn texts in turn
    order, relevant = ids of the user turns, output = last assistant turn."""
    conv = read_table(spark, sf_dir, "conversations")
    nonempty = F.col("text").isNotNull() & (F.col("text") != "")
    item = F.struct(F.col("turn"), doc_id(F.col("text")).alias("d"))
    asst = F.col("role") == "assistant"
    return conv.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(nonempty, item))), lambda s: s["d"]).alias("retrieved"),
        F.transform(F.array_sort(F.collect_list(F.when(nonempty & (F.col("role") == "user"), item))),
                    lambda s: s["d"]).alias("relevant"),
        F.max_by(F.when(asst, F.col("text")), F.when(asst, F.col("turn"))).alias("output"),
    )


def eval_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = SC.score_runs(_conv_evals(spark, sf_dir), k=SCORE_K)
    return r6(scored.select("conv_id", "recall_at_k", "precision_at_k", "mrr", "is_abstention", "retrieval_k",
                            "cited_doc_ids"))


def scored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run configuration against every conversation: hits are its turns in
    order, relevant are its user turns, the output is its last assistant turn."""
    conv = read_table(spark, sf_dir, "conversations").withColumn("claim_id", F.col("conv_id"))
    texts = conv.where("text IS NOT NULL AND text <> ''").withColumn("doc_id", doc_id(F.col("text")))
    hits = texts.select("claim_id", (F.col("turn") + 1).alias("rank"), "doc_id")
    truth = texts.where("role = 'user'").select("claim_id", "doc_id")
    asst = F.col("role") == "assistant"
    outputs = conv.groupBy("claim_id").agg(F.max_by(F.when(asst, F.col("text")), F.when(asst, F.col("turn"))).alias("output"))
    cfg = configs(spark, sf_dir)
    grid = SC.eval_grid(cfg, conv.select("claim_id").distinct(), ["claim_id"], limit_col="entry_limit")
    grid = grid.join(cfg.select("run_id", F.greatest("k", F.lit(1)).alias("k")), "run_id")
    return r6(SC.score_grid(grid, hits, truth, outputs))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = SC.score_runs(_conv_evals(spark, sf_dir), k=SCORE_K)
    return r6(SC.run_quality(scored, keys=()))


def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    out = conv.select("conv_id", F.when(F.col("role") == "assistant", F.col("text")).alias("output"))
    return r6(SC.abstention_rate(out, "output", ["conv_id"]))


def _hourly(spark, sf_dir):
    ev = event_metrics(spark, sf_dir)
    return ev.withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))


def request_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TM.request_timing(_hourly(spark, sf_dir), ["user_id", "hour"], "ts", F.col("event_type") != "error")
    return r6(out)


def hw_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _hourly(spark, sf_dir)
    out = TM.hardware_fold(ev, ["user_id", "hour"], ["ts", "event_id"], ram="event_value", cpu="props_k",
                           temp=F.when(F.col("event_type") == "error", F.col("props_k")),
                           swap_in="event_id", swap_out="event_value")
    return r6(out)


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = top_k(emb, emb, k=PROMPT_K, query_id="vec_id", doc_id="vec_id", exclude_self=True)
    hits = hits.join(docs.withColumnRenamed("doc_id", "doc_id"), "doc_id", "left")
    qs = emb.select(F.col("vec_id").alias("query_id")).join(
        docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), "query_id", "left")
    p = build_prompts(qs, hits, key="query_id", query_text="query")
    return p.select("query_id", "n_context", F.md5("prompt").alias("prompt_md5"),
                    F.char_length("prompt").alias("prompt_len"))


def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.violations(configs(spark, sf_dir), ["run_id"], Q.config_rules())


MEASURE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def measure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the data breaks, next to rules that it keeps."""
    li = read_table(spark, sf_dir, "lineitem")
    rules = {**Q.non_negative(["l_quantity", "l_tax"]), "l_linenumber_at_most_5": F.col("l_linenumber") <= 5,
             "l_discount_below_10pct": F.col("l_discount") < 0.1}
    return Q.violations(li, MEASURE_IDS, rules).groupBy(*MEASURE_IDS, "rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "eval_grid": eval_grid,
    "dry_run": dry_run,
    "eval_scoring": eval_scoring,
    "scored_grid": scored_grid,
    "eval_summary": eval_summary,
    "abstention": abstention,
    "request_timing": request_timing,
    "hw_fold": hw_fold,
    "rag_prompt": rag_prompt,
    "config_violations": config_violations,
    "measure_violations": measure_violations,
}

# --- DuckDB oracles ----------------------------------------------------------
_ABST = ("(regexp_matches(coalesce(text, ''), '^\\s*$') or contains(lower(coalesce(text, '')), "
         "'insufficient information'))")
_CONV = """
t as (select conv_id, turn, role, text, 'doc_' || substr(md5(text), 1, 12) as doc,
             (text is not null and text <> '') as ne from conversations),
ret as (select conv_id, turn, doc, row_number() over (partition by conv_id order by turn) as p from t where ne),
rel as (select distinct conv_id, doc from t where ne and role = 'user'),
nrel as (select conv_id, count(*) as n_rel from rel group by conv_id),
fp as (select conv_id, doc, min(turn) as fturn from ret group by conv_id, doc),
rk as (select conv_id, doc, row_number() over (partition by conv_id order by fturn) as dr from fp),
top as (select rk.conv_id, count(*) as n_top, count(rel.doc) as hits
        from rk left join rel on rel.conv_id = rk.conv_id and rel.doc = rk.doc where dr <= 3 group by rk.conv_id),
fh as (select ret.conv_id, min(p) as first_hit from ret join rel on rel.conv_id = ret.conv_id and rel.doc = ret.doc
       group by ret.conv_id),
rs as (select conv_id, count(*) as retrieval_k, string_agg(doc, ',' order by turn) as cited from ret group by conv_id),
o as (select conv_id, arg_max(text, turn) filter (where role = 'assistant') as text from t group by conv_id),
s as (select c.conv_id,
             case when n_rel > 0 then coalesce(hits, 0) / n_rel end as recall_at_k,
             case when n_rel > 0 then (case when coalesce(n_top, 0) = 0 then 0.0 else hits / n_top end) end as precision_at_k,
             case when n_rel > 0 then coalesce(1.0 / first_hit, 0.0) end as mrr,
             """ + _ABST.replace("text", "o.text") + """ as is_abstention,
             cast(coalesce(retrieval_k, 0) as integer) as retrieval_k, coalesce(cited, '') as cited_doc_ids
      from (select distinct conv_id from conversations) c left join nrel using (conv_id) left join top using (conv_id)
           left join fh using (conv_id) left join rs using (conv_id) left join o using (conv_id))
"""

_HOURLY = ("ev as (select event_id, user_id, event_type, ts, value as event_value, "
           "try_cast(json_extract_string(props, '$.k') as double) as props_k, strftime(ts, '%Y-%m-%d %H') as hour "
           "from events)")

ORACLES = {
    "eval_grid": f"""
with cfg as ({CONFIG_SQL}), e as (select *, row_number() over (order by item_id) - 1 as entry_index from benchmark)
select c.run_id, cast(r.rep as integer) as rep,
       'run_' || substr(sha256(c.run_id || ':' || cast(r.rep as varchar)), 1, 8) as session_id,
       e.entry_index, e.item_id, e.text
from cfg c cross join e join (select unnest(generate_series(1, 3)) as rep) r on r.rep <= coalesce(c.repeat, 1)
where c.entry_limit is null or e.entry_index < c.entry_limit""",
    "dry_run": f"""
with cfg as ({CONFIG_SQL}), n as (select count(*) as n from benchmark)
select run_id, cast(coalesce(repeat, 1) as integer) as repeat, cast(entry_limit as bigint) as entry_limit,
       case when entry_limit is null then n else least(entry_limit, n) end as entries_to_run,
       (case when entry_limit is null then n else least(entry_limit, n) end) * coalesce(repeat, 1) as evaluations
from cfg, n""",
    "eval_scoring": f"""with {_CONV}
select conv_id, round(recall_at_k, 6) as recall_at_k, round(precision_at_k, 6) as precision_at_k,
       round(mrr, 6) as mrr, is_abstention, retrieval_k, cited_doc_ids from s""",
    "eval_summary": f"""with {_CONV}
select count(*) as n_results, count(recall_at_k) as n_scored,
       round(coalesce(avg(recall_at_k), 0.0), 6) as recall_at_k,
       round(coalesce(avg(case when recall_at_k is not null then precision_at_k end), 0.0), 6) as precision_at_k,
       round(coalesce(avg(case when recall_at_k is not null then mrr end), 0.0), 6) as mrr,
       count_if(is_abstention) as abstentions from s""",
    "abstention": f"""
select conv_id, count(case when role = 'assistant' then text end) as n_outputs,
       count_if(role = 'assistant' and text is not null and {_ABST}) as n_abstentions,
       round(coalesce(avg(case when role = 'assistant' and text is not null then cast({_ABST} as double) end), 0.0), 6)
         as abstention_rate
from conversations group by conv_id""",
    "request_timing": f"""
with {_HOURLY},
a as (select user_id, hour, min(ts) as s, max(ts) as l, min(case when event_type <> 'error' then ts end) as f,
             count_if(event_type <> 'error') as completion_tokens from ev group by user_id, hour),
b as (select *, case when f is not null then date_diff('microsecond', s, f) else date_diff('microsecond', s, l) end / 1000.0 as ttft_ms,
             case when f is not null then greatest(0.0, date_diff('microsecond', f, l) / 1000.0) else 0.0 end as predicted_ms
      from a)
select user_id, hour, round(ttft_ms, 6) as ttft_ms, round(predicted_ms, 6) as predicted_ms, completion_tokens,
       round(case when predicted_ms > 0 and completion_tokens > 0 then completion_tokens / (predicted_ms / 1000.0) else 0.0 end, 6)
         as tokens_per_second
from b""",
    "hw_fold": f"""
with {_HOURLY}
select user_id, hour, round(coalesce(max(event_value), 0.0), 6) as max_ram_usage_mb,
       round(coalesce(avg(props_k), 0.0), 6) as avg_cpu_utilization_pct,
       round(max(case when event_type = 'error' then props_k end), 6) as peak_cpu_temp_c,
       cast(trunc(greatest(0.0, arg_max(event_id, (ts, event_id)) - arg_min(event_id, (ts, event_id)))) as bigint) as swap_in_bytes,
       cast(trunc(greatest(0.0, arg_max(event_value, (ts, event_id)) - arg_min(event_value, (ts, event_id)))) as bigint) as swap_out_bytes
from ev group by user_id, hour""",
    "rag_prompt": "with " + _TOPK_SQL.replace("rank <= 6", f"rank <= {PROMPT_K}") + """,
ctx as (select r.query_id, count(*) as n_context,
               string_agg('[' || cast(r.rank as varchar) || '] ' || coalesce(d.text, ''), chr(10) || chr(10) order by r.rank) as context
        from r left join documents d on d.doc_id = r.doc_id group by r.query_id),
q as (select e.vec_id as query_id, d.text as query from embeddings e left join documents d on d.doc_id = e.vec_id),
p as (select q.query_id, coalesce(ctx.n_context, 0) as n_context,
             case when ctx.context is null then
               '<s>[INST] Use the following pieces of context to answer the question.' || chr(10) || repeat(' ', 16) || 'Context:' || chr(10)
               || repeat(' ', 16) || '<No context available>' || chr(10) || chr(10) || repeat(' ', 16) || 'Question: '
               || coalesce(q.query, '') || chr(10) || repeat(' ', 16) || chr(10) || repeat(' ', 16) || 'Answer: [/INST]'
             else
               '<s>[INST] Use the following pieces of context to answer the question.' || chr(10) || repeat(' ', 16) || 'Context:' || chr(10)
               || repeat(' ', 16) || ctx.context || chr(10) || chr(10) || repeat(' ', 16) || 'Question: '
               || coalesce(q.query, '') || chr(10) || repeat(' ', 16) || chr(10) || repeat(' ', 16) || 'Answer: [/INST]'
             end as prompt
      from q left join ctx using (query_id))
select query_id, n_context, md5(prompt) as prompt_md5, cast(length(prompt) as integer) as prompt_len from p""",
    "config_violations": f"""
with cfg as ({CONFIG_SQL})
select run_id, 'k_positive' as rule from cfg where not coalesce(k > 0, true)
union all select run_id, 'dimensions_positive' from cfg where not coalesce(dimensions > 0, true)
union all select run_id, 'fixed_needs_chunk_size' from cfg where strategy = 'fixed' and chunk_size is null
union all select run_id, 'char_split_needs_sequence' from cfg where strategy = 'char_split' and split_sequence is null""",
    "measure_violations": """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, rule, count(*) as n from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_linenumber_at_most_5' as rule from lineitem where l_linenumber > 5
  union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_discount_below_10pct' from lineitem where l_discount >= 0.1
  union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_quantity_non_negative' from lineitem where l_quantity < 0
  union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_tax_non_negative' from lineitem where l_tax < 0) group by all""",
    "scored_grid": f"""
with cfg as ({CONFIG_SQL}), {_CONV.replace("dr <= 3", "dr <= 99")},
e as (select conv_id, row_number() over (order by conv_id) - 1 as idx from (select distinct conv_id from conversations)),
g as (select c.run_id, cast(r.rep as integer) as rep, e.conv_id, greatest(c.k, 1) as k
      from cfg c cross join e join (select unnest(generate_series(1, 3)) as rep) r on r.rep <= coalesce(c.repeat, 1)
      where c.entry_limit is null or e.idx < c.entry_limit),
m as (select rk.conv_id, dr, rel.doc is not null as hit from rk left join rel on rel.conv_id = rk.conv_id and rel.doc = rk.doc),
kk as (select distinct k from g),
tk as (select conv_id, k, count(*) as n_k, count_if(hit) as h_k from m join kk on dr <= k group by conv_id, k)
select g.run_id, g.rep, g.conv_id as claim_id,
       case when n_rel > 0 then round(coalesce(h_k, 0) / n_rel, 6) end as recall_at_k,
       case when n_rel > 0 then round(case when coalesce(n_k, 0) = 0 then 0.0 else h_k / n_k end, 6) end as precision_at_k,
       case when n_rel > 0 then round(coalesce(1.0 / first_turn, 0.0), 6) end as mrr,
       cast(coalesce(s.retrieval_k, 0) as bigint) as retrieval_k, s.is_abstention
from g join s on s.conv_id = g.conv_id left join nrel on nrel.conv_id = g.conv_id
left join tk on tk.conv_id = g.conv_id and tk.k = g.k
left join (select ret.conv_id, min(ret.turn + 1) as first_turn from ret join rel on rel.conv_id = ret.conv_id and rel.doc = ret.doc group by ret.conv_id) f
  on f.conv_id = g.conv_id""",
}
