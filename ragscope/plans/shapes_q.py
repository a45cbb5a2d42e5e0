"""Registered queries for operators whose input shapes are derived from the tables:
dataset shapes, hits with their documents, histogram sets, projections, scrape
texts, trace selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.operators import catalog as CT
from ragscope.operators import corpus as CP
from ragscope.operators import outliers as O
from ragscope.operators import reducers as RD
from ragscope.operators import retrieval as RT
from ragscope.operators import timing as TM
from ragscope.operators.spans import to_spans
from ragscope.plans.common import EVENT_METRICS, event_metrics, r6
from ragscope.plans.oracle_analytics import EVALS_CTE, EVENTS_CTE, iqr_bounds, iqr_flag, unpivot_long
from ragscope.plans.retrieval_q import K, _TOPK_SQL
from ragscope.plans.spans_q import _keyed
from ragscope.session import scratch_path
from ragscope.sources import files as IO
from ragscope.sources.tables import events, evals, read_table


def exclusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(O.exclusion_report(event_metrics(spark, sf_dir), EVENT_METRICS))


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = RD.scatter(evals(spark, sf_dir), "generation_prompt_tokens", "score_correctness", "run_id")
    return r6(points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("n")))


def reported_ttft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TTFT from a server's prompt time and time per token."""
    parts = evals(spark, sf_dir).select("run_id", F.col("latency_ttft_ms").alias("prompt_ms"), (1000 / F.col("generation_tokens_per_second")).alias("token_ms"))
    ttft = TM.ttft_from_parts("prompt_ms", "token_ms")
    return r6(parts.groupBy("run_id").agg(F.min(ttft).alias("lo"), F.max(ttft).alias("hi"), F.count(ttft).alias("n")))


def histogram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(RD.histogram_sets(evals(spark, sf_dir), "run_id", bins=10))


def scrape_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters read back from scrape texts, one text per event."""
    ev = events(spark, sf_dir)
    text = F.concat(F.lit("# scrape\nreq:total "), F.col("event_id").cast("string"), F.lit("\nkv_used{slot=\"0\"} "),
                    F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")), F.lit("\n"))
    return CT.scrape_counters(ev.select("event_id", text.alias("text")), "text", {"req:total": "bigint", "kv_used": "double", "missing": "bigint"}).drop("text")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a sentence-per-line corpus."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("title"), F.split("text", "\n").alias("abstract"), F.when(F.col("lang") != "en", F.lit(True)).alias("structured"))


def sentence_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CP.scifact_corpus(_sentences(spark, sf_dir))
    return c.select("id", F.md5("text").alias("text"), "title", "structured", "sentence_count")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as claims: every user turn is evidence, labelled by its turn; the
    documents cited are the turns of even conversations."""
    conv = read_table(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") % 4 == 3, "CONTRADICT").when(F.col("turn") % 4 == 1, "SUPPORT")
    one = F.struct(F.col("turn").cast("int").alias("doc_id"), F.array(F.col("turn").cast("int")).alias("sentence_ids"), label.alias("label"))
    return conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", one))).alias("evidences"),
        F.array_sort(F.collect_list(F.when(F.col("conv_id") % 2 == 0, F.col("turn").cast("int")))).alias("cited_doc_ids"),
    ).select(F.col("conv_id").alias("id"), F.concat(F.lit("claim "), F.col("conv_id").cast("string")).alias("claim"), "evidences", "cited_doc_ids")


def claim_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected labels, and nested evidence read back: all of it, and that of one document."""
    t = CP.scifact_truth(_claims(spark, sf_dir))
    first = CP.evidence_for("evidence", F.lit("1"))
    return t.select("id", "input", "expected_label", F.size("supporting_documents").alias("n_cited"), F.size("evidence").alias("n_evidence"),
                    F.size(CP.evidence_sentences("evidence")).alias("n_sentences"), F.get(first["sentences"], 0)["label"].alias("label_of_1"))


def truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as question-answer rows: their ground truth, written and read back."""
    conv = read_table(spark, sf_dir, "conversations")
    user, asst = F.col("role") == "user", F.col("role") == "assistant"
    raw = conv.groupBy("conv_id").agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("question"),
        F.max_by(F.when(asst, F.col("text")), F.when(asst, F.col("turn"))).alias("response"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("documents"),  # a raw row holds its documents
        F.count(F.lit(1)).alias("n_turns")).withColumnRenamed("conv_id", "id")
    base = scratch_path(spark, "truth")
    CP.ragbench_truth(raw).write.parquet(IO.dataset_path(base, "conversations", "ground_truth"))
    t = IO.read_truth(spark, base, "conversations")
    return t.select("id", F.md5("input").alias("input"), F.md5("expected_response").alias("expected_response"), "expected_label",
                    F.array_join("supporting_documents", ",").alias("supporting"), F.size("evidence").alias("n_evidence"), "n_turns")


def hit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in rank order with text, metadata and the id of their document."""
    emb = read_table(spark, sf_dir, "embeddings")
    hits = RT.top_k(emb, emb, k=K, query_id="vec_id", doc_id="vec_id", exclude_self=True)
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text",
        F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("lang"), F.col("lang"))).otherwise(
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")))).alias("metadata"))
    out = RT.with_documents(hits, docs)
    return out.select("query_id", "rank", "chunk_id", "doc_id", F.md5("text").alias("text"), F.col("metadata")["lang"].alias("lang"))


def trace_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root spans of the traces of some sessions, by name and time."""
    rows = _keyed(spark, sf_dir)
    spans = to_spans(rows, trace_id="_trace")
    own = rows.where(IO.session_filter("run_0*_s1", "session_id")).select(F.col("_trace").alias("trace_id"))
    picked = IO.select_traces(spans, own, start_ns=1_699_999_999_000_000_000)
    return picked.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trace_id").alias("n_traces"))


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a set of ids: a frame of ids, and a literal list."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    ids = read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    by_frame = IO.lookup(docs, ids, "doc_id").withColumn("asked", F.lit("frame"))
    return by_frame.unionByName(IO.lookup(docs, [1, 2, 3, 5, 8], "doc_id").withColumn("asked", F.lit("list")))


QUERIES = {
    "exclusion_report": exclusion_report,
    "scatter_points": scatter_points,
    "reported_ttft": reported_ttft,
    "histogram_sets": histogram_sets,
    "scrape_counters": scrape_counters,
    "sentence_corpus": sentence_corpus,
    "claim_truth": claim_truth,
    "truth_rows": truth_rows,
    "hit_documents": hit_documents,
    "trace_select": trace_select,
    "document_lookup": document_lookup,
}


def _exclusion() -> str:
    flags = " or ".join(iqr_flag(c, i) for i, c in enumerate(EVENT_METRICS))
    return f"""
with {EVENTS_CTE}, b as ({iqr_bounds('ev', EVENT_METRICS)}), f as (select ({flags}) as out from ev, b)
select count(*) as n, count_if(out) as dropped, round(case when count(*) > 0 then count_if(out) / count(*) * 100 end, 6) as pct from f"""


def _histogram_sets() -> str:
    found = [(s, c, label) for s, cols in RD.HISTOGRAM_SETS.items() for c, label in cols.items() if c in RD_COLS]
    cols = list(dict.fromkeys(c for _, c, _ in found))
    names = ", ".join(f"('{s}', '{c}', '{label}')" for s, c, label in found)
    return f"""
with {EVALS_CTE}, long as ({unpivot_long('evals', ['run_id'], cols)}), names(hist_set, metric, label) as (values {names}),
rg as (select run_id, metric, case when min(v) = max(v) then min(v) - 0.5 else min(v) end as a,
              case when min(v) = max(v) then max(v) + 0.5 else max(v) end as z from long where run_id is not null group by run_id, metric),
c as (select l.run_id, l.metric, cast(least(floor((v - a) * 10 / (z - a)), 9) as integer) as bin, count(*) as cnt
      from long l join rg using (run_id, metric) group by all),
e as (select run_id, metric, a, z, cast(unnest(generate_series(0, 9)) as integer) as bin from rg)
select n.hist_set, n.label, e.run_id, e.metric, e.bin, round(a + bin * (z - a) / 10, 6) as lo, round(a + (bin + 1) * (z - a) / 10, 6) as hi,
       coalesce(cnt, 0) as count
from e left join c using (run_id, metric, bin) join names n on n.metric = e.metric"""


RD_COLS = {"latency_e2e_latency_ms", "latency_ttft_ms", "generation_tokens_per_second", "generation_completion_tokens",
           "generation_prompt_tokens", "metrics_recall_at_k", "score_correctness", "score_hallucination"}

ORACLES = {
    "exclusion_report": _exclusion(),
    "scatter_points": f"""
with {EVALS_CTE} select run_id, generation_prompt_tokens, round(score_correctness, 6) as score_correctness, count(*) as n from evals
where run_id is not null and generation_prompt_tokens is not null and score_correctness is not null group by all""",
    "reported_ttft": f"""
with {EVALS_CTE}, t as (select run_id, latency_ttft_ms + 1000 / generation_tokens_per_second as x from evals)
select run_id, round(min(x), 6) as lo, round(max(x), 6) as hi, count(x) as n from t group by run_id""",
    "histogram_sets": _histogram_sets(),
    "scrape_counters": """
select event_id, event_id as req_total,
       coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0) as kv_used, cast(0 as bigint) as missing from events""",
    "sentence_corpus": """
select cast(doc_id as varchar) as id, md5(replace(coalesce(text, ''), chr(10), ' ')) as text, source as title, lang <> 'en' as structured,
       cast(case when text is null then 0 else len(string_split(text, chr(10))) end as integer) as sentence_count from documents""",
    "claim_truth": """
with t as (select conv_id, turn, role, case when turn % 4 = 3 then 'CONTRADICT' when turn % 4 = 1 then 'SUPPORT' else 'SUPPORT' end as label
           from conversations),
e as (select conv_id, count_if(role = 'user') as n, count_if(role = 'user' and label = 'CONTRADICT') as c,
             case when conv_id % 2 = 0 then count(*) else 0 end as cited,
             min(case when role = 'user' and turn = 1 then label end) as one from t group by conv_id)
select cast(conv_id as varchar) as id, 'claim ' || conv_id as input,
       case when c > 0 then 'CONTRADICT' when n > 0 or cited > 0 then 'SUPPORT' else 'NOT_ENOUGH_INFO' end as expected_label,
       cast(cited as integer) as n_cited, cast(n as integer) as n_evidence, 0 as n_sentences, one as label_of_1 from e""",
    "truth_rows": """
select cast(conv_id as varchar) as id, md5(arg_min(text, turn) filter (where role = 'user')) as input,
       md5(arg_max(text, turn) filter (where role = 'assistant')) as expected_response, cast(null as varchar) as expected_label,
       coalesce(string_agg(case when text <> '' then 'doc_' || substr(md5(text), 1, 12) end, ',' order by turn), '') as supporting,
       0 as n_evidence, count(*) as n_turns from conversations group by conv_id""",
    "hit_documents": f"""
with {_TOPK_SQL}
select query_id, cast(rank as integer) as rank, r.doc_id as chunk_id,
       case when r.doc_id % 3 = 0 then cast(r.doc_id as varchar) when d.doc_id is null then cast(r.doc_id as varchar) else 'd' || r.doc_id end as doc_id,
       md5(d.text) as text, d.lang from r left join documents d on d.doc_id = r.doc_id""",
    "trace_select": f"""
with {EVALS_CTE} select 'rag.evaluation' as name, count(*) as n, count(*) as n_traces from evals
where session_id glob 'run_0*_s1' and coalesce(cast(trunc(latency_e2e_latency_ms * 1000000.0) as bigint), 0) <= 1000000000""",
    "document_lookup": """
select doc_id, lang, 'frame' as asked from documents where doc_id in (select doc_id from labels where toxic = 1)
union all select doc_id, lang, 'list' from documents where doc_id in (1, 2, 3, 5, 8)""",
}
