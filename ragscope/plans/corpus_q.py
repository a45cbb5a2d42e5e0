"""Registered corpus / chunking queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.operators import chunking as C
from ragscope.operators import corpus as CP
from ragscope.operators.quantiles import quantile_wide
from ragscope.plans.common import documents, r6
from ragscope.sources.tables import read_table

CHUNK_SIZE = 500
CHUNK_OVERLAP = 64
SPLIT_SEQ = ". "


def _docs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "text", "lang", "source")


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(_docs(spark, sf_dir), "fixed", CHUNK_SIZE, CHUNK_OVERLAP).drop("lang", "source")


def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(_docs(spark, sf_dir), "char_split", sep=SPLIT_SEQ).drop("lang", "source", "start_char", "end_char")


def chunk_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(_docs(spark, sf_dir), None).select("doc_id", "chunk_index", "chunk_id", "text", "lang")


def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(C.chunk_profile(C.chunk(_docs(spark, sf_dir), "fixed", CHUNK_SIZE, CHUNK_OVERLAP)))


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return C.split_report(d, C.chunk(d, "fixed", CHUNK_SIZE, CHUNK_OVERLAP), CHUNK_SIZE)


def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document length summary against the chunk size, with a verdict code.
    The four percentiles are one row, fetched once and inlined as literals."""
    d = _docs(spark, sf_dir).select(F.char_length("text").cast("double").alias("text_len"))
    q = quantile_wide(d, ["text_len"], [0.25, 0.5, 0.75, 0.95]).first()
    p25, p50, p75, p95 = (q[f"text_len__q{n}"] for n in (25, 50, 75, 95))
    verdict = ("p95_below_chunk_size" if p95 is not None and p95 < CHUNK_SIZE
               else "median_below_chunk_size" if p50 is not None and p50 < CHUNK_SIZE
               else "median_above_chunk_size")
    out = d.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("text_len").alias("mean"), F.stddev_samp("text_len").alias("std"),
        F.min("text_len").alias("min"), F.max("text_len").alias("max"),
        F.count_if(F.col("text_len") <= CHUNK_SIZE).alias("n_under"),
        F.count_if(F.col("text_len") > CHUNK_SIZE).alias("n_over"),
    )
    return r6(out.select(
        "n_docs", "mean", "std", "min", "max",
        *[F.lit(v).cast("double").alias(n) for n, v in (("p25", p25), ("p50", p50), ("p75", p75), ("p95", p95))],
        "n_under", "n_over", (F.col("n_under") / F.col("n_docs") * 100).alias("pct_under"),
        F.lit(verdict).alias("verdict")))


def shortest_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 shortest and 5 longest documents (ties: input order = doc_id)."""
    d = _docs(spark, sf_dir).select("doc_id", F.char_length("text").alias("text_len"), "text")
    short = d.orderBy(F.col("text_len").asc(), F.col("doc_id").asc()).limit(5).withColumn("which", F.lit("shortest"))
    long_ = d.orderBy(F.col("text_len").desc(), F.col("doc_id").asc()).limit(5).withColumn("which", F.lit("longest"))
    return short.unionByName(long_)


def _doc_rows(spark, sf_dir):
    """documents as raw RAGBench-style rows: one row per source, documents in doc_id order."""
    return _docs(spark, sf_dir).select(F.col("source").alias("row_id"), F.col("doc_id").alias("pos"), "text")


def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.ragbench_corpus(_doc_rows(spark, sf_dir))


def _conv_rows(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("row_id"), F.col("turn").alias("pos"), "text")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as QA rows: supporting ids per conversation, in turn order."""
    lists = CP.supporting_lists(CP.ragbench_truth_long(_conv_rows(spark, sf_dir)))
    return lists.select("id", F.size("supporting_documents").alias("n_supporting"),
                        F.array_join("supporting_documents", ",").alias("supporting_documents"))


def support_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = CP.ragbench_truth_long(_conv_rows(spark, sf_dir))
    corpus = CP.ragbench_corpus(_doc_rows(spark, sf_dir))
    return CP.missing_support(truth, corpus)


QUERIES = {
    "chunk_fixed": chunk_fixed,
    "chunk_split": chunk_split,
    "chunk_none": chunk_none,
    "chunk_profile": chunk_profile,
    "split_report": split_report,
    "length_profile": length_profile,
    "shortest_longest": shortest_longest,
    "corpus_dedup": corpus_dedup,
    "ground_truth": ground_truth,
    "support_coverage": support_coverage,
}

# --- DuckDB oracles ----------------------------------------------------------
# The fixed chunker as a recursive CTE over code-point offsets: each step
# computes the span [s, e) from s, then the next s.
def _chunk_fixed_sql() -> str:
    return f"""
with recursive span(doc_id, text, n, s, e) as (
  select doc_id, text, n, 0 as s,
         case when least({CHUNK_SIZE}, n) < n and instr(reverse(substr(text, 1, least({CHUNK_SIZE}, n))), ' ') > 0
                   and least({CHUNK_SIZE}, n) - instr(reverse(substr(text, 1, least({CHUNK_SIZE}, n))), ' ') > 0
              then least({CHUNK_SIZE}, n) - instr(reverse(substr(text, 1, least({CHUNK_SIZE}, n))), ' ') + 1
              else least({CHUNK_SIZE}, n) end as e
  from (select doc_id, text, length(text) as n from documents where regexp_matches(text, '[^\\s]'))
  union all
  select doc_id, text, n, ns as s,
         case when least(ns + {CHUNK_SIZE}, n) < n
                   and instr(reverse(substr(text, ns + 1, least(ns + {CHUNK_SIZE}, n) - ns)), ' ') > 0
                   and least(ns + {CHUNK_SIZE}, n) - instr(reverse(substr(text, ns + 1, least(ns + {CHUNK_SIZE}, n) - ns)), ' ') > ns
              then least(ns + {CHUNK_SIZE}, n) - instr(reverse(substr(text, ns + 1, least(ns + {CHUNK_SIZE}, n) - ns)), ' ') + 1
              else least(ns + {CHUNK_SIZE}, n) end as e
  from (select doc_id, text, n, s, e,
               case when e - {CHUNK_OVERLAP} <= s then e else e - {CHUNK_OVERLAP} end as ns
        from span where e < n)
),
kept as (select doc_id, s, e, substr(text, s + 1, e - s) as text from span
         where regexp_matches(substr(text, s + 1, e - s), '[^\\s]')),
chunks as (select cast(doc_id as varchar) as doc_id,
                  cast(row_number() over (partition by doc_id order by s) - 1 as integer) as chunk_index,
                  cast(s as integer) as start_char, cast(e as integer) as end_char, text from kept)
"""


_FIXED = _chunk_fixed_sql()

_SPLIT = f"""
with parts as (
  select doc_id, unnest(string_split(text, '{SPLIT_SEQ}')) as part,
         unnest(generate_series(0, len(string_split(text, '{SPLIT_SEQ}')) - 1)) as idx
  from documents)
select cast(doc_id as varchar) as doc_id, cast(idx as integer) as chunk_index,
       cast(doc_id as varchar) || '_chunk_' || cast(idx as varchar) as chunk_id,
       regexp_replace(part, '^\\s+|\\s+$', '', 'g') as text
from parts where regexp_matches(part, '[^\\s]')
"""

_DOC_ROWS = "select source as row_id, doc_id as pos, text from documents"
_CONV_ROWS = "select conv_id as row_id, turn as pos, text from conversations"

_DEDUP = f"""
with r as ({_DOC_ROWS}), d as (select md5(text) as md5, row_id, pos, text from r where text is not null and text <> '')
select 'doc_' || substr(md5, 1, 12) as doc_id, md5, arg_min(text, (row_id, pos)) as text,
       arg_min(row_id, (row_id, pos)) as first_row, arg_min(pos, (row_id, pos)) as first_pos,
       count(*) as n_occurrences
from d group by md5
"""

_LENGTH = f"""
with d as (select cast(length(text) as double) as text_len from documents),
a as (select count(*) as n_docs, avg(text_len) as mean, stddev_samp(text_len) as std, min(text_len) as min,
             max(text_len) as max, quantile_cont(text_len, 0.25) as p25, quantile_cont(text_len, 0.5) as p50,
             quantile_cont(text_len, 0.75) as p75, quantile_cont(text_len, 0.95) as p95,
             count_if(text_len <= {CHUNK_SIZE}) as n_under, count_if(text_len > {CHUNK_SIZE}) as n_over from d)
select round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max,
       round(p25, 6) as p25, round(p50, 6) as p50, round(p75, 6) as p75, round(p95, 6) as p95,
       n_docs, n_under, n_over, round(n_under / n_docs * 100, 6) as pct_under,
       case when p95 < {CHUNK_SIZE} then 'p95_below_chunk_size' when p50 < {CHUNK_SIZE} then 'median_below_chunk_size'
            else 'median_above_chunk_size' end as verdict
from a
"""

ORACLES = {
    "chunk_fixed": _FIXED + """select doc_id, chunk_index, doc_id || '_chunk_' || cast(chunk_index as varchar) as chunk_id,
       start_char, end_char, text from chunks""",
    "chunk_split": _SPLIT,
    "chunk_none": """select cast(doc_id as varchar) as doc_id, 0 as chunk_index, cast(doc_id as varchar) as chunk_id,
       text, lang from documents""",
    "chunk_profile": _FIXED + """select count(*) as total_chunks,
       count(distinct case when chunk_index > 0 then doc_id end) as split_docs,
       count_if(chunk_index > 0) as non_first_chunks,
       round(avg(cast(length(text) as double)), 6) as len_mean, round(stddev_samp(cast(length(text) as double)), 6) as len_std,
       round(min(cast(length(text) as double)), 6) as len_min,
       round(quantile_cont(cast(length(text) as double), 0.25), 6) as len_p25, round(quantile_cont(cast(length(text) as double), 0.5), 6) as len_p50,
       round(quantile_cont(cast(length(text) as double), 0.75), 6) as len_p75, round(max(cast(length(text) as double)), 6) as len_max
from chunks""",
    "split_report": _FIXED + """select c.doc_id, cast(length(d.text) as integer) as doc_len, c.chunk_index, c.start_char,
       c.end_char, c.text from chunks c join documents d on c.doc_id = cast(d.doc_id as varchar)
where length(d.text) > """ + str(CHUNK_SIZE),
    "length_profile": _LENGTH,
    "shortest_longest": """
(select doc_id, cast(length(text) as integer) as text_len, text, 'shortest' as which from documents
 order by length(text), doc_id limit 5)
union all
(select doc_id, cast(length(text) as integer) as text_len, text, 'longest' as which from documents
 order by length(text) desc, doc_id limit 5)""",
    "corpus_dedup": _DEDUP,
    "ground_truth": f"""
with r as ({_CONV_ROWS}), t as (select cast(row_id as varchar) as id, pos, 'doc_' || substr(md5(text), 1, 12) as doc_id
                                from r where text is not null and text <> '')
select id, cast(count(*) as integer) as n_supporting, string_agg(doc_id, ',' order by pos) as supporting_documents
from t group by id""",
    "support_coverage": f"""
with r as ({_CONV_ROWS}),
t as (select distinct 'doc_' || substr(md5(text), 1, 12) as doc_id from r where text is not null and text <> ''),
c as (select distinct 'doc_' || substr(md5(text), 1, 12) as doc_id from documents where text is not null and text <> '')
select doc_id from t where doc_id not in (select doc_id from c)""",
}
