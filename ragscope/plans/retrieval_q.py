"""Registered retrieval queries (embeddings table: every vector queries the
rest of the table; relevant = same label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragscope.operators import ann
from ragscope.operators.retrieval import label_relevance_quality, top_k
from ragscope.operators.scoring import run_quality
from ragscope.plans.common import r6
from ragscope.sources.tables import read_table

K = 6


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return top_k(emb, emb, k=K, metric="cosine", query_id="vec_id", doc_id="vec_id", exclude_self=True)


def topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_topk(spark, sf_dir))


def _quality(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return label_relevance_quality(_topk(spark, sf_dir), emb, K, id_col="vec_id", label_col="label")


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_quality(spark, sf_dir))


def quality_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(run_quality(_quality(spark, sf_dir), ["label"]))


def topk_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every query through an index of cells whose bounds prune; equal to the exact ranking."""
    emb = read_table(spark, sf_dir, "embeddings")
    return r6(ann.top_k_cells(emb, emb, k=K, query_id="vec_id", doc_id="vec_id", exclude_self=True))


QUERIES = {
    "topk_approx": topk_approx,
    "topk_retrieval": topk_retrieval,
    "retrieval_quality": retrieval_quality,
    "quality_by_label": quality_by_label,
}

_TOPK_SQL = f"""
e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
s as (select q.vec_id as query_id, d.vec_id as doc_id,
             list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) as score
      from e q join e d on q.vec_id <> d.vec_id),
r as (select query_id, doc_id, score,
             row_number() over (partition by query_id order by score desc, doc_id) as rank
      from s qualify rank <= {K})
"""

_QUALITY_SQL = f"""
with {_TOPK_SQL},
nl as (select label, count(*) as n_label from e group by label),
h as (select r.query_id, eq.label, count(*) as n_retrieved,
             count_if(ed.label = eq.label) as hits,
             min(case when ed.label = eq.label then r.rank end) as first_hit
      from r join e eq on eq.vec_id = r.query_id join e ed on ed.vec_id = r.doc_id
      group by r.query_id, eq.label),
q as (select h.query_id, h.label, h.n_retrieved, h.hits,
             case when n_label - 1 > 0 then h.hits / (n_label - 1) end as recall_at_k,
             case when n_label - 1 > 0 then (case when n_retrieved > 0 then hits / least(n_retrieved, {K}) else 0.0 end) end as precision_at_k,
             case when n_label - 1 > 0 then coalesce(1.0 / first_hit, 0.0) end as mrr
      from h join nl using (label))
"""

_RANKED = f"with {_TOPK_SQL} select query_id, cast(rank as integer) as rank, doc_id, round(score, 6) as score from r"

ORACLES = {
    "topk_retrieval": _RANKED,
    "topk_approx": _RANKED,
    "retrieval_quality": _QUALITY_SQL + """
select query_id, label, n_retrieved, hits, round(recall_at_k, 6) as recall_at_k,
       round(precision_at_k, 6) as precision_at_k, round(mrr, 6) as mrr from q""",
    "quality_by_label": _QUALITY_SQL + """
select label, count(*) as n_results, count(recall_at_k) as n_scored,
       round(coalesce(avg(recall_at_k), 0.0), 6) as recall_at_k,
       round(coalesce(avg(case when recall_at_k is not null then precision_at_k end), 0.0), 6) as precision_at_k,
       round(coalesce(avg(case when recall_at_k is not null then mrr end), 0.0), 6) as mrr
from q group by label""",
}
