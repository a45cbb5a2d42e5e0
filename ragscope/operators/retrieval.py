"""Dense top-k retrieval (exact), queries x index.

Physical plan (``vectors.py``):

1. Queries are packed into blocks and index rows into parts of a bounded byte
   size, by a hash of their ids; neither table passes through the driver, so both
   may grow.
2. A block meets its home part in one task: a float64 matrix product, of which
   each query keeps its best k.  The k-th scores go along when the block meets the
   other parts, which return only rows that reach them.  No (query, doc) pair is
   ever materialised as a row.
3. A shuffle on ``query_id`` and ``row_number() <= k`` (planned as a
   partial + final WindowGroupLimit) keeps the global top-k, ties broken by
   the smaller document id.

The hits of the first round are a written table, so an executor loss re-runs one
round at most.  Rows without a vector are neither queries nor hits; the cosine of a
zero vector is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.operators import vectors
from ragscope.operators.ordering import written
from ragscope.operators.vectors import METRICS

EMPTY = "query_id long, rank int, doc_id long, score double"


def vector_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, v) of the rows with a vector."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL")


def check(k: int, metric: str) -> None:
    if k <= 0:
        raise ValueError("k must be > 0")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")


def top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int = 3,
    metric: str = "cosine",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    doc_id: str = "doc_id",
    doc_vec: str = "embedding",
    exclude_self: bool = False,
    block_bytes: int | None = None,
    part_bytes: int | None = None,
) -> DataFrame:
    """``query_id, rank, doc_id, score`` for the k best documents per query.

    Ids must be integral (use a surrogate key for string ids).  ``metric``:
    ``cosine`` (default), ``ip`` (inner product) or ``l2`` (score = negated
    squared distance, so higher is closer for all three).  Without ``block_bytes`` and
    ``part_bytes`` both follow the tables' sizes (``vectors.cut_at``).
    """
    check(k, metric)
    spark = queries.sparkSession
    asked, held = vector_rows(queries, query_id, query_vec), vector_rows(index, doc_id, doc_vec)
    size = F.sum(8 * (F.size("v") + 1))
    sizes = asked.agg(size.alias("n")).crossJoin(held.agg(size.alias("m"))).first()  # one row each
    if not sizes["n"] or not sizes["m"]:
        return spark.createDataFrame([], EMPTY)
    block_bytes = block_bytes or vectors.cut_at(sizes["n"], 1 << 20, vectors.MOST_BYTES)
    part_bytes = part_bytes or vectors.cut_at(sizes["m"], 4 << 20, vectors.MOST_BYTES)
    n_blocks, n_parts = -(-sizes["n"] // block_bytes), -(-sizes["m"] // part_bytes)
    dealt = lambda rows, name, n: vectors.packed(rows.select(
        F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name), "id", "v", F.lit(0).alias("cell")), name, metric)
    blocks, parts = dealt(asked, "block", n_blocks), dealt(held, "part", n_parts)
    pairs = spark.range(n_blocks).select(F.col("id").cast("int").alias("block"))
    home = pairs.withColumn("part", F.pmod("block", F.lit(n_parts)).cast("int"))
    if n_parts == 1:  # no other part to meet
        return vectors.best(vectors.met(blocks, parts, home, k, metric, exclude_self), k)
    others = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).where(F.col("part") != F.pmod("block", F.lit(n_parts)))
    blocks, parts = written(blocks, "query-blocks"), written(parts, "index-parts")
    return vectors.best(vectors.two_rounds(blocks, parts, home, lambda known: others, k, metric, exclude_self), k)


def hits_arrays(topk: DataFrame) -> DataFrame:
    """Per query: the ranked doc ids as an array (k is small and fixed, so
    the array is bounded)."""
    return topk.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias("retrieved")
    )


def label_relevance_quality(topk: DataFrame, labels: DataFrame, k: int, id_col: str = "vec_id",
                            label_col: str = "label", exclude_self: bool = True) -> DataFrame:
    """recall@k, precision@k and MRR when "relevant" means "same label".

    The relevant set of a query can be a large share of the table, so it is
    never built as an array: hits come from joining the (bounded) top-k
    rows with the labels, and |relevant| from a per-label count.
    Per query: ``query_id, label, n_retrieved, hits, recall_at_k,
    precision_at_k, mrr`` (metrics null when nothing is relevant).
    """
    lab = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"))
    per_label = lab.groupBy("_label").agg(F.count(F.lit(1)).alias("_n_label"))
    qlab = lab.select(F.col("_id").alias("query_id"), F.col("_label").alias("label"))
    dlab = lab.select(F.col("_id").alias("doc_id"), F.col("_label").alias("doc_label"))
    scored = topk.join(dlab, "doc_id", "left").join(qlab, "query_id", "left")
    scored = scored.withColumn("_hit", F.coalesce(F.col("doc_label") == F.col("label"), F.lit(False)))
    per_q = scored.groupBy("query_id", "label").agg(
        F.count(F.lit(1)).alias("n_retrieved"),
        F.count_if("_hit").alias("hits"),
        F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_first_hit"),
    )
    per_q = per_q.join(per_label.withColumnRenamed("_label", "label"), "label", "left")
    n_rel = F.col("_n_label") - (1 if exclude_self else 0)
    has_rel = F.coalesce(n_rel, F.lit(0)) > 0
    return per_q.select(
        "query_id", "label", "n_retrieved", "hits",
        F.when(has_rel, F.col("hits") / n_rel).alias("recall_at_k"),
        F.when(has_rel, F.when(F.col("n_retrieved") > 0, F.col("hits") / F.least(F.col("n_retrieved"), F.lit(k)))
               .otherwise(0.0)).alias("precision_at_k"),
        F.when(has_rel, F.coalesce(1.0 / F.col("_first_hit"), F.lit(0.0))).alias("mrr"),
    )


def hit_doc_id(metadata_col: str = "metadata", chunk_id_col: str = "chunk_id"):
    """Document id of a hit: the ``doc_id`` metadata entry, else the chunk id."""
    return F.coalesce(F.element_at(F.col(metadata_col), F.lit("doc_id")), F.col(chunk_id_col).cast("string"))


def with_documents(topk: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Hits with what the index holds of them: ``chunk_id, text, metadata`` (a map of
    strings), and ``doc_id``, the document they belong to.  Hits without a chunk
    keep their id, with null text."""
    hits = topk.withColumnRenamed("doc_id", chunk_id)
    return hits.join(chunks, chunk_id, "left").withColumn("doc_id", hit_doc_id("metadata", chunk_id))
