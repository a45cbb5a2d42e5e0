"""Scoring evaluations and summarising runs.

* ``is_abstention`` / ``abstention_rate`` - empty (after Unicode strip) or
  containing an abstention phrase, case-insensitive.
* ``score_runs`` - per evaluation: recall@k, precision@k, MRR (null when no
  relevant document), abstention flag, hits returned, cited ids and context.
* ``run_quality`` - mean metrics over the rows that have a recall value
  (0.0 when none), abstention count and total, per key.
* ``eval_grid`` / ``dry_run`` - configs x repeats x first-N entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragscope.functions import irmetrics as M
from ragscope.functions.text import is_abstention
from ragscope.operators.ordering import with_ordinal

CONFIG_BLOCK = 1_000  # run configurations set against all entries at a time


def abstention_rate(df: DataFrame, output_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of abstaining outputs per key (0.0 for a key with no outputs)."""
    flag = is_abstention(output_col).cast("double")
    agg = [F.count(F.col(output_col)).alias("n_outputs"),
           F.count_if(is_abstention(output_col) & F.col(output_col).isNotNull()).alias("n_abstentions"),
           F.coalesce(F.avg(F.when(F.col(output_col).isNotNull(), flag)), F.lit(0.0)).alias("abstention_rate")]
    return df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)


def score_runs(evals: DataFrame, retrieved: str = "retrieved", relevant: str = "relevant",
               output: str = "output", k: int | str | Column = 3, chunks: str | None = None) -> DataFrame:
    """Add the per-evaluation scores to a frame holding, per evaluation, the
    retrieved doc ids (ranked), the relevant ids and the model output."""
    cols = M.score_columns(retrieved, relevant, k)
    out = evals.select(
        "*",
        *[c.alias(n) for n, c in cols.items()],
        is_abstention(output).alias("is_abstention"),
        F.size(F.coalesce(F.col(retrieved), F.array())).alias("retrieval_k"),
        F.array_join(F.coalesce(F.col(retrieved).cast("array<string>"), F.array().cast("array<string>")), ",").alias(
            "cited_doc_ids"),
    )
    if chunks is not None:
        out = out.withColumn("retrieval_context",
                             F.array_join(F.coalesce(F.col(chunks), F.array().cast("array<string>")), "\n---\n"))
    return out


def score_grid(grid: DataFrame, hits: DataFrame, truth: DataFrame, outputs: DataFrame, claim: str = "claim_id",
               k: str = "k") -> DataFrame:
    """Score a grid of evaluations against hits, truth and outputs, joined by claim.

    ``grid``: run_id, rep, claim, k.  ``hits``: claim, rank (1 is best), doc_id, and
    run_id if runs retrieve differently.  ``truth``: claim, doc_id of every
    relevant document.  ``outputs``: claim, output, and run_id if there is one.
    Per evaluation: recall@k and precision@k over the first k distinct documents,
    MRR over all hits (all null where nothing is relevant), hits returned,
    and whether the output abstains.  Everything is a join or an aggregate over
    one row per hit, so no evaluation is a list in one task.
    """
    keys = ["run_id", "rep", claim]
    shared = [c for c in ("run_id", claim) if c in hits.columns]
    relevant = truth.select(claim, F.col("doc_id").alias("_doc")).where(F.col("_doc").isNotNull()).distinct()
    # the first rank of each document, and its place among distinct documents
    ranked = hits.groupBy(*shared, "doc_id").agg(F.min("rank").alias("_rank"), F.count(F.lit(1)).alias("_times"))
    ranked = ranked.withColumn("_place", F.row_number().over(Window.partitionBy(*shared).orderBy("_rank", "doc_id")))
    marked = ranked.join(relevant, (ranked[claim] == relevant[claim]) & (ranked["doc_id"] == relevant["_doc"]), "left").select(
        *[ranked[c] for c in shared], "_rank", "_place", "_times", F.col("_doc").isNotNull().alias("_hit"))
    # evaluations of one claim with one k score alike: hits meet distinct pairs, not every run
    asked = grid.select(*shared, F.col(k).alias("_k")).distinct()
    per = asked.join(marked, shared, "left").groupBy(*shared, "_k").agg(
        F.count_if(F.col("_place") <= F.col("_k")).alias("_top"),
        F.count_if((F.col("_place") <= F.col("_k")) & F.col("_hit")).alias("_found"),
        F.min(F.when(F.col("_hit"), F.col("_rank"))).alias("_first"),
        F.coalesce(F.sum("_times"), F.lit(0)).alias("retrieval_k"))
    per = grid.select(*keys, F.col(k).alias("_k")).join(per, [*shared, "_k"]).join(relevant.groupBy(claim).agg(F.count(F.lit(1)).alias("_relevant")), claim, "left").join(
        outputs, [c for c in ("run_id", claim) if c in outputs.columns], "left")
    scored = F.col("_relevant") > 0
    return per.select(
        *keys, F.when(scored, F.col("_found") / F.col("_relevant")).alias("recall_at_k"),
        F.when(scored, F.when(F.col("_top") > 0, F.col("_found") / F.col("_top")).otherwise(0.0)).alias("precision_at_k"),
        F.when(scored, F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        "retrieval_k", is_abstention("output").alias("is_abstention"))


def run_quality(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Run summary: ``n_results, n_scored, recall_at_k, precision_at_k, mrr
    [, abstentions]`` per key."""
    scored = F.col("recall_at_k").isNotNull()
    aggs = [
        F.count(F.lit(1)).alias("n_results"),
        F.count(F.col("recall_at_k")).alias("n_scored"),
        F.coalesce(F.avg("recall_at_k"), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(scored, F.col("precision_at_k"))), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.avg(F.when(scored, F.col("mrr"))), F.lit(0.0)).alias("mrr"),
    ]
    if "is_abstention" in results.columns:
        aggs.append(F.count_if(F.col("is_abstention")).alias("abstentions"))
    return results.groupBy(*keys).agg(*aggs) if keys else results.agg(*aggs)


def _config_blocks(configs: DataFrame, size: int) -> Iterator[list]:
    block = []
    for row in configs.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def eval_grid(configs: DataFrame, entries: DataFrame, order: Sequence[str], run_col: str = "run_id",
              repeat_col: str = "repeat", limit_col: str = "limit",
              block_size: int = CONFIG_BLOCK) -> DataFrame:
    """One row per (config, repetition, entry) to evaluate.

    ``repeat`` null -> 1; ``limit`` keeps the first N entries in ``order``
    (null -> all).  Session id ``run_<8 hex>`` is derived from the run id and
    repetition, so a retried task produces the same ids.  The entries are ranked
    once, into a written table; the configurations meet them block by block, as
    literal arrays exploded on the entry side, so no entry is shuffled or joined
    however many configurations there are.
    """
    kind = "array<struct<run_id:string,repeat:int,limit:bigint>>"
    ent = with_ordinal(entries, list(order), "entry_index")
    session = F.concat(F.lit("run_"), F.substring(F.sha2(F.concat_ws(":", F.col("_c.run_id"), F.col("rep").cast("string")), 256), 1, 8))
    grids = []
    for block in [*_config_blocks(configs.select(run_col, repeat_col, limit_col), block_size)] or [[]]:
        cfg = F.array(*[
            F.struct(F.lit(r[0]).cast("string").alias("run_id"),
                     F.lit(1 if r[1] is None else int(r[1])).alias("repeat"),
                     F.lit(r[2]).cast("long").alias("limit"))
            for r in block
        ]).cast(kind)
        grids.append(
            ent.select("*", F.explode(cfg).alias("_c"))
            .where(F.col("_c.limit").isNull() | (F.col("entry_index") < F.col("_c.limit")))
            .select("*", F.explode(F.sequence(F.lit(1), F.col("_c.repeat"))).alias("rep"))
            .select(F.col("_c.run_id").alias("run_id"), "rep", session.alias("session_id"), "entry_index", *entries.columns))
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out


def dry_run(configs: DataFrame, entries: DataFrame, run_col: str = "run_id", repeat_col: str = "repeat",
            limit_col: str = "limit") -> DataFrame:
    """Per config: entries to run, repetitions and evaluations - no evaluation."""
    n = entries.agg(F.count(F.lit(1)).alias("n_entries")).scalar()  # scalar subquery
    out = configs.select(F.col(run_col).cast("string").alias("run_id"),
                         F.coalesce(F.col(repeat_col).cast("int"), F.lit(1)).alias("repeat"),
                         F.col(limit_col).cast("long").alias("limit"), n.alias("n_entries"))
    run_n = F.when(F.col("limit").isNull(), F.col("n_entries")).otherwise(F.least("limit", "n_entries"))
    return out.select("run_id", "repeat", F.col("limit").alias(limit_col), run_n.alias("entries_to_run"),
                      (run_n * F.col("repeat")).alias("evaluations"))
