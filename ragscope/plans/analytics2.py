"""Registered regime / pivot / profile / reducer queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.operators import reducers as RD
from ragscope.operators import reshape as RS
from ragscope.operators import stats as S
from ragscope.operators.ordering import group_rank
from ragscope.operators.quantiles import quantile_wide
from ragscope.plans.common import EVALS_METRICS, EVENT_METRICS, RUN_ORDER, event_metrics, r6
from ragscope.plans.oracle_analytics import EVALS_CTE, EVENTS_CTE, unpivot_long, values_list
from ragscope.sources.tables import EVALS_COLUMNS, evals

REGIME_METRICS = {
    "correctness": ("score_correctness", "mean"),
    "hallucination": ("score_hallucination", "mean"),
    "completion_tokens": ("generation_completion_tokens", "median"),
}
REGIMES = ("low", "high")
# Total order of evals rows: the reshaped metric first, then every column.
RESHAPE_ORDER = ["score_correctness"] + [c for c in EVALS_COLUMNS if c not in ("run_id", "score_correctness")]
FAMILY = "run_0"              # substring family selection (FLT-2)
PROMPT_P = 0.75
HARD_THRESHOLD = 0.95         # (session, claim) groups whose best correctness stays below
FLIER_COLS = ["latency_e2e_latency_ms", "score_hallucination"]
BOX_COLS = ["latency_e2e_latency_ms", "generation_tokens_per_second"]
PROFILE_ORDER = RUN_ORDER + ["run_99"]
BINS = 30


def _regimes(spark, sf_dir):
    ev = evals(spark, sf_dir)
    return ev.withColumn("recall_regime", RS.recall_regime("metrics_recall_at_k", 0.4, 0.8))


def recall_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RS.regime_table(_regimes(spark, sf_dir), "run_id", "recall_regime", REGIME_METRICS, REGIMES)
    return r6(S.order_table(spark, "run_id", RUN_ORDER).join(out, "run_id", "inner"))


def regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploration variant (< 0.4 / > 0.4): observations and distinct claims per run and regime."""
    ev = evals(spark, sf_dir).withColumn(
        "recall_regime", RS.recall_regime("metrics_recall_at_k", 0.4, exploration=True))
    return ev.where(F.col("recall_regime").isNotNull()).groupBy("run_id", "recall_regime").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("claim_id").alias("n_claims"))


def regime_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RS.regime_reshape(_regimes(spark, sf_dir), "score_correctness", "run_id", "recall_regime",
                            RESHAPE_ORDER, RUN_ORDER)
    return r6(out)


def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evals(spark, sf_dir)
    thr = quantile_wide(ev, ["generation_prompt_tokens"], [PROMPT_P]).first()[0]  # one scalar
    fam = ev.where(F.col("run_id").contains(FAMILY))
    split = F.when(F.col("generation_prompt_tokens") >= F.lit(thr), "long").otherwise("short")
    out = fam.where(F.col("generation_prompt_tokens").isNotNull()).groupBy("run_id", split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score_correctness").alias("correctness"),
        F.avg("score_hallucination").alias("hallucination"))
    return r6(out.withColumn("threshold", F.lit(thr).cast("double")))


def hard_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evals(spark, sf_dir)
    worst = ev.groupBy("session_id", "claim_id").agg(F.max("score_correctness").alias("_best")).where(
        F.col("_best") < HARD_THRESHOLD)
    return r6(ev.join(worst.select("session_id", "claim_id"), ["session_id", "claim_id"], "left_semi"))


def metric_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = r6(RS.cell_pivot(evals(spark, sf_dir), "latency_ttft_ms", "run_id", "claim_id", "mean", RUN_ORDER))
    # one column per run of the report, empty for runs without rows
    return cells.select("claim_id", *[(F.col(r) if r in cells.columns else F.lit(None).cast("double")).alias(r) for r in RUN_ORDER])


def dot_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(RS.profiles(evals(spark, sf_dir), "score_hallucination", "run_id", "claim_id", "median",
                          PROFILE_ORDER, show_std=True))


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(RD.box_stats(evals(spark, sf_dir), BOX_COLS, "run_id"))


def box_fliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = RD.fliers(evals(spark, sf_dir), FLIER_COLS, "run_id", whis=0.5)
    return r6(points.groupBy("run_id", "metric", "v").agg(F.count(F.lit(1)).alias("n")))


def histogram_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(RD.histograms(event_metrics(spark, sf_dir), EVENT_METRICS, "event_type", BINS))


def session_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_metrics(spark, sf_dir)
    return group_rank(ev.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "seq").select(
        "event_id", "user_id", "seq")


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sorted_ids(evals(spark, sf_dir), "session_id")


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_counts(evals(spark, sf_dir), "run_id", "claim_id", "score_correctness")


def token_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_counts(evals(spark, sf_dir), "generation_completion_tokens")


QUERIES = {
    "recall_regimes": recall_regimes,
    "regime_counts": regime_counts,
    "regime_reshape": regime_reshape,
    "prompt_split": prompt_split,
    "hard_claims": hard_claims,
    "metric_heatmap": metric_heatmap,
    "dot_profiles": dot_profiles,
    "box_stats": box_stats,
    "box_fliers": box_fliers,
    "histogram_grid": histogram_grid,
    "session_timeline": session_timeline,
    "session_ids": session_ids,
    "run_counts": run_counts,
    "token_value_counts": token_value_counts,
}

# --- DuckDB oracles ----------------------------------------------------------

_REG = f"""{EVALS_CTE}, b as (select *, case when metrics_recall_at_k < 0.4 then 'low'
                                     when metrics_recall_at_k >= 0.8 then 'high' end as recall_regime from evals)"""


def _recall_regimes() -> str:
    aggs = []
    for n, (c, a) in REGIME_METRICS.items():
        agg = f"avg({c})" if a == "mean" else f"quantile_cont({c}, 0.5)"
        for r in REGIMES:
            aggs.append(f"round({agg.replace(f'({c}', f'(case when recall_regime = {chr(39)}{r}{chr(39)} then {c} end')}, 6) as {n}_{r}")
    return f"""
with {_REG}, {values_list('o', RUN_ORDER)},
a as (select run_id, {', '.join(aggs)} from b where recall_regime is not null group by run_id)
select a.*, o._ord from a join o on a.run_id = o.val"""


def _regime_reshape() -> str:
    order = ", ".join(f"{c} asc nulls first" for c in RESHAPE_ORDER)
    pv = ", ".join(f"round(max(case when run_id = '{r}' then score_correctness end), 6) as {r}" for r in RUN_ORDER)
    return f"""
with {_REG}, r as (select run_id, recall_regime, score_correctness,
                          row_number() over (partition by run_id, recall_regime order by {order}) - 1 as _obs
                   from b where recall_regime is not null)
select recall_regime, _obs, {pv} from r group by recall_regime, _obs"""


def _heatmap() -> str:
    cells = ", ".join(f"round(avg(case when run_id = '{r}' then latency_ttft_ms end), 6) as {r}" for r in RUN_ORDER)
    return f"with {EVALS_CTE} select claim_id, {cells} from evals where run_id is not null and claim_id is not null group by claim_id"


def _box() -> str:
    return f"""
with {EVALS_CTE}, long as ({unpivot_long('evals', ['run_id'], BOX_COLS)}),
q as (select run_id, metric, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
             quantile_cont(v, 0.75) as q3 from long where run_id is not null group by run_id, metric)
select l.run_id, l.metric, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, count(*) as n,
       round(min(case when v >= q1 - 1.5 * (q3 - q1) then v end), 6) as whisker_lo,
       round(max(case when v <= q3 + 1.5 * (q3 - q1) then v end), 6) as whisker_hi,
       count_if(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_fliers
from long l join q using (run_id, metric) group by l.run_id, l.metric, q1, median, q3"""


def _hist() -> str:
    return f"""
with {EVENTS_CTE}, long as ({unpivot_long('ev', ['event_type'], EVENT_METRICS)}),
rg as (select event_type, metric,
              case when min(v) = max(v) then min(v) - 0.5 else min(v) end as lo,
              case when min(v) = max(v) then max(v) + 0.5 else max(v) end as hi
       from long where event_type is not null group by event_type, metric),
c as (select l.event_type, l.metric,
             cast(least(floor((v - lo) * {BINS} / (hi - lo)), {BINS - 1}) as integer) as bin, count(*) as cnt
      from long l join rg using (event_type, metric) group by all),
e as (select event_type, metric, lo, hi, cast(unnest(generate_series(0, {BINS - 1})) as integer) as bin from rg)
select e.event_type, e.metric, e.bin, round(lo + bin * (hi - lo) / {BINS}, 6) as lo,
       round(lo + (bin + 1) * (hi - lo) / {BINS}, 6) as hi, coalesce(cnt, 0) as count
from e left join c using (event_type, metric, bin)"""


ORACLES = {
    "recall_regimes": _recall_regimes(),
    "regime_counts": f"""
with {EVALS_CTE}, b as (select *, case when metrics_recall_at_k < 0.4 then 'low'
                                     when metrics_recall_at_k > 0.4 then 'high' end as recall_regime from evals)
select run_id, recall_regime, count(*) as n, count(distinct claim_id) as n_claims
from b where recall_regime is not null group by run_id, recall_regime""",
    "regime_reshape": _regime_reshape(),
    "prompt_split": f"""
with {EVALS_CTE}, t as (select quantile_cont(generation_prompt_tokens, {PROMPT_P}) as thr from evals)
select run_id, case when generation_prompt_tokens >= thr then 'long' else 'short' end as split, count(*) as n,
       round(avg(score_correctness), 6) as correctness, round(avg(score_hallucination), 6) as hallucination,
       round(cast(thr as double), 6) as threshold
from evals, t where run_id like '%{FAMILY}%' and generation_prompt_tokens is not null group by all""",
    "hard_claims": f"""
with {EVALS_CTE}, w as (select session_id, claim_id from evals group by session_id, claim_id
                       having max(score_correctness) < {HARD_THRESHOLD})
select run_id, session_id, claim_id, {', '.join(f'round({c}, 6) as {c}' for c in EVALS_METRICS)}
from evals where (session_id, claim_id) in (select (session_id, claim_id) from w)""",
    "metric_heatmap": _heatmap(),
    "dot_profiles": f"""
with {EVALS_CTE}, {values_list('o', PROFILE_ORDER)},
c as (select run_id, claim_id, quantile_cont(score_hallucination, 0.5) as value, stddev_samp(score_hallucination) as std
      from evals where run_id is not null and claim_id is not null group by run_id, claim_id),
v2 as (select distinct claim_id from evals where run_id is not null and claim_id is not null)
select v2.claim_id, o.val as run_id, o._ord, round(c.value, 6) as value, round(c.std, 6) as std
from v2 cross join o left join c on c.run_id = o.val and c.claim_id = v2.claim_id""",
    "box_stats": _box(),
    "histogram_grid": _hist(),
    "box_fliers": f"""
with {EVALS_CTE}, long as ({unpivot_long('evals', ['run_id'], FLIER_COLS)}),
q as (select run_id, metric, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from long where run_id is not null group by run_id, metric)
select l.run_id, l.metric, round(v, 6) as v, count(*) as n from long l join q using (run_id, metric)
where v < q1 - 0.5 * (q3 - q1) or v > q3 + 0.5 * (q3 - q1) group by l.run_id, l.metric, v""",
    "session_timeline": """
select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events""",
    "session_ids": f"with {EVALS_CTE} select distinct session_id from evals where session_id is not null",
    "run_counts": f"""
with {EVALS_CTE} select run_id, count(*) as size, count(distinct claim_id) as nunique,
       count(score_correctness) as non_null from evals where run_id is not null group by run_id""",
    "token_value_counts": f"""
with {EVALS_CTE} select generation_completion_tokens, count(*) as count from evals
where generation_completion_tokens is not null group by generation_completion_tokens""",
}
