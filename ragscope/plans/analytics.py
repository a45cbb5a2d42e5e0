"""Registered analytics queries over the wide metric table and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragscope.operators import outliers as O
from ragscope.operators import stats as S
from ragscope.plans.common import EVALS_METRICS, EVENT_IDS, EVENT_METRICS, RUN_ORDER, event_metrics, r6
from ragscope.sources.tables import evals

SUMMARY_MEANS = {"score_correctness": "correctness", "score_hallucination": "hallucination"}
SUMMARY_MEDIANS = {"generation_tokens_per_second": "tokens_per_sec",
                   "generation_completion_tokens": "completion_tokens"}
SUMMARY_P90 = {"latency_e2e_latency_ms": "e2e_p90_ms", "latency_ttft_ms": "ttft_p90_ms"}

BAND_COLS = ["latency_e2e_latency_ms", "latency_ttft_ms", "generation_tokens_per_second"]
BAND_ORDER = RUN_ORDER + ["run_99"]  # run_99 has no rows: reindexing keeps it as nulls
TREND_COLS = ["score_correctness", "score_hallucination", "metrics_recall_at_k"]


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evals(spark, sf_dir)
    kept = O.exclude_outliers(ev, EVALS_METRICS, method="iqr", threshold=3.0)
    out = S.run_summary(kept, "run_id", SUMMARY_MEANS, SUMMARY_MEDIANS, SUMMARY_P90, order=RUN_ORDER)
    return r6(out)


def group_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.group_describe(evals(spark, sf_dir), EVALS_METRICS, group_by="session_id"))


def group_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.stat_by_group(evals(spark, sf_dir), BAND_COLS, group_by="run_id", order=BAND_ORDER,
                          stat="p90", std=True, band=(10, 90))
    return r6(out)


def normalised_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = S.stat_by_group(evals(spark, sf_dir), TREND_COLS, group_by="session_id", stat="mean",
                          std=True, band=(25, 75))
    return r6(S.normalize(agg, value_cols=("value", "band_lo", "band_hi"), scale_only=("std",)))


def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dataset_info(evals(spark, sf_dir))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.null_profile(evals(spark, sf_dir), EVALS_METRICS))


def find_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_metrics(spark, sf_dir)
    return r6(O.find_outliers(ev, EVENT_METRICS, method="iqr", threshold=3.0, id_cols=EVENT_IDS))


def find_outliers_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_metrics(spark, sf_dir)
    return r6(O.find_outliers(ev, EVENT_METRICS, method="zscore", threshold=3.0, id_cols=EVENT_IDS))


def exclude_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_metrics(spark, sf_dir).drop("ts")
    return r6(O.exclude_outliers(ev, EVENT_METRICS, method="iqr", threshold=3.0))


def outlier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_metrics(spark, sf_dir)
    return r6(O.outlier_summary(ev, EVENT_METRICS, method="iqr", threshold=3.0))


QUERIES = {
    "run_summary": run_summary,
    "group_describe": group_describe,
    "group_band": group_band,
    "normalised_trend": normalised_trend,
    "null_profile": null_profile,
    "dataset_info": dataset_info,
    "find_outliers": find_outliers,
    "find_outliers_z": find_outliers_z,
    "exclude_outliers": exclude_outliers,
    "outlier_summary": outlier_summary,
}
