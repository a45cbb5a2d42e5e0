"""Shared pieces of the registered queries: derived inputs and output rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.functions.numeric import round_binary
from ragscope.sources.tables import nan_to_null, read_table

# Run ids of the derived metric table, in report order (rule: run_00..run_15).
RUN_ORDER = [f"run_{i:02d}" for i in range(16)]

EVALS_METRICS = [
    "latency_e2e_latency_ms", "latency_ttft_ms", "generation_tokens_per_second",
    "generation_completion_tokens", "generation_prompt_tokens", "metrics_recall_at_k",
    "score_correctness", "score_hallucination",
]

EVENT_METRICS = ["event_value", "props_k"]
EVENT_IDS = ["event_id", "user_id", "event_type"]


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a small metric table: the value and the parsed ``props.k``.
    ``value`` stays a plain scan column (no NaN rewrite), so bound filters on it
    reach the Parquet scan; the operators treat NaN like pandas on their own
    (quantile inputs drop it, outlier predicates exclude it)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id", "event_type", "ts",
        F.col("value").alias("event_value"),
        F.get_json_object("props", "$.k").try_cast("double").alias("props_k"),
    )


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (comparison-friendly output)."""
    return df.select(*[
        round_binary(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nan_to_null(read_table(spark, sf_dir, "documents"))
