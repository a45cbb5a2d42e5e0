"""Grouped statistics over the wide metric table.

All operators are DataFrame in, DataFrame out.  Moments (count, mean, std,
min, max) come from one hash aggregate with map-side partial aggregation;
quantiles come from :mod:`ragscope.operators.quantiles` and are joined on
the (small) group key.  Group orders supplied by the caller are literal
driver-side lists, so the order table they become has a known size and is
broadcast; the aggregated side never is unless AQE measures it small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.functions.stats import resolve_stat
from ragscope.operators.quantiles import quantile_wide

METRIC_PREFIXES = ("metrics_", "latency_", "generation_", "hardware_", "score_")

# Column groups and display labels of the metric table.
LATENCY_COLS = {
    "latency_e2e_latency_ms": "E2E Latency (ms)",
    "latency_ttft_ms": "TTFT (ms)",
    "latency_llm_generation_latency_ms": "LLM Gen. (ms)",
    "latency_retrieval_latency_ms": "Retrieval (ms)",
    "latency_predicted_per_token_ms": "ms / token",
}
GENERATION_COLS = {
    "generation_tokens_per_second": "Tokens / sec",
    "generation_completion_tokens": "Completion tokens",
    "generation_prompt_tokens": "Prompt tokens",
}
RETRIEVAL_COLS = {
    "metrics_recall_at_k": "Recall@k",
    "metrics_precision_at_k": "Precision@k",
    "metrics_mrr": "MRR",
}
HARDWARE_COLS = {
    "hardware_max_ram_usage_mb": "RAM (MB)",
    "hardware_avg_cpu_utilization_pct": "CPU (%)",
}
GENERATION_QUALITY_COLS = {
    "score_Correctness": "Correctness",
    "score_Context Recall": "Context Recall",
    "score_Evaluate Hallucination V2": "Hallucination",
    "score_Faithfulness custom": "Faithfulness",
    "metrics_recall_at_k": "Recall@k",
    "metrics_mrr": "MRR",
}
METRIC_LABELS = {**LATENCY_COLS, **GENERATION_COLS, **RETRIEVAL_COLS, **HARDWARE_COLS, **GENERATION_QUALITY_COLS}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns of ``cols`` that exist in ``df`` (schema inspection only)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def numeric_metric_cols(df: DataFrame) -> list[str]:
    """Metric-family columns that are numeric and not boolean."""
    return [
        f.name
        for f in df.schema.fields
        if f.name.startswith(METRIC_PREFIXES) and isinstance(f.dataType, _NUMERIC)
    ]


def order_table(spark: SparkSession, name: str, values: Sequence) -> DataFrame:
    """A literal ``(name, _ord)`` table from a caller-supplied order list."""
    rows = [(v, i) for i, v in enumerate(values)]
    dtype = "string" if all(isinstance(v, str) for v in values) else "double"
    return F.broadcast(spark.createDataFrame(rows, f"`{name}` {dtype}, _ord int"))


def label_column(col: str, labels: Mapping | None) -> F.Column:
    """Display label with fallback to the raw value (map literal lookup)."""
    raw = F.col(col).cast("string")
    if not labels:
        return raw
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(str(k)), F.lit(str(v)))])
    return F.coalesce(F.element_at(m, raw), raw)


def _moment_aggs(cols: Sequence[str]) -> list:
    out = []
    for c in cols:
        x = F.col(c).cast("double")
        out += [
            F.count(x).alias(f"{c}__count"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
        ]
    return out


def group_describe(df: DataFrame, cols: Sequence[str] | None = None, group_by: str = "session_id") -> DataFrame:
    """pandas ``groupby().describe()`` in long form:
    ``group, metric, count, mean, std, min, p25, p50, p75, max``."""
    cols = present(df, cols) if cols is not None else numeric_metric_cols(df)
    base = df.where(F.col(group_by).isNotNull())
    moments = base.groupBy(group_by).agg(*_moment_aggs(cols))
    qs = quantile_wide(base, cols, [0.25, 0.5, 0.75], by=[group_by])
    wide = moments.join(qs, on=group_by, how="left")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.col(f"{c}__count").alias("count"),
                F.col(f"{c}__mean").alias("mean"),
                F.col(f"{c}__std").alias("std"),
                F.col(f"{c}__min").alias("min"),
                F.col(f"{c}__q25").alias("p25"),
                F.col(f"{c}__q50").alias("p50"),
                F.col(f"{c}__q75").alias("p75"),
                F.col(f"{c}__max").alias("max"),
            )
            for c in cols
        ]
    )
    return wide.select(group_by, F.explode(rows).alias("_r")).select(group_by, "_r.*")


def stat_by_group(
    df: DataFrame,
    cols: Sequence[str],
    group_by: str = "session_id",
    order: Sequence | None = None,
    stat: str = "mean",
    std: bool = False,
    band: tuple[float, float] | None = None,
) -> DataFrame:
    """One statistic per (group, metric), optional ±std and percentile band.

    Restricted to and reindexed by ``order`` when given: every listed
    group appears (null stats when absent from the data), in list order
    (``_ord``).  Long form: ``group, _ord, metric, value[, std][, band_lo, band_hi]``.
    """
    spark = df.sparkSession
    cols = present(df, cols)
    spec = resolve_stat(stat)
    base = df.where(F.col(group_by).isNotNull())
    if order is not None:
        base = base.where(F.col(group_by).isin(list(order)))
    probs: list[float] = []
    if spec.kind == "quantile":
        probs.append(spec.p)
    if band is not None:
        probs += [band[0] / 100, band[1] / 100]
    probs = sorted(set(probs))

    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        if spec.kind == "mean":
            aggs.append(F.avg(x).alias(f"{c}__value"))
        elif spec.kind == "std":
            aggs.append(F.stddev_samp(x).alias(f"{c}__value"))
        if std:
            aggs.append(F.stddev_samp(x).alias(f"{c}__std"))
    grouped = None
    if aggs:
        grouped = base.groupBy(group_by).agg(*aggs)
    if probs:
        qs = quantile_wide(base, cols, probs, by=[group_by])
        grouped = qs if grouped is None else grouped.join(qs, on=group_by, how="full_outer")

    def q(c, p):
        return F.col(f"{c}__q{round(p * 100):g}")

    fields = []
    for c in cols:
        parts = [F.lit(c).alias("metric")]
        parts.append((q(c, spec.p) if spec.kind == "quantile" else F.col(f"{c}__value")).alias("value"))
        if std:
            parts.append(F.col(f"{c}__std").alias("std"))
        if band is not None:
            parts += [q(c, band[0] / 100).alias("band_lo"), q(c, band[1] / 100).alias("band_hi")]
        fields.append(F.struct(*parts))
    long = grouped.select(group_by, F.explode(F.array(*fields)).alias("_r")).select(group_by, "_r.*")
    if order is None:
        return long
    # Reindex: every (group in order) x metric cell, missing ones null.
    cells = order_table(spark, group_by, list(order)).withColumn(
        "metric", F.explode(F.array(*[F.lit(c) for c in cols]))
    )
    return cells.join(long, on=[group_by, "metric"], how="left")


def normalize(agg: DataFrame, value_cols: Sequence[str] = ("value",), scale_only: Sequence[str] = (),
              metric_col: str = "metric") -> DataFrame:
    """Min-max normalise aggregated values per metric across groups.

    Zero range divides by 1.  ``value_cols`` shift and scale (values, band
    edges); ``scale_only`` columns (std) only scale.  Runs on the already
    aggregated, group-sized table.
    """
    w = Window.partitionBy(metric_col)
    rng = F.max("value").over(w) - F.min("value").over(w)
    out = agg.withColumn("_lo", F.min("value").over(w)).withColumn(
        "_scale", F.when(rng == 0, F.lit(1.0)).otherwise(rng))
    for c in value_cols:
        out = out.withColumn(c, (F.col(c) - F.col("_lo")) / F.col("_scale"))
    for c in scale_only:
        out = out.withColumn(c, F.col(c) / F.col("_scale"))
    return out.drop("_lo", "_scale")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per metric, only columns with nulls, pct desc."""
    cols = present(df, cols) if cols is not None else numeric_metric_cols(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("null_count")) for c in cols])
    return (
        counts.select("_n", F.explode(rows).alias("_r"))
        .select("_r.metric", "_r.null_count", (F.col("_r.null_count") / F.col("_n") * 100).alias("null_pct"))
        .where(F.col("null_count") > 0)
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows, and rows that have a
    value.  One pass, whatever the number of columns."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c, _ in fields])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_c{i}").alias("non_null"))
                     for i, c, t in fields])
    return counts.select(F.col("_n").alias("n_rows"), F.explode(rows).alias("_r")).select("_r.*", "n_rows")


def run_summary(
    df: DataFrame,
    run_col: str = "run_id",
    mean_cols: Mapping[str, str] | None = None,
    median_cols: Mapping[str, str] | None = None,
    p90_cols: Mapping[str, str] | None = None,
    order: Sequence[str] | None = None,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per-run summary: means of quality scores, medians of throughput and
    resources, p90 latencies as whole numbers (half-even, like pandas)."""
    mean_cols = {k: v for k, v in (mean_cols or {}).items() if k in df.columns}
    median_cols = {k: v for k, v in (median_cols or {}).items() if k in df.columns}
    p90_cols = {k: v for k, v in (p90_cols or {}).items() if k in df.columns}
    base = df.where(F.col(run_col).isNotNull())
    if order is not None:
        base = base.where(F.col(run_col).isin(list(order)))
    means = base.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.col(c).cast("double")).alias(a) for c, a in mean_cols.items()],
    )
    qcols = list(median_cols) + list(p90_cols)
    probs = ([0.5] if median_cols else []) + ([0.9] if p90_cols else [])
    out = means
    if qcols:
        qs = quantile_wide(base, qcols, probs, by=[run_col])
        sel = [run_col]
        sel += [F.col(f"{c}__q50").alias(a) for c, a in median_cols.items()]
        sel += [F.bround(F.col(f"{c}__q90"), 0).cast("long").alias(a) for c, a in p90_cols.items()]
        out = out.join(qs.select(*sel), on=run_col, how="left")
    if labels is not None:
        out = out.withColumn("label", label_column(run_col, labels))
    if order is not None:
        out = order_table(df.sparkSession, run_col, list(order)).join(out, on=run_col, how="inner")
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value (nulls excluded), sorted by key."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(col)


def group_counts(df: DataFrame, group_by: str, distinct_col: str, nonnull_col: str) -> DataFrame:
    """Group size, number of distinct values and non-null count per group."""
    return df.where(F.col(group_by).isNotNull()).groupBy(group_by).agg(
        F.count(F.lit(1)).alias("size"),
        F.countDistinct(distinct_col).alias("nunique"),
        F.count(nonnull_col).alias("non_null"),
    )


def sorted_ids(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null ids (empty frame when the column is absent)."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{col}` string")
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
