"""Folding raw samples into per-request measurements (aggregates with map-side
partial aggregation: a request with a third of all samples is combined per
task before the shuffle; first and last values by struct order make Spark sort
within tasks).

* ``request_timing`` - streamed-response timing: TTFT = first non-empty
  delta - request start (no delta: last chunk - start); tail = max(0, last
  chunk - first delta); tokens/s = tokens / tail seconds, 0 when either is 0.
* ``hardware_fold`` - max RAM, mean CPU, max temperature (null without
  samples), swap counters as end - start clamped at 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _us(a: Column, b: Column) -> Column:
    """Microseconds from ``a`` to ``b`` (works for TIMESTAMP and TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", a, b)


def request_timing(events: DataFrame, keys: Sequence[str], ts: str, is_delta: Column,
                   tokens: Column | None = None) -> DataFrame:
    """``keys..., ttft_ms, predicted_ms, completion_tokens, tokens_per_second``.
    ``tokens`` defaults to the number of non-empty deltas."""
    agg = events.groupBy(*keys).agg(
        F.min(ts).alias("_start"),
        F.max(ts).alias("_last"),
        F.min(F.when(is_delta, F.col(ts))).alias("_first"),
        (F.count_if(is_delta) if tokens is None else F.sum(tokens)).cast("long").alias("completion_tokens"),
    )
    ttft = F.when(F.col("_first").isNotNull(), _us(F.col("_start"), F.col("_first"))).otherwise(
        _us(F.col("_start"), F.col("_last"))) / F.lit(1000.0)
    pred = F.when(F.col("_first").isNotNull(),
                  F.greatest(F.lit(0.0), _us(F.col("_first"), F.col("_last")) / F.lit(1000.0))).otherwise(F.lit(0.0))
    return agg.select(
        *keys, ttft.alias("ttft_ms"), pred.alias("predicted_ms"), "completion_tokens",
        F.when((pred > 0) & (F.col("completion_tokens") > 0), F.col("completion_tokens") / (pred / 1000.0))
        .otherwise(F.lit(0.0)).alias("tokens_per_second"),
    )


def hardware_fold(samples: DataFrame, keys: Sequence[str], order: Sequence[str], ram: str, cpu: str,
                  temp: Column | None = None, swap_in: str | None = None, swap_out: str | None = None) -> DataFrame:
    """``keys..., max_ram_usage_mb, avg_cpu_utilization_pct, peak_cpu_temp_c,
    swap_in_bytes, swap_out_bytes`` (missing RAM/CPU samples -> 0.0)."""
    o = F.struct(*order)

    def delta(c):
        return F.greatest(F.lit(0), F.max_by(c, o) - F.min_by(c, o)).cast("long")  # integers stay integers

    aggs = [
        F.coalesce(F.max(ram), F.lit(0.0)).cast("double").alias("max_ram_usage_mb"),
        F.coalesce(F.avg(cpu), F.lit(0.0)).alias("avg_cpu_utilization_pct"),
        (F.max(temp) if temp is not None else F.lit(None)).cast("double").alias("peak_cpu_temp_c"),
        (delta(swap_in) if swap_in else F.lit(0).cast("long")).alias("swap_in_bytes"),
        (delta(swap_out) if swap_out else F.lit(0).cast("long")).alias("swap_out_bytes"),
    ]
    return samples.groupBy(*keys).agg(*aggs)


def ttft_from_parts(prompt_ms: str, per_token_ms: str) -> Column:
    """TTFT reported by a local server = prompt time + one token's time."""
    return F.col(prompt_ms) + F.col(per_token_ms)
