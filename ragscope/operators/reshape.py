"""Regimes, pivots and profiles over the wide metric table.

Pivots use an explicit value list (caller order, or the sorted distinct
values when none is given - a list as long as the number of groups), so
Spark does not run an extra distinct job per pivot and the output schema is
known up front.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscope.operators.ordering import group_rank
from ragscope.operators.quantiles import quantile_wide

AGGS = ("mean", "median", "std", "min", "max", "count")


def recall_regime(col: str = "metrics_recall_at_k", low: float = 0.4, high: float = 0.8,
                  exploration: bool = False, labels=("low", "high")) -> Column:
    """``low`` below ``low``; ``high`` at/above ``high`` (exploration variant:
    strictly above ``low``, so exactly ``low`` falls in neither)."""
    x = F.col(col)
    hi_pred = (x > low) if exploration else (x >= high)
    return F.when(x < low, labels[0]).when(hi_pred, labels[1])


def _agg(kind: str, c: str) -> Column:
    x = F.col(c).cast("double")
    return {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
            "count": F.count(x)}[kind]


def regime_table(df: DataFrame, run_col: str, regime_col: str, metrics: Mapping[str, tuple[str, str]],
                 regimes: Sequence[str] = ("low", "high")) -> DataFrame:
    """Per run, each metric per regime side by side, metric-major:
    ``<name>_<regime>`` for ``metrics = {name: (column, agg)}``."""
    base = df.where(F.col(regime_col).isNotNull() & F.col(run_col).isNotNull())
    keys = [run_col, regime_col]
    plain = {n: (c, a) for n, (c, a) in metrics.items() if a != "median"}
    med = {n: c for n, (c, a) in metrics.items() if a == "median"}
    long = base.groupBy(*keys).agg(*[_agg(a, c).alias(n) for n, (c, a) in plain.items()]) if plain else None
    if med:
        qs = quantile_wide(base, sorted(set(med.values())), [0.5], by=keys)
        qs = qs.select(*keys, *[F.col(f"{c}__q50").alias(n) for n, c in med.items()])
        long = qs if long is None else long.join(qs, keys, "full_outer")
    out = long.groupBy(run_col).agg(*[
        F.max(F.when(F.col(regime_col) == r, F.col(n))).alias(f"{n}_{r}") for n in metrics for r in regimes
    ])
    return out


def _in_order(df: DataFrame, var: str, order: Sequence | None) -> DataFrame:
    """Rows whose ``var`` is in ``order``, with its place there (``_row``); all rows, as they are, without an order."""
    if order is None:
        return df
    place = F.array_position(F.array(*[F.lit(v).cast(df.schema[var].dataType) for v in order]), F.col(var))
    return df.withColumn("_row", (place - 1).cast("int")).where(F.col("_row") >= 0)


def cell_pivot(df: DataFrame, metric: str, var1: str, var2: str, agg: str = "mean",
               var1_order: Sequence | None = None, var2_order: Sequence | None = None) -> DataFrame:
    """Heatmap matrix: one row per ``var2`` value, one column per ``var1``
    value (requested order intersected with what is present, else sorted),
    cell = ``agg`` of ``metric``.  With ``var2_order`` only its values, and their
    place in ``_row``.  Unknown ``agg`` -> ValueError."""
    if agg not in AGGS:
        raise ValueError(f"{agg!r} is not an aggregate of a cell (have {AGGS})")
    base = df.where(F.col(var1).isNotNull() & F.col(var2).isNotNull())
    present_vals = [r[0] for r in base.select(var1).distinct().collect()]  # one value per column
    cols = [v for v in var1_order if v in set(present_vals)] if var1_order else sorted(present_vals)
    if agg == "median":
        cells = quantile_wide(base, [metric], [0.5], by=[var1, var2]).select(
            var1, var2, F.col(f"{metric}__q50").alias("_v"))
    else:
        cells = base.groupBy(var1, var2).agg(_agg(agg, metric).alias("_v"))
    return _in_order(cells.groupBy(var2).pivot(var1, cols).agg(F.first("_v")), var2, var2_order)


def profiles(df: DataFrame, metric: str, var1: str, var2: str, agg: str = "mean",
             var1_order: Sequence | None = None, show_std: bool = True, var2_order: Sequence | None = None) -> DataFrame:
    """Long ``var2, var1, _ord, value[, std]`` for every (var2 value, var1 in
    order) cell; cells without data are kept as nulls.  With ``var2_order`` only
    its values, and their place in ``_row``."""
    if agg not in ("mean", "median", "min", "max"):
        raise ValueError(f"{agg!r} is not an aggregate of a profile (have mean, median, min, max)")
    base = df.where(F.col(var1).isNotNull() & F.col(var2).isNotNull())
    if agg == "median":
        cells = quantile_wide(base, [metric], [0.5], by=[var1, var2]).select(
            var1, var2, F.col(f"{metric}__q50").alias("value"))
        if show_std:
            cells = cells.join(base.groupBy(var1, var2).agg(_agg("std", metric).alias("std")), [var1, var2], "left")
    else:
        aggs = [_agg(agg, metric).alias("value")] + ([_agg("std", metric).alias("std")] if show_std else [])
        cells = base.groupBy(var1, var2).agg(*aggs)
    if var1_order is None:
        var1_order = sorted(r[0] for r in base.select(var1).distinct().collect())
    # Grid = distinct var2 values x the (literal, bounded) var1 order, built by
    # exploding the literal list - no join with a data-sized side.
    order = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(i).alias("o")) for i, v in enumerate(var1_order)])
    grid = base.select(var2).distinct().select(var2, F.explode(order).alias("_g")).select(
        var2, F.col("_g.v").cast(base.schema[var1].dataType).alias(var1), F.col("_g.o").alias("_ord"))
    return _in_order(grid.join(cells, [var1, var2], "left"), var2, var2_order)


def regime_reshape(df: DataFrame, metric: str, run_col: str, regime_col: str, order: Sequence[str],
                   runs: Sequence[str]) -> DataFrame:
    """Long -> (regime, observation) x run wide, the ``first`` value per cell.
    The observation number is the 0-based rank inside (run, regime) in
    ``order`` (pandas cumcount on a totally ordered frame)."""
    base = df.where(F.col(regime_col).isNotNull() & F.col(run_col).isNotNull())
    ranked = group_rank(base.select(run_col, regime_col, metric, *[c for c in order if c not in (run_col, regime_col, metric)]),
                        [run_col, regime_col], order, "_obs")
    return ranked.groupBy(regime_col, "_obs").pivot(run_col, list(runs)).agg(F.first(metric))
