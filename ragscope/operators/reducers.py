"""The numbers behind the charts (drawing is out of scope): box statistics
and equal-width histograms per group and metric.

Both work on the long ``(group, metric, v)`` form.  Per-group statistics
are a table with one row per (group, metric); it is joined back to the
long data on those keys (AQE broadcasts it when its measured size is
small), and the final reductions are hash aggregates - no group is ever
collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.operators.quantiles import quantiles, to_long
from ragscope.operators.stats import GENERATION_COLS, GENERATION_QUALITY_COLS, HARDWARE_COLS, LATENCY_COLS, RETRIEVAL_COLS


def _boxes(base: DataFrame, cols: Sequence[str], group_by: str) -> DataFrame:
    """(group, metric, q1, median, q3), one row per box."""
    q = quantiles(base, cols, [0.25, 0.5, 0.75], by=[group_by])
    return q.groupBy(group_by, "metric").agg(*[
        F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


def _fences(whis: float):
    iqr = F.col("q3") - F.col("q1")
    return F.col("q1") - whis * iqr, F.col("q3") + whis * iqr


def box_stats(df: DataFrame, cols: Sequence[str], group_by: str, whis: float = 1.5) -> DataFrame:
    """``group, metric, n, q1, median, q3, whisker_lo, whisker_hi, n_fliers``.
    Whiskers are the furthest data points inside ``q1 - whis*IQR`` and
    ``q3 + whis*IQR``; fliers are the points outside."""
    base = df.where(F.col(group_by).isNotNull())
    lo, hi = _fences(whis)
    j = to_long(base, cols, [group_by]).join(_boxes(base, cols, group_by), [group_by, "metric"], "inner")
    return j.groupBy(group_by, "metric", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_hi"),
        F.count_if((F.col("v") < lo) | (F.col("v") > hi)).alias("n_fliers"),
    )


def fliers(df: DataFrame, cols: Sequence[str], group_by: str, whis: float = 1.5) -> DataFrame:
    """``group, metric, v`` of every point beyond its box's fences."""
    base = df.where(F.col(group_by).isNotNull())
    lo, hi = _fences(whis)
    j = to_long(base, cols, [group_by]).join(_boxes(base, cols, group_by), [group_by, "metric"], "inner")
    return j.where((F.col("v") < lo) | (F.col("v") > hi)).select(group_by, "metric", "v")


def histograms(df: DataFrame, cols: Sequence[str], group_by: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over each (group, metric)'s own min..max, last bin
    closed; a constant series uses min-0.5..max+0.5 like numpy.  Every bin
    is listed (zero counts included): ``group, metric, bin, lo, hi, count``."""
    if bins <= 0:
        raise ValueError("bins must be > 0")
    base = df.where(F.col(group_by).isNotNull())
    long = to_long(base, cols, [group_by])
    rng = long.groupBy(group_by, "metric").agg(F.min("v").alias("_mn"), F.max("v").alias("_mx"))
    rng = rng.select(
        group_by, "metric",
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
    )
    b = F.least(F.floor((F.col("v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    counts = long.join(rng, [group_by, "metric"], "inner").groupBy(group_by, "metric", b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    edges = rng.select(group_by, "metric", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return edges.join(counts, [group_by, "metric", "bin"], "left").select(
        group_by, "metric", "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


#: Named sets of histograms: the metric table's column groups with their labels.
HISTOGRAM_SETS = {
    "latency": LATENCY_COLS, "generation": GENERATION_COLS, "retrieval": RETRIEVAL_COLS,
    "hardware": HARDWARE_COLS, "generation_quality": GENERATION_QUALITY_COLS,
}


def histogram_sets(df: DataFrame, group_by: str, bins: int = 30, sets=HISTOGRAM_SETS) -> DataFrame:
    """``histograms`` of every named set whose columns the table has: ``hist_set, label``
    and the columns of ``histograms``.  A column in several sets is counted once."""
    members = [(s, c, label) for s, cols in sets.items() for c, label in cols.items() if c in df.columns]
    cols = list(dict.fromkeys(c for _, c, _ in members))
    if not cols:
        raise ValueError("the table has no column of these histogram sets")
    of = F.array(*[F.struct(F.lit(s).alias("hist_set"), F.lit(c).alias("c"), F.lit(label).alias("label")) for s, c, label in members])
    own = F.filter(of, lambda m: m["c"] == F.col("metric"))
    h = histograms(df, cols, group_by, bins)
    return h.select("*", F.explode(own).alias("_m")).select("_m.hist_set", "_m.label", *h.columns)


def scatter(df: DataFrame, x: str, y: str, group_by: str) -> DataFrame:
    """Scatter projection: the (group, x, y) points with both coordinates present."""
    return df.where(F.col(group_by).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(group_by, x, y)
