"""Exact grouped quantiles (pandas / DuckDB ``quantile_cont`` linear rule) by selection.

Two passes, one method for every size, no sort and no copy of the values:

1. a mergeable rank sketch (Spark's ``percentile_approx``, ``ACCURACY``) is combined before
   the shuffle and brackets every wanted rank of each group and column between
   two of its values;
2. every row is held against its group's brackets: values below one are counted,
   values inside are counted by value, of those above only the least is kept - all of it
   combined before the shuffle, so what moves is a few ten thousandths of a
   group, and a value that most rows have is one row;
3. a running count over what is left gives the two rows that a rank lies between.

A group with a third of all rows is read by as many tasks as its rows need.  The
brackets are four times as wide as the sketch's error; were a rank outside all the same,
the query fails and gives no wrong value.  Null group keys are a group like any
other.  Output is long form: ``by..., metric, p, q``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragscope.operators.ordering import null_safe, written

#: Rank error of the sketch is one part in this; a bracket reaches WIDTH errors to both sides.
ACCURACY, WIDTH = 10_000, 4


def to_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``cols`` into ``(by..., metric, v)``, non-null values only."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])
    return (
        df.select(*[F.col(b) for b in by], F.explode(pairs).alias("_kv"))
        .select(*by, "_kv.metric", "_kv.v")
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    )


def _value(col: str):
    """The column as a double, null for NaN."""
    v = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(v), v)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    by, cols, probs = list(by), list(dict.fromkeys(cols)), [float(p) for p in dict.fromkeys(probs)]
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"quantile probability must be in [0, 1], got {p}")
    keys = [f"_g{i}" for i in range(max(1, len(by)))]  # without groups one that all rows share
    names = [f"_v{i}" for i in range(len(cols))]
    rows = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias(keys[0])],
                     *[_value(c).alias(v) for c, v in zip(cols, names, strict=True)])
    room = WIDTH / ACCURACY
    sides = [x for p in probs for x in (max(0.0, p - room), min(1.0, p + room))]
    brackets = written(rows.groupBy(*keys).agg(*[x for v in names for x in (
        F.percentile_approx(v, sides, ACCURACY).alias(f"{v}_at"), F.count(v).alias(f"{v}_n"))]), "brackets")
    brackets = brackets.withColumnsRenamed({k: f"b{k}" for k in keys})

    held = rows.join(brackets, null_safe(rows, brackets, [(k, f"b{k}") for k in keys]))
    asks = [(c, p, F.col(v), F.col(f"{v}_at")[2 * i], F.col(f"{v}_at")[2 * i + 1], F.col(f"{v}_n"))
            for c, v in zip(cols, names) for i, p in enumerate(probs)]
    # below and above a bracket: one row for each group; inside: one for each value
    around = held.groupBy(*keys).agg(*[x for n, (_, _, v, low, high, _) in enumerate(asks) for x in (
        F.count_if(v < low).alias(f"n{n}"), F.max(F.when(v < low, v)).alias(f"most{n}"), F.min(F.when(v > high, v)).alias(f"least{n}"))])
    entry = lambda n, side, own, count: F.struct(F.lit(n).alias("ask"), F.lit(side).alias("side"), own.alias("own"), count.alias("n"))
    outside = around.select(*keys, F.inline(F.array(*[x for n in range(len(asks)) for x in (
        entry(n, -1, F.col(f"most{n}"), F.col(f"n{n}")), entry(n, 1, F.col(f"least{n}"), F.lit(1).cast("long")))]))).where("own IS NOT NULL")
    inside = held.select(*keys, F.explode(F.array(*[F.when((v >= low) & (v <= high), F.struct(F.lit(n).alias("ask"), v.alias("own")))
                                                    for n, (_, _, v, low, high, _) in enumerate(asks)])).alias("a")).where("a IS NOT NULL").select(
        *keys, "a.ask", "a.own").groupBy(*keys, "ask", "own").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(0))
    totals = brackets.select(*[F.col(f"b{k}").alias(k) for k in keys], F.inline(F.array(*[F.struct(
        F.lit(n).alias("ask"), F.lit(c).alias("metric"), F.lit(p).alias("p"), (total - 1).alias("last")) for n, (c, p, _, _, _, total) in enumerate(asks)])))
    left = outside.unionByName(inside)
    upto = Window.partitionBy(*keys, "ask").orderBy("side", "own").rowsBetween(Window.unboundedPreceding, 0)
    placed = left.withColumn("end", F.sum("n").over(upto))
    totals = totals.withColumnsRenamed({k: f"t{k}" for k in [*keys, "ask"]})
    placed = placed.join(totals, null_safe(placed, totals, [(k, f"t{k}") for k in [*keys, "ask"]])).withColumn("h", F.col("last") * F.col("p"))
    missed = F.raise_error(F.lit("a quantile's rank lies outside its bracket")).cast("double")
    value = lambda r: F.when((F.col("side") == 0) | (r == F.when(F.col("side") < 0, F.col("end") - 1).otherwise(F.col("end") - F.col("n"))), F.col("own")).otherwise(missed)
    here = lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n"))
    lo, hi = F.floor("h").cast("long"), F.ceil("h").cast("long")
    out = placed.where(here(lo) | here(hi)).groupBy(*keys, "metric", "p", "h").agg(
        F.max(F.when(here(lo), value(lo))).alias("lo"), F.max(F.when(here(hi), value(hi))).alias("hi"))
    q = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "metric", "p", q.alias("q"))


def quantile_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                  name=lambda c, p: f"{c}__q{round(p * 100):g}") -> DataFrame:
    """``quantiles`` pivoted to one row per group: ``by..., <name(c,p)>``."""
    long = quantiles(df, cols, probs, by)
    aggs = [
        F.max(F.when((F.col("metric") == c) & (F.col("p") == float(p)), F.col("q"))).alias(name(c, p))
        for c in cols
        for p in probs
    ]
    if by:
        return long.groupBy(*by).agg(*aggs)
    return long.agg(*aggs)
