"""Outlier rules over metric columns (IQR or z-score, global bounds).

Bounds are one row computed by a single aggregation pass (quantiles by the
skew-proof rank selection, moments by a hash aggregate).  That one row is
fetched once and inlined into the row filter as literals, so the large
side is never joined, shuffled or funnelled through one task, and the
bound predicates reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscope.functions.numeric import round_binary
from ragscope.operators.quantiles import quantile_wide
from ragscope.operators.stats import numeric_metric_cols, present

ID_COLS = ("session_id", "run_id", "claim_id", "trace_id")


def outlier_bounds(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """One row: ``<col>__lower``, ``<col>__upper`` per column; both null when
    the spread (IQR or std) is zero, which disables the rule for it."""
    if method == "iqr":
        qs = quantile_wide(df, cols, [0.25, 0.75])
        sel = []
        for c in cols:
            q1, q3 = F.col(f"{c}__q25"), F.col(f"{c}__q75")
            iqr = q3 - q1
            ok = iqr != 0
            sel += [F.when(ok, q1 - threshold * iqr).alias(f"{c}__lower"),
                    F.when(ok, q3 + threshold * iqr).alias(f"{c}__upper")]
        return qs.select(*sel)
    if method == "zscore":
        mom = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}__mu") for c in cols],
                     *[F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__sd") for c in cols])
        sel = []
        for c in cols:
            mu, sd = F.col(f"{c}__mu"), F.col(f"{c}__sd")
            ok = sd != 0
            sel += [F.when(ok, mu - threshold * sd).alias(f"{c}__lower"),
                    F.when(ok, mu + threshold * sd).alias(f"{c}__upper")]
        return mom.select(*sel)
    raise ValueError(f"unknown outlier method {method!r}")


class _Bounds:
    """The fetched bounds row; ``lower(c)``/``upper(c)`` are literal columns."""

    def __init__(self, row: dict):
        self.row = row

    def lower(self, c: str) -> Column:
        return F.lit(self.row.get(f"{c}__lower")).cast("double")

    def upper(self, c: str) -> Column:
        return F.lit(self.row.get(f"{c}__upper")).cast("double")


def _bounds_scalar(df: DataFrame, cols, method, threshold) -> _Bounds:
    row = outlier_bounds(df, cols, method, threshold).first()
    return _Bounds(row.asDict() if row is not None else {})


def _out_pred(c: str, b: _Bounds) -> Column | None:
    """``x < lower OR (x > upper AND x <= +inf)``: plain comparisons with
    literals (Parquet can take them when ``c`` is a scan column), and NaN -
    which Spark orders above +inf - is never an outlier, as in pandas."""
    lo, hi = b.row.get(f"{c}__lower"), b.row.get(f"{c}__upper")
    if lo is None or hi is None:  # zero spread: the rule is off for this column
        return None
    x = F.col(c)
    return (x < F.lit(lo)) | ((x > F.lit(hi)) & (x <= F.lit(float("inf"))))


def _is_out(c: str, b: _Bounds) -> Column:
    p = _out_pred(c, b)
    return F.lit(False) if p is None else F.coalesce(p, F.lit(False))


def find_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                  threshold: float = 3.0, id_cols: Sequence[str] = ID_COLS) -> DataFrame:
    """One row per (input row, outlying column): ``outlier_col, value,
    lower, upper`` (bounds rounded to 4 places), the id columns and the
    inspected metric columns.  Strict ``<``/``>``; zero spread skips a column.
    Ordered by ``outlier_col`` asc, ``value`` desc."""
    cols = present(df, cols) if cols is not None else numeric_metric_cols(df)
    ids = present(df, id_cols)
    b = _bounds_scalar(df, cols, method, threshold)
    kind = "array<struct<outlier_col:string,value:double,lower:double,upper:double,_hit:boolean>>"
    hits = F.filter(
        F.array(*[
            F.struct(
                F.lit(c).alias("outlier_col"),
                F.col(c).cast("double").alias("value"),
                round_binary(b.lower(c), 4).alias("lower"),
                round_binary(b.upper(c), 4).alias("upper"),
                _is_out(c, b).alias("_hit"),
            )
            for c in cols
        ]).cast(kind),
        lambda s: s["_hit"],
    )
    any_hit = F.lit(False)  # no column with spread: no rows, the same columns
    for p in (_out_pred(c, b) for c in cols):
        if p is not None:
            any_hit = any_hit | p
    flagged = df.where(any_hit).select(*ids, *[c for c in cols if c not in ids], F.explode(hits).alias("_h"))
    front = ["_h.outlier_col", "_h.value", "_h.lower", "_h.upper"]
    out = flagged.select(*front, *ids, *[c for c in cols if c not in ids])
    return out.orderBy(F.col("outlier_col").asc(), F.col("value").desc())


def exclude_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                     threshold: float = 3.0) -> DataFrame:
    """Rows of ``df`` not outlying in any column (nulls kept).  All bounds
    come from the unfiltered frame."""
    cols = present(df, cols) if cols is not None else numeric_metric_cols(df)
    if not cols:
        return df
    b = _bounds_scalar(df, cols, method, threshold)
    any_hit = F.lit(False)
    for c in cols:
        any_hit = any_hit | _is_out(c, b)
    return df.where(~any_hit)


def exclusion_report(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                     threshold: float = 3.0) -> DataFrame:
    """``n, dropped, pct`` of ``exclude_outliers`` in one pass (pct null on
    empty input instead of a division error)."""
    cols = present(df, cols) if cols is not None else numeric_metric_cols(df)
    b = _bounds_scalar(df, cols, method, threshold)
    any_hit = F.lit(False)
    for c in cols:
        any_hit = any_hit | _is_out(c, b)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_hit).alias("dropped"))
    return agg.select("n", "dropped", F.when(F.col("n") > 0, F.col("dropped") / F.col("n") * 100).alias("pct"))


def outlier_summary(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                    threshold: float = 3.0) -> DataFrame:
    """Per column: outlier count and % of its non-null values, pct desc."""
    cols = present(df, cols) if cols is not None else numeric_metric_cols(df)
    b = _bounds_scalar(df, cols, method, threshold)
    agg = df.agg(*[F.count_if(_is_out(c, b)).alias(f"{c}__n") for c in cols],
                 *[F.count(F.col(c)).alias(f"{c}__nn") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}__n").alias("n_outliers"),
                              F.col(f"{c}__nn").alias("n_non_null")) for c in cols])
    return (
        agg.select(F.explode(rows).alias("_r")).select("_r.*")
        .withColumn("pct", F.when(F.col("n_non_null") > 0, F.col("n_outliers") / F.col("n_non_null") * 100))
        .orderBy(F.col("pct").desc())
    )
