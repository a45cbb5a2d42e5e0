"""Order-dependent helpers without single-task windows.

pandas' positional semantics (first-N, cumcount, per-session sequence
numbers) need a rank in a total order.  ``row_number() over (partition by
g order by ...)`` puts a whole group in one task, and without ``partition
by`` the whole table.  ``group_rank`` lays the rows out in value order in a
written table instead: range-partitioned on keys and order, each row with the
number of its partition and its place there.  Both readers of that table - the
counts per (partition, group) and the rows themselves - see the same numbers,
whatever the optimiser does with either of them, and a lost executor re-reads
files.  A group holding a third of all rows is spread over as many tasks as its
rows need; a hash of the row breaks ties, so equal order values spread too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.session import scratch_path

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of column pairs in which null equals null."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def group_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "_rank") -> DataFrame:
    """Add ``name``: 0-based rank of each row inside its ``keys`` group,
    following ``order`` (pass a total order for deterministic output)."""
    keys = list(keys)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    # order expressions are computed first: a range partitioner takes columns
    named = [F.col(o) if isinstance(o, str) else o for o in order]
    cols = [*[F.col(f"`{k}`") for k in keys], *named, tie]
    laid = written(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
        .withColumn("_li", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_mid"),
        "ranked",
    )
    seg = laid.groupBy("_pid", *keys).agg(F.min("_li").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per (partition, group): small next to the data
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    seg = seg.select(F.col("_pid").alias("_spid"), *[F.col(k).alias(f"_s_{i}") for i, k in enumerate(keys)], "_first",
                     F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = laid.join(seg, null_safe(laid, seg, [("_pid", "_spid"), *[(k, f"_s_{i}") for i, k in enumerate(keys)]]))
    return out.withColumn(name, F.col("_off") + F.col("_li") - F.col("_first")).select(*[F.col(f"`{c}`") for c in df.columns], name)


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "_ord") -> DataFrame:
    """Add a 0-based global rank ``name`` following ``order``."""
    return group_rank(df, [], order, name)
