"""Shared pieces of the Spark side: row identity, shard counts, written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shard_count(spark: SparkSession, per_partition: int = 4) -> int:
    """Shards of a hashed key space: a few for each shuffle partition, so that
    a shard stays as small as the session's shuffle partitions are chosen to be."""
    return per_partition * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_id(key: Column, text: Column) -> Column:
    """64-bit identity of a row by its id and text (rows equal in both are one document)."""
    return F.xxhash64(key, text)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the session's shared folder and read it again: cuts the
    lineage, and a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
