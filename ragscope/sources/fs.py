"""Listing and existence of paths on whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p  # noqa: SLF001


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    fs, p = jvm_fs(spark, folder.rstrip("/") + "/" + pattern)
    st = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in (st or []))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = jvm_fs(spark, path)
    return bool(fs.exists(p))


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder; false if the source is gone."""
    fs, p = jvm_fs(spark, source)
    return bool(fs.exists(p) and fs.rename(p, jvm_fs(spark, target)[1]))


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = jvm_fs(spark, path)
    fs.mkdirs(p)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = jvm_fs(spark, path)
    fs.delete(p, True)
