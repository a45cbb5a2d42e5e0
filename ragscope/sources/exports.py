"""Metric export with a commit record.

An export run takes three steps:

1. *stage*: Spark writes the rows below ``exports.staging/<run>``, a few files a session;
2. *commit*: a table of what was staged (session, file, rows, run, time) is written
   beside the record and renamed into ``exports.log/<run>`` - the one step that makes
   the run count;
3. *publish*: the committed files move to ``<date>_langfuse_export_<session>_<run>-<n>.parquet``
   in the folder itself.

A run that dies before its commit shows nothing, and its sessions are exported again by
the next one; a run that dies after it counts, its files are read where they are and
moved by the next run.  Names carry the run, so runs at the same time never overwrite
each other; of several exports of a session the one committed last is read.  Rows with a
null session are not exported; an empty export is a run without files.

Rows only pass through Spark jobs.  The driver moves files and lists the record's
entries, one per file, as it lists any folder.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.sources.fs import drop_folder, list_files, make_folder, move, path_exists

PART_COL = "_session"
SESSION_FILES = 4  # files that one session's rows go to, so that a session with most rows has several tasks
LOG, STAGING = "exports.log", "exports.staging"
RECORD = "session string, file string, staged string, rows long, run string, committed_us long"


def _hashable(df: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def record(spark: SparkSession, path: str) -> DataFrame:
    """Every file of every committed run."""
    runs = list_files(spark, f"{path}/{LOG}", "*")
    return spark.read.schema(RECORD).json(runs) if runs else spark.createDataFrame([], RECORD)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The record with ``live``: whether the file belongs to the last export of its session."""
    entries = record(spark, path)
    newest = entries.groupBy("session").agg(F.max_by("run", F.struct("committed_us", "run")).alias("_newest"))
    return entries.join(newest, "session").withColumn("live", F.col("run") == F.col("_newest")).drop("_newest")


def exported_sessions(spark: SparkSession, path: str, session_col: str = "session_id") -> DataFrame:
    """Distinct session ids of the committed runs."""
    return record(spark, path).select(F.col("session").alias(session_col)).distinct()


def _stage(todo: DataFrame, folder: str, session_col: str) -> None:
    # partitioned on a copy, so every file still carries its session column
    salt = F.pmod(F.xxhash64(*_hashable(todo)), F.lit(SESSION_FILES))
    todo.withColumn(PART_COL, F.col(session_col)).repartition(F.col(PART_COL), salt).write.partitionBy(PART_COL).parquet(folder)


def _commit(spark: SparkSession, path: str, run: str, schema: T.StructType, session_col: str) -> None:
    now = datetime.datetime.now(datetime.UTC)
    staged = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{STAGING}/{run}")
    file_path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # Spark gives it as a URI
    files = staged.groupBy(F.col(session_col).cast("string").alias("session"), file_path.alias("staged")).agg(
        F.count(F.lit(1)).alias("rows"))
    number = F.row_number().over(Window.partitionBy("session").orderBy("staged"))  # SESSION_FILES at the most
    folder_name = F.regexp_extract("staged", f"{PART_COL}=([^/]*)/[^/]*$", 1)
    name = F.concat(F.lit(f"{now:%Y-%m-%d_%H-%M}_langfuse_export_"), folder_name, F.lit(f"_{run}-"), number.cast("string"), F.lit(".parquet"))
    draft = f"{path}/{STAGING}/{run}.record"
    files.select("session", name.alias("file"), "staged", "rows", F.lit(run).alias("run"),
                 F.lit(int(now.timestamp() * 1e6)).cast("long").alias("committed_us")).write.json(draft)
    make_folder(spark, f"{path}/{LOG}")
    if not move(spark, draft, f"{path}/{LOG}/{run}"):
        raise OSError(f"the record of run {run} could not be committed")


def _publish(spark: SparkSession, path: str) -> None:
    """Move the files of committed runs out of staging, also those of runs that died before it."""
    for folder in list_files(spark, f"{path}/{STAGING}", "*"):
        run = folder.rsplit("/", 1)[1]
        if path_exists(spark, f"{path}/{LOG}/{run}"):
            for entry in spark.read.schema(RECORD).json(f"{path}/{LOG}/{run}").toLocalIterator():
                # another run may be moving the same files
                if not move(spark, entry.staged, f"{path}/{entry.file}") and not path_exists(spark, f"{path}/{entry.file}"):
                    raise OSError(f"{entry.staged} could not be moved to {path}/{entry.file}")
            drop_folder(spark, folder)


def export_metrics(wide: DataFrame, path: str, session_col: str = "session_id", skip_existing: bool = False) -> DataFrame:
    """Export the rows by session, see above; ``skip_existing`` leaves out sessions of committed runs.
    Returns the distinct sessions written."""
    spark, path, run = wide.sparkSession, path.rstrip("/"), uuid.uuid4().hex[:12]
    todo = wide.where(F.col(session_col).isNotNull())
    if skip_existing:
        todo = todo.join(exported_sessions(spark, path, session_col), session_col, "left_anti")
    _stage(todo, f"{path}/{STAGING}/{run}", session_col)
    _commit(spark, path, run, todo.schema, session_col)
    _publish(spark, path)
    return record(spark, path).where(F.col("run") == run).select(F.col("session").alias(session_col)).distinct()
