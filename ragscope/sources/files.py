"""File sources and sinks of the evaluation data.

Listing, schema discovery and the few-line metadata file run on the driver;
every row-level read and write is a Spark job.

* ``load_metrics`` - explicit paths plus a sorted glob of a folder,
  concatenated by column name (missing columns null, int/double widened).
  Files with equal schemas are read together in one scan.
  Of a folder with an export record (``sources.exports``) the committed files count,
  each session's last export.
* ``read_corpus`` / ``corpus_count`` / ``iter_batches`` / ``lookup`` -
  corpus access by dataset id.
* ``export_dataset`` - corpus + ground truth + ``metadata.json`` counts, the
  counts taken with ``DataFrame.observe`` during the write (no second pass).
* ``select_sessions`` / ``select_traces`` - glob or comma-list session specs,
  root-span selection by name, session and time range.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ragscope.functions.text import glob_to_regex
from ragscope.operators.corpus import normalize_truth
from ragscope.sources.exports import LOG, current, export_metrics, exported_sessions  # noqa: F401
from ragscope.sources.fs import list_files, path_exists
from ragscope.sources.tables import nan_to_null


def load_metrics(spark: SparkSession, paths: Sequence[str] | None = None, folder: str | None = None,
                 pattern: str = "*langfuse_export*.parquet") -> DataFrame:
    """All metric files of ``paths`` and, after them, of ``folder`` as one frame, by column name."""
    if not (paths or folder):
        raise ValueError("nothing to load: give `paths`, `folder` or both")
    found = list_files(spark, folder, pattern) if folder else []
    groups: dict[str, list[str]] = {}
    if folder and path_exists(spark, f"{folder.rstrip('/')}/{LOG}"):
        # files of export runs: those of the last run of a session, read where they are; a run's files have one schema
        entries = [e for e in current(spark, folder.rstrip("/")).collect() if fnmatch.fnmatch(e.file, pattern)]
        ours = {e.file for e in entries}
        there = {f.rsplit("/", 1)[1]: f for f in found}
        found = [f for name, f in there.items() if name not in ours]
        for e in sorted(entries, key=lambda e: e.file):
            if e.live:
                groups.setdefault(e.run, []).append(there.get(e.file, e.staged))
    if folder and not found and not groups:
        raise FileNotFoundError(f"{folder} holds no file that matches {pattern}")
    # one scan for all files of a schema, however many files there are
    by_schema: dict[str, list[str]] = {}
    for p in [*(paths or []), *found]:
        by_schema.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    for ps in groups.values():
        by_schema.setdefault(spark.read.parquet(ps[0]).schema.json(), []).extend(ps)
    frames = [spark.read.parquet(*ps) for ps in by_schema.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return nan_to_null(out)


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """The last committed export of every session."""
    return load_metrics(spark, folder=path)


def dataset_path(base: str, dataset_id: str, name: str) -> str:
    return f"{base.rstrip('/')}/{dataset_id}/{name}.parquet"


def read_corpus(spark: SparkSession, base: str, dataset_id: str | None = None) -> DataFrame:
    path = dataset_path(base, dataset_id, "corpus") if dataset_id else base
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no corpus at {path}")
    return spark.read.parquet(path)


def read_truth(spark: SparkSession, base: str, dataset_id: str | None = None) -> DataFrame:
    """A written ground truth with its columns and types made uniform; extra columns stay."""
    path = dataset_path(base, dataset_id, "ground_truth") if dataset_id else base
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no ground truth at {path}")
    return normalize_truth(spark.read.parquet(path))


def dataset_ready(spark: SparkSession, base: str, dataset_id: str) -> bool:
    return all(path_exists(spark, dataset_path(base, dataset_id, n)) for n in ("corpus", "ground_truth"))


def corpus_count(df: DataFrame) -> int:
    """Row count; for a plain Parquet scan Spark answers from footers."""
    return df.count()


def iter_batches(df: DataFrame, batch_size: int = 1000) -> Iterator[list]:
    """Driver-side iteration in fixed-size batches, one partition fetched at a
    time (``toLocalIterator``): memory is bounded by the batch/partition."""
    batch: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        batch.append(row)
        if len(batch) >= batch_size:
            yield batch
            batch = []
    if batch:
        yield batch


def lookup(df: DataFrame, ids: DataFrame | Sequence[str], id_col: str = "id") -> DataFrame:
    """Rows whose id is in ``ids``: a literal list becomes an ``IN`` filter
    pushed to the Parquet scan; a DataFrame of ids becomes a semi-join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    return df.where(F.col(id_col).isin(list(ids)))


def export_dataset(corpus: DataFrame, truth: DataFrame, base: str, dataset_id: str,
                   limit: int | None = None, order: Sequence[str] | None = None, about: dict | None = None) -> dict:
    """Write ``corpus.parquet``, ``ground_truth.parquet`` and ``metadata.json``: the id, the
    counts, the time of writing, and what ``about`` says (source, subset, split).
    ``limit`` keeps the first N rows in ``order`` (the columns that hold the source's order)."""
    spark = corpus.sparkSession
    if limit is not None:
        if not order:
            raise ValueError("a limit needs `order`: the columns that hold the source's row order")
        corpus, truth = (df.orderBy(*[c for c in order if c in df.columns]).limit(limit) for df in (corpus, truth))
    oc, ot = Observation("corpus"), Observation("truth")
    corpus.observe(oc, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
        dataset_path(base, dataset_id, "corpus"))
    truth.observe(ot, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
        dataset_path(base, dataset_id, "ground_truth"))
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    meta = {"dataset_id": dataset_id, **{k: (about or {}).get(k) for k in ("source", "subset", "split")}, **(about or {}),
            "corpus_count": int(oc.get["n"]), "ground_truth_count": int(ot.get["n"]), "created_at": now}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{base.rstrip('/')}/{dataset_id}/metadata.json")
    return meta


def read_metadata(spark: SparkSession, base: str, dataset_id: str) -> dict:
    row = spark.read.text(f"{base.rstrip('/')}/{dataset_id}/metadata.json").first()
    return json.loads(row[0])


def session_filter(spec: str, col: str = "session_id"):
    """``*``/``?`` anywhere -> glob (fnmatch rules, ``[...]`` classes inside a
    glob); otherwise a comma list, trimmed, blanks dropped."""
    if "*" in spec or "?" in spec:
        return F.col(col).rlike(glob_to_regex(spec))
    ids = [s.strip() for s in spec.split(",") if s.strip()]
    return F.col(col).isin(ids)


def select_sessions(sessions: DataFrame, spec: str, col: str = "session_id") -> DataFrame:
    """Distinct matching session ids, sorted."""
    return sessions.select(col).where(F.col(col).isNotNull()).distinct().where(session_filter(spec, col)).orderBy(col)


def select_runs(configs: DataFrame, run_id: str | None, col: str = "run_id") -> DataFrame:
    """The run configurations with that id (all without one); an id that none has is an error."""
    if run_id is None:
        return configs
    own = configs.where(F.col(col) == run_id)
    if own.isEmpty():
        raise ValueError(f"no run configuration has {col}={run_id}")
    return own


def select_traces(spans: DataFrame, traces: DataFrame | None = None, name: str = "rag.evaluation",
                  start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Root spans by name and time range (pushed-down filters), optionally
    restricted to the ``trace_id``s of ``traces`` (e.g. the traces of the
    selected sessions) by a semi-join."""
    out = spans.where(F.col("name") == name)
    if start_ns is not None:
        out = out.where(F.col("start_time_unix_nano") >= start_ns)
    if end_ns is not None:
        out = out.where(F.col("start_time_unix_nano") <= end_ns)
    if traces is not None:
        out = out.join(traces.select("trace_id"), "trace_id", "left_semi")
    return out
