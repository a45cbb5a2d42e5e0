"""Structured Streaming operators for live evaluation records.

* ``running_summary`` - a streaming grouped aggregate (update mode); the sink
  is an idempotent upsert log: each micro-batch's changed keys are written to
  ``<out>/_batch=<id>`` (overwrite, so a retried batch rewrites the same
  folder) and ``latest`` reads the last row per key.  This is the
  exactly-once pattern without a table format.
* ``assemble_traces`` - spans of one trace arrive separately; a JVM
  session-window aggregate per trace (``groupBy(trace_id,
  session_window(event_time, gap))``, append mode) emits each trace once its
  session closes under the watermark, flagged complete when all span names
  were seen.  State is evicted by the watermark, so it stays bounded.
* ``assemble_traces_custom`` - the same with per-trace Python state
  (``applyInPandasWithState``, event-time timeout) for rules a built-in
  aggregate cannot state; it pays one Python call per trace.
* ``dedup_spans`` - idempotent re-delivery: one span per (trace, name)
  within the watermark (``dropDuplicatesWithinWatermark``).
* ``stage_files`` / ``read_stream`` - replay a table as time-ordered files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragscope.operators.spans import GENERATION, RETRIEVAL, ROOT, SPAN_BYTES, packed_id, unpacked_id

SPAN_NAMES = (ROOT, RETRIEVAL, GENERATION)


def stage_files(df: DataFrame, path: str, order_col: str, files: int = 4, copies: int = 1, parts: int = 1) -> str:
    """Write ``df`` as ``files`` deliveries, each a contiguous ``order_col`` range (numbers or times), one after the
    other: a file source takes them in the order in which they were written, like an arriving log.
    With ``copies`` a delivery lands that many times before the next.

    A delivery is one file, sorted, or with ``parts`` up to that many written side by side; all deliveries have
    the same number of files (:func:`delivery_files`), if need be empty ones.  The ranges come from a quantile
    sketch and each is filtered from ``df``, which must give the same rows every time: no row is shuffled."""
    spark = df.sparkSession
    bounds = df.select(F.percentile_approx(order_col, [i / files for i in range(1, files)], F.lit(10_000))).first()[0] if files > 1 else None
    at = [F.lit(b).cast(df.schema[order_col].dataType) for b in sorted(bounds or [])]
    n_files = None
    for i in range(files):
        here = F.lit(True)
        if at:
            after = F.col(order_col) >= at[i - 1] if i else F.lit(True)
            here = after & (F.col(order_col) < at[i]) if i < len(at) else after
        if not i:
            here = here | F.col(order_col).isNull()
        own = df.where(here if at or not i else F.lit(False))
        for n in range(copies):
            to = f"{path}/{i:03d}" + f"-{n}" * (copies > 1)
            own = own.coalesce(n_files or parts)
            (own.sortWithinPartitions(order_col) if parts == 1 and not n else own).write.parquet(to, compression="zstd")
            made = delivery_files(spark, to, df.schema)
            n_files = n_files or made
            for _ in range(n_files - made):
                spark.createDataFrame([], df.schema).write.mode("append").parquet(to)
            own = spark.read.schema(df.schema).parquet(f"{path}/{i:03d}-0") if copies > 1 else own
    return path


def delivery_files(spark: SparkSession, delivery: str, schema) -> int:
    """How many files a delivery has; a micro-batch that takes as many takes a delivery."""
    return len(spark.read.schema(schema).parquet(delivery).inputFiles())


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream of the files; with ``max_files`` a micro-batch takes that many at most."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def batches(checkpoint: str, spark: SparkSession) -> int:
    """How many micro-batches a query has committed."""
    return spark.read.text(f"{checkpoint}/commits").select(F.input_file_name().alias("f")).distinct().count()


def running_summary(stream: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return stream.groupBy(*keys).agg(*aggs)


def run_upsert(agg_stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run an update-mode aggregate to completion over the available input
    (``availableNow``) into the upsert log at ``out``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    q = (agg_stream.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()  # ends by itself when all available input is read; raises what the query raised


def latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Last written row per key of an upsert log."""
    log = spark.read.parquet(out)
    vals = [c for c in log.columns if c not in (*keys, "_batch")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("_v"))
    return last.select(*keys, "_v.*")


def run_append(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run an append query over the available input; its state and, as Parquet, its output are written with zstd."""
    writer = stream.writeStream.outputMode("append").format(fmt).option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.option("compression", "zstd") if fmt == "parquet" else writer
    with configured(stream.sparkSession, STATE):
        q = writer.trigger(availableNow=True).start()  # takes the session's settings along
    q.awaitTermination()  # ends by itself when all available input is read; raises what the query raised


#: Settings of the state of append queries.
STATE = {"spark.sql.streaming.stateStore.compression.codec": "zstd"}


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with ``settings``, which are taken back at the end."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_event_time(spans: DataFrame, col: str = "end_time_unix_nano", name: str = "event_time") -> DataFrame:
    return spans.withColumn(name, F.timestamp_micros(F.floor(F.col(col) / 1000).cast("long")))


def dedup_spans(spans: DataFrame, watermark: str = "10 minutes", event_time: str = "event_time") -> DataFrame:
    """One span of each (trace, name); the trace ids are packed in the shuffle and the state."""
    kept = spans.withColumn("trace_id", packed_id(F.col("trace_id"))).withWatermark(event_time, watermark)
    return kept.dropDuplicatesWithinWatermark(["trace_id", "name"]).withColumn("trace_id", unpacked_id(F.col("trace_id")))


_OUT = "trace_id string, n_spans int, complete boolean, names string"
_STATE = "names array<string>, done boolean"


def _assembler(expected: Sequence[str], timeout_ms: int):
    need = set(expected)

    def row(trace_id, seen, complete):
        return pd.DataFrame({"trace_id": [trace_id], "n_spans": [len(seen)], "complete": [complete], "names": [",".join(sorted(seen))]})

    def fn(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, done = state.get if state.exists else ([], False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(key[0], set(names), False)
            return
        seen = set(names)
        for pdf in frames:
            seen.update(pdf["name"].tolist())
        if need <= seen and not done:
            yield row(key[0], seen, True)
        # a complete trace is remembered until the timeout, so late copies of its spans open no new one
        state.update((sorted(seen), bool(done or need <= seen)))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + timeout_ms)

    return fn


def assemble_traces(spans: DataFrame, watermark: str = "10 minutes", gap: str = "5 minutes",
                    expected: Sequence[str] = SPAN_NAMES, event_time: str = "event_time") -> DataFrame:
    """``trace_id, n_spans, complete, names`` per trace session; ids are packed in the shuffle and the state."""
    need = F.array(*[F.lit(n) for n in sorted(expected)])
    span = packed_id(F.col("span_id"), SPAN_BYTES) if "span_id" in spans.columns else F.col("name")
    agg = (spans.withWatermark(event_time, watermark).select(packed_id(F.col("trace_id")).alias("_trace"), span.alias("_span"), "name", event_time)
           .groupBy("_trace", F.session_window(event_time, gap))
           .agg(F.size(F.collect_set("_span")).alias("n_spans"), F.array_sort(F.collect_set("name")).alias("_names")))  # a span delivered twice counts once
    return agg.select(unpacked_id(F.col("_trace")).alias("trace_id"), "n_spans",
                      (F.size(F.array_intersect("_names", need)) == F.size(need)).alias("complete"),
                      F.array_join("_names", ",").alias("names"))


def assemble_traces_custom(spans: DataFrame, watermark: str = "10 minutes", timeout_ms: int = 600_000,
                           expected: Sequence[str] = SPAN_NAMES, event_time: str = "event_time") -> DataFrame:
    """One output row per trace: complete when all expected span names were
    seen, or incomplete when no span arrived within the timeout (event time)."""
    return (spans.withWatermark(event_time, watermark).select("trace_id", "name", event_time)
            .groupBy("trace_id")
            .applyInPandasWithState(_assembler(expected, timeout_ms), _OUT, _STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def route_by_type(stream: DataFrame, type_col: str, payload_col: str | None = None,
                  payload_schema: str | None = None) -> DataFrame:
    """Typed parse of event records: the JSON payload parsed with a fixed
    schema (no inference on a stream) next to the routing column."""
    if payload_col and payload_schema:
        stream = stream.withColumn("payload", F.from_json(F.col(payload_col), payload_schema))
    return stream.where(F.col(type_col).isNotNull())


def run_routed(stream: DataFrame, type_col: str, out: str, checkpoint: str) -> None:
    """Append each micro-batch into one folder per event type (idempotent per
    batch id: a retried batch overwrites its own sub-folder)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(type_col).parquet(f"{out}/_batch={batch_id}")

    q = (stream.writeStream.outputMode("append").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()  # ends by itself when all available input is read; raises what the query raised
