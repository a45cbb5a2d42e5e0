"""Progress of a running stream as a table: completed of total, batch by batch.

A stream observes how many records each micro-batch completes; a
``StreamingQueryListener`` takes what every finished batch reports and adds it to the
progress table, one file a batch, in the shared folder.  The numbers are those Spark committed:
nothing is counted a second time, and the table only grows.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "progress"
SCHEMA = "name string, batch_id long, done long, completed long, total long"


def observed(stream: DataFrame, done=None) -> DataFrame:
    """The stream with its count of completed records observed (``done``: a condition; all without one)."""
    return stream.observe(OBSERVED, F.count(F.lit(1) if done is None else F.when(done, 1)).alias("done"))


class ProgressTable(StreamingQueryListener):
    """Writes the progress of the query of one name to a table; ``on_progress(completed, total)`` is called too."""

    def __init__(self, spark: SparkSession, name: str, total: int, out: str, on_progress=None):
        self.spark, self.name, self.total, self.out, self.on_progress = spark, name, total, out, on_progress
        self.completed, self.seen, self.ended, self.run = 0, set(), threading.Event(), None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(OBSERVED)
        if p.name != self.name or row is None or p.batchId in self.seen:
            return
        self.seen.add(p.batchId)
        self.completed += row["done"]
        self.spark.createDataFrame([(self.name, p.batchId, row["done"], self.completed, self.total)], SCHEMA).coalesce(1).write.mode("append").parquet(self.out)
        if self.on_progress:
            self.on_progress(self.completed, self.total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()


def run_with_progress(stream: DataFrame, name: str, total: int, sink, checkpoint: str, out: str, mode: str = "append", on_progress=None, wait: float = 60.0) -> DataFrame:
    """Run the (observed) stream to its end into ``sink(batch, batch_id)``; returns the progress table."""
    spark = stream.sparkSession
    table = ProgressTable(spark, name, total, out, on_progress)
    spark.streams.addListener(table)
    try:
        stream.writeStream.queryName(name).outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        table.ended.wait(wait)  # events arrive after the query's end, in order
    finally:
        spark.streams.removeListener(table)
    return spark.read.schema(SCHEMA).parquet(out)
