"""The life cycle of evaluation runs on a record stream.

A run sends ``run_start`` (with the number of entries), one ``entry_result`` or
``entry_error`` an entry, and ``run_complete`` or ``stopped`` at its end.  Each run gives
one summary when it ends: a partial one when it was stopped, and one of status
``silent`` when no record came for ``silence`` of event time (a timer).

State of a run (``transformWithState``): counts and sums as one value, the failed
entries as a list, one timer.  Rows are folded column-wise, so a run with many records
in a batch costs no call a record.  After its end a run keeps a mark until the
timer, so records that arrive again open no new run; then its state goes.

Records without a run id or time are left out.  The averages are over results with a
recall, 0.0 if there are none; records in any order within the watermark count the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECORD = ("run_id string, at timestamp, type string, entry_id string, total_entries long, recall double, precision double, "
          "mrr double, abstention boolean")
SUMMARY = ("run_id string, status string, total_entries long, completed long, errors long, avg_recall double, avg_precision double, "
           "avg_mrr double, abstentions long, failed string")
_STATE = "total long, completed long, errors long, scored long, recall double, precision double, mrr double, abstentions long, done boolean, timer long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class RunLife(StatefulProcessor):
    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _STATE)
        self.failed = handle.getListState("failed", "entry_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.run.get() if self.run.exists() else (None, 0, 0, 0, 0.0, 0.0, 0.0, 0, False, 0)
        total, completed, errors, scored, recall, precision, mrr, abstentions, done, timer = state
        ended, last = None, timer - self.silence_ms
        for pdf in rows:
            last = max(last, int(pdf["at"].max().timestamp() * 1000))
            if done:
                continue
            results, bad = pdf[pdf["type"] == "entry_result"], pdf[pdf["type"] == "entry_error"]
            starts, ends = pdf.loc[pdf["type"] == "run_start", "total_entries"].dropna(), set(pdf["type"]) & {"run_complete", "stopped"}
            total = int(starts.max()) if len(starts) else total
            with_recall = results[results["recall"].notna()]
            completed, errors, scored = completed + len(results), errors + len(bad), scored + len(with_recall)
            recall, precision, mrr = recall + float(with_recall["recall"].sum()), precision + float(with_recall["precision"].sum()), mrr + float(with_recall["mrr"].sum())
            abstentions += int(results["abstention"].fillna(False).astype(bool).sum())
            if len(bad):
                self.failed.appendList([(e,) for e in bad["entry_id"].tolist()])
            if ends:
                ended = "stopped" if "stopped" in ends else "complete"
        if last + self.silence_ms != timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = last + self.silence_ms
            self.handle.registerTimer(timer)
        self.run.update((total, completed, errors, scored, recall, precision, mrr, abstentions, done or ended is not None, timer))
        if ended:
            yield self._summary(key[0], ended)
            self.failed.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            if not self.run.get()[8]:
                yield self._summary(key[0], "silent")
            self.run.clear()
            self.failed.clear()

    def _summary(self, run_id: str, status: str) -> pd.DataFrame:
        total, completed, errors, scored, recall, precision, mrr, abstentions, _, _ = self.run.get()
        failed = sorted(str(e[0]) for e in self.failed.get()) if errors else []
        mean = lambda x: x / scored if scored else 0.0
        return pd.DataFrame({"run_id": [run_id], "status": [status], "total_entries": pd.array([total], dtype="Int64"), "completed": [completed], "errors": [errors],
                             "avg_recall": [mean(recall)], "avg_precision": [mean(precision)], "avg_mrr": [mean(mrr)], "abstentions": [abstentions],
                             "failed": [",".join(failed)]})

    def close(self) -> None:
        pass


def run_summaries(records: DataFrame, silence: timedelta = timedelta(minutes=30), watermark: str = "10 minutes") -> DataFrame:
    """One row of ``SUMMARY`` for each run of a stream of ``RECORD`` rows, when the run ends."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    return (records.where("run_id IS NOT NULL AND at IS NOT NULL").select(*names).withWatermark("at", watermark).groupBy("run_id")
            .transformWithStateInPandas(RunLife(int(silence.total_seconds() * 1000)), SUMMARY, "Append", "EventTime"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stateful append query over the available input, its state in RocksDB."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
