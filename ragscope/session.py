"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder every job that cuts lineage writes to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every operator relies on.  They are safe to apply to
# a session someone else built (the cluster driver): AQE re-plans joins and
# partition counts from real shuffle sizes, and converts a join to a
# broadcast only when the measured side is under the threshold.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "ragscope") -> SparkSession:
    """Session for tests and the bench script (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("RAGSCOPE_MASTER", "local[8]"))
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # noqa: BLE001 - some confs are static on a shared session
            pass


_OWN: dict = {}  # folders of local sessions that name none


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is only read here; without
    it there is no folder that all executors see, so that is an error.  Only a
    session inside one process (``local[...]``) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        if spark not in _OWN:
            _OWN[spark] = tempfile.mkdtemp(prefix="ragscope-ckpt-")
        path = _OWN[spark]
    jsc = spark.sparkContext._jsc  # noqa: SLF001
    if jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _session_scratch(spark: SparkSession) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/ragscope/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder for written intermediates, under this application's
    own folder inside the checkpoint folder."""
    return f"{_session_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediates (only its own sub-folder).
    Call once the DataFrames that read them are no longer needed."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path(_session_scratch(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if fs.exists(path):
        fs.delete(path, True)
