"""SparkSession helpers.

Settings are chosen for a large cluster first: adaptive execution (runtime
coalescing, skew-join splitting, runtime broadcast decisions from measured
shuffle sizes), ANSI mode on, and a shared checkpoint folder read from the
session. Tests and local runs fill in only what the cluster did not set.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Skip capturing Python call sites for every Column built on the driver (error-message
    # context only); plan construction is several times faster without it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskflow") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("RISKFLOW_MASTER", "local[*]"))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("RISKFLOW_DRIVER_MEM", "8g"))
    for k, v in _SCALE_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without one gets a scratch folder; a cluster without one is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    The input is persisted for the duration of the checkpoint so the plan runs
    once (an eager checkpoint otherwise computes it twice: count, then write);
    the returned frame reads the checkpoint files and has a one-step lineage."""
    checkpoint_dir(df.sparkSession)
    df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


# Rows of a task that are worth a core of their own, and most rows of a task.
TASK_ROWS, MOST_TASK_ROWS = 1 << 13, 1 << 18


def spread(df: DataFrame) -> DataFrame:
    """A checkpointed frame that is read many times, over about as many tasks as there are cores.

    A frame keeps the partitions of its last shuffle or of its files: hundreds with few rows each, where every task of a
    forest sends the sums of all nodes, or a single one. Frames of fewer than ``TASK_ROWS`` rows stay as they are."""
    n, now = df.count(), df.rdd.getNumPartitions()
    want = min(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_TASK_ROWS)), -(-n // TASK_ROWS))
    if n < TASK_ROWS or now == want:
        return df
    return cut_lineage(df.coalesce(want) if now > want else df.repartition(want))
