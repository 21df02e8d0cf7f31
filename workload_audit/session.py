"""Spark session settings for local runs and the checkpoint location."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Where a local session (tests, bench) that names no folder keeps checkpoints.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

# Settings every audit plan relies on. On a cluster these belong in the
# job's spark-defaults; ``local_session`` applies them for tests and bench.
AUDIT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.ansi.enabled": "true",
}


# Starting points for a large cluster (~1000 executors, ~100 TB of logs).
# Scans: 512 MB splits keep the task count near 200k for 100 TB. Shuffles:
# every check aggregates map-side before its first shuffle, so shuffle
# volume is a small fraction of the scan; a high partition count plus AQE
# coalescing toward 256 MB tasks keeps partitions spill-free, and AQE splits
# any skewed join partition. Broadcasts Spark picks on its own stay under
# 64 MB; the explicit ones in the code have fixed bounds (top_n keys, one
# threshold row, the recommendation table). Checkpoints written by report
# queries are removed when no longer referenced.
CLUSTER_CONF = {
    **AUDIT_CONF,
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict[str, str] | None = None) -> None:
    """Set the SQL settings of CLUSTER_CONF that the session does not set
    already (an explicit job setting always wins)."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        if not k.startswith("spark.sql."):
            continue  # core settings belong to spark-submit
        if spark.conf.get(k, None) in (None, "") or (overrides and k in overrides):
            spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "workload-audit") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("AUDIT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in AUDIT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or else the one
    the session's context was given. Without either this is an error: a folder
    of the driver's own would not be seen by the executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
