"""Spark session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session clock (dates are cut in UTC), AQE for runtime
# coalescing and skew-join splitting, dynamic partition overwrite for idempotent re-writes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs an extra shuffle afterwards (the
    # roll-ups after a join group by a superset of the join key, so AQE would otherwise keep
    # a hot campaign in one task to save that shuffle)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Starting point for a large cluster (hundreds of executors, tens of TB per job). Shuffle
# partitions start high and AQE coalesces them to ~256 MB; scans split files at 256 MB;
# broadcast stays behind AQE's runtime size check; streaming state lives in RocksDB so
# millions of dedup keys do not sit on the JVM heap.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "adperf", extra: dict | None = None,
                  driver_memory: str | None = "8g", cluster: bool = False) -> SparkSession:
    """Get or create a session with :data:`BASE_CONF` (plus :data:`CLUSTER_CONF` when
    ``cluster``).

    ``master``, ``shuffle_partitions`` and ``driver_memory`` are only for local runs (in
    local mode the driver JVM is the only executor); on a cluster the launcher sets them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if master and master.startswith("local") and driver_memory:
        conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    # getOrCreate on an existing session ignores static builder options; re-apply the
    # runtime ones so that a session made elsewhere behaves the same.
    for key in ("spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode",
                "spark.sql.adaptive.enabled"):
        spark.conf.set(key, conf[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses ``spark.checkpoint.dir`` as the cluster names it. A scratch folder is made only when
    the master is one local JVM (tests); on any other master an unset folder is an error,
    because executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="adperf-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
