"""Spark session defaults and the checkpoint location.

On a cluster the session is created by the platform; ``get_spark`` only
fills settings that are still unset. The checkpoint directory is read from
``spark.checkpoint.dir``; a private scratch folder is created only when the
setting is missing (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied when the builder creates a new session.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Files are read in 128 MiB splits; at 100 TB this gives ~800k scan tasks.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Shuffles target ~256 MiB per reduce task: AQE coalesces small partitions
    # and splits skewed ones (a partition 5x the median and over 512 MiB).
    # On a cluster, set spark.sql.shuffle.partitions to roughly
    # (largest shuffle bytes / 256 MiB) as the upper bound AQE coalesces from.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    # Date-range reports rely on runtime bloom filters reaching the line scan.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # A join side is broadcast when it is under 32 MiB: by the planner's estimate,
    # or at run time by the size that adaptive execution measured.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Checkpoints that nothing refers to any more are deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # On, every column expression asks the JVM several times more, to name its Python line in errors.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tillkit") -> SparkSession:
    """Return the active session or build one with ``DEFAULT_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    driver_mem = os.environ.get("TILLKIT_DRIVER_MEMORY")
    if driver_mem:
        builder = builder.config("spark.driver.memory", driver_mem)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder; it is never overridden here.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        # Local runs and tests: a fresh scratch folder per session.
        conf_dir = tempfile.mkdtemp(prefix="tillkit-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
