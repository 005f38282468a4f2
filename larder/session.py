"""Spark session helpers.

Reports never create or configure a session themselves: they take the
caller's ``SparkSession``.  This module only offers a builder for tests and
the benchmark, plus a helper that resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings the reports are designed around.  AQE re-plans joins
# from real shuffle sizes (small sides become broadcasts, skewed partitions
# get split) and coalesces the many small post-filter partitions.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


# Settings intended for the target cluster (about 100 TB of facts, ~1000
# executors).  AQE only *merges* small shuffle partitions (and splits skewed
# join partitions), so the initial partition count is set high and the
# advisory size decides the final task size; scans are split at 512 MB.
CLUSTER_CONF = {
    **SQL_CONF,
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "larder", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark (UI off, event log off)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LARDER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # A report is built by thousands of column calls; PySpark would capture the
        # Python call site of each one for error messages (a third of the building time).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    conf = {**SQL_CONF, **(extra or {})}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch folder where none is set and
    the whole session runs in one process on this machine (tests)."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known and sc.master.split("[")[0] == "local":
        known = tempfile.mkdtemp(prefix="larder-shared-")
        sc.setCheckpointDir(known)
    return known or ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a shared (HDFS / object store) folder and
    is used as is.  Where it is unset this raises: a local folder would keep
    each executor's part on its own disk.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    sc.setCheckpointDir(configured)
    return configured
