"""Spark session helpers.

The library never owns the session in production: every operator takes a
DataFrame (or a session handed in by the caller).  These helpers exist for
tests, the bench and the driver entry point.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale; local runs override the partition count.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what Spark has measured to be small; sort-merge beyond.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Let AQE size reducers from the data: start wide, coalesce to ~64 MB.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "tillpoint") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("TILLPOINT_DRIVER_MEM", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, sub: str = "") -> str:
    """A folder every executor can see: the cluster's ``spark.checkpoint.dir``.

    The library never picks a folder itself: one on the driver's disk would
    be lost on other machines.  Sessions without the setting (tests, the
    bench, the entry point) set a checkpoint folder first.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base.rstrip("/")
    if sub:
        return f"{base}/tillpoint/{sub}-{uuid.uuid4().hex[:12]}"
    return base


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable: reuse the configured folder."""
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = shared_dir(spark)
        spark.sparkContext.setCheckpointDir(d)
    return d
