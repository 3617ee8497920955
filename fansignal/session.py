"""SparkSession builder used by tests, bench and the driver entry points."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "fansignal") -> SparkSession:
    """Session with UTC time zone and AQE on.

    On a cluster the caller's configuration wins: we only set what is unset.
    """
    master = master or os.environ.get("FANSIGNAL_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FANSIGNAL_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares, from ``spark.checkpoint.dir``.

    Only a local[*] session may run without it: driver and executors are one process
    there, so a scratch folder (one per process) is safe. Elsewhere a missing setting
    is an error, because a machine-local folder would lose data."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if "path" not in _SCRATCH:
        _SCRATCH["path"] = tempfile.mkdtemp(prefix="fansignal-")
    return _SCRATCH["path"]


_SCRATCH: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``DataFrame.checkpoint`` at the shared folder and return it."""
    path = shared_dir(spark)
    spark.sparkContext.setCheckpointDir(path)
    return path
