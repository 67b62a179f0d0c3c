"""Session defaults for running the jobs (tests, benchmark, local use)."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, app: str = "basketry") -> SparkSession:
    """A session with the settings the jobs assume (UTC, AQE with skew-join splitting).

    On a local master ``spark.sql.shuffle.partitions`` defaults to 8. On a cluster it is
    left as configured: set it to the data (AQE merges small partitions but never makes
    more than that), likewise ``spark.sql.files.maxPartitionBytes``, and name a shared
    ``spark.checkpoint.dir``."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master.startswith("local"):
        builder = builder.config("spark.driver.memory", "8g")
        shuffle_partitions = shuffle_partitions or 8
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; that setting is used as is.
    Only when it is unset (local runs, tests) a fresh temporary folder is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    target = configured or tempfile.mkdtemp(prefix="basketry-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target
