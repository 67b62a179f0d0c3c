"""Bounds on what a Python worker holds at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_MB = 8


def bound_batches(spark: SparkSession, mb: int = BATCH_MB) -> None:
    """Let the session send at most ``mb`` megabytes of rows to a Python worker at a time
    (a longer row goes alone), whatever the length of the texts. A session that has a
    smaller bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(name).rstrip("b"))
    if held <= 0 or held > mb << 20:
        spark.conf.set(name, str(mb << 20))
