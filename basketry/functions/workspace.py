"""Tables written between the steps of a job, with an owner that removes them.

Every table lies in the session's shared checkpoint folder, so the loss of an
executor loses no part of it. ``Workspace`` names its tables by step and removes
them on ``close`` (or at the end of a ``with`` block); those of ``session_workspace``
live until the Python process ends, for results that are still read lazily.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


class Workspace:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketry-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        """``df`` written as a Parquet table and read back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        self.remove(self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that nothing refers to any more: its cleaner
    does so once the driver's garbage, their plans, is collected. Called after a step's table
    is written, so that its shuffle doesn't lie on disk beside those of the next steps."""
    for _ in range(2):  # the first collection only parts the plans from what still names them
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(2)


_OPEN: dict[str, Workspace] = {}


_ACTIVE: list[Workspace] = []


@contextlib.contextmanager
def working_in(work: Workspace):
    """Within the block ``current_workspace`` is ``work``."""
    _ACTIVE.append(work)
    try:
        yield work
    finally:
        _ACTIVE.pop()


def current_workspace(spark: SparkSession) -> Workspace:
    return _ACTIVE[-1] if _ACTIVE else session_workspace(spark)


def session_workspace(spark: SparkSession) -> Workspace:
    """The workspace of the session, removed when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _OPEN:
        _OPEN[app] = Workspace(spark)
    return _OPEN[app]


@atexit.register
def _close_all() -> None:
    for w in _OPEN.values():
        with contextlib.suppress(Exception):  # the session may have ended before
            w.close()
