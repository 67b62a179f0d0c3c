"""Results kept for a session until the files they come from change.

A result is kept by a name and by a stamp of its inputs: path, length and time of
modification of every file under them. A data set that was rewritten, grew or lost a file
has another stamp, so the result is made anew; the one kept for the old stamp is dropped.
The stamp reads the file system's listing only, as the reader of a table does anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import SparkSession

Stamp = tuple[tuple[str, int, int], ...]


def stamp(spark: SparkSession, paths: Iterable[str]) -> Stamp:
    """(path, length, time of modification) of every file at or under ``paths``, in order."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(conf)
        if not system.exists(target):
            found.append((path, -1, -1))
            continue
        files = system.listFiles(target, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class Memo:
    """At most one result for each (session, name)."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, Any], tuple[Stamp, Any]] = {}

    def get(self, spark: SparkSession, name: Any, paths: Iterable[str], make: Callable[[], Any]) -> Any:
        """The result kept under ``name`` if the files under ``paths`` are the same, else that of ``make``."""
        key = (spark.sparkContext.applicationId, name)
        now = stamp(spark, paths)
        held = self._held.get(key)
        if held is None or held[0] != now:
            self._held.pop(key, None)
            self._held[key] = held = (now, make())
        return held[1]

    def clear(self) -> None:
        self._held.clear()
