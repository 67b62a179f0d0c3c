"""Order of a table by its key in buckets (built-in functions only)."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_buckets(df: DataFrame, key: str, name: str, rows: int = 2000) -> DataFrame:
    """``df`` with ``name``: an int that never falls as ``key`` (a number) rises; null keys
    are last. About ``rows`` rows share a bucket, more if that would make over four buckets
    for each shuffle partition. The edges are approximate quantiles, so the buckets stay
    even however the keys are spread."""
    spark = df.sparkSession
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = df.select(F.col(key).cast("double").alias("x"))
    buckets = max(1, min(most, math.ceil(x.count() / rows)))
    probabilities = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(x.approxQuantile("x", probabilities, 0.2 / buckets))) if probabilities else []
    cast = df.withColumn("_x", F.col(key).cast("double"))
    cut = Bucketizer(
        splits=[-math.inf, *(edges or [0.0]), math.inf], inputCol="_x", outputCol=name, handleInvalid="keep"
    ).transform(cast)
    # a null key has no bucket of its own yet
    return cut.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(len(edges or [0.0]) + 1))).drop("_x")


def with_next(
    df: DataFrame, key: str, order: list[str], value: str, name: str, derive: dict[str, Column] | None = None
) -> DataFrame:
    """``df`` with ``name``: ``value`` of the next row by ``key`` and then ``order`` (after the
    last: of the first). One shuffle by bucket; the first rows of the buckets fill the ends.

    ``derive``: columns computed once from each row after the shuffle. ``next_<column>`` is
    that of the next row of the same bucket, null in a bucket's last row."""
    rows = key_buckets(df, key, "_bucket")
    by = [F.asc_nulls_last(key), *[F.asc_nulls_last(c) for c in order]]
    bucket = Window.partitionBy("_bucket").orderBy(*by)
    # a value can be null, so the next row has a mark of its own
    inside = rows.withColumn("_next", F.lead(value).over(bucket)).withColumn("_has", F.lead(F.lit(1)).over(bucket))
    added = []
    for column, expression in (derive or {}).items():
        inside = inside.withColumn(column, expression)
    for column in derive or {}:  # the same order again: no further shuffle or sort
        inside = inside.withColumn(f"next_{column}", F.lead(column).over(bucket))
        added += [column, f"next_{column}"]
    place = F.struct(F.col(key).isNull(), key, *order)
    firsts = rows.groupBy("_bucket").agg(F.min_by(F.struct(F.col(value).alias("v")), place).alias("_first"))
    numbers = rows.groupBy("_bucket").agg(F.count("*"))  # one row for each bucket
    ends = Window.orderBy("_bucket")
    before = numbers.select(
        F.col("_bucket").alias("_mine"),
        F.coalesce(
            F.lead("_bucket").over(ends), F.min("_bucket").over(Window.partitionBy())
        ).alias("_after"),
    )
    follow = before.join(firsts, before["_after"] == firsts["_bucket"]).select("_mine", "_first")
    joined = inside.join(follow, (inside["_bucket"] == follow["_mine"]) & inside["_has"].isNull(), "left")
    found = F.when(F.col("_has").isNotNull(), F.col("_next")).otherwise(F.col("_first")["v"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in (name, *added)], *added, found.alias(name))
