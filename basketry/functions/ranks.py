"""Rank statistics from value counts: Mann-Whitney U, tie term, AUC.

Two samples x and y are given as counts per distinct value. With ties counted
one half, ``U = sum_v cx(v) * (sum_{w<v} cy(w) + cy(v) / 2)`` is the number of
(x, y) pairs with x > y; ``U / (n1 * n2)`` is the ROC AUC when x are the
positives' scores. The sums below the value come from ``running_sums``, so the
kernel never sorts raw rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .position import materialize, running_sums


def u_statistic(
    counts: DataFrame,
    value: str,
    cx: str,
    cy: str,
    group_by: Sequence[str] = (),
) -> DataFrame:
    """One row per group: ``n1``, ``n2``, ``u_stat`` and ``tie_term`` = sum(t^3 - t).

    ``counts`` holds one row per (group, value) with the counts of each sample.
    """
    counts = materialize(counts)  # read by the edges, bucket totals and rows of the running sum
    cum = running_sums(counts, [value], {"_cy_le": F.col(cy).cast("bigint")}, partition_by=group_by)
    below = (F.col("_cy_le") - F.col(cy)).cast("double")
    contrib = F.col(cx).cast("double") * (below + F.col(cy).cast("double") / F.lit(2.0))
    t = (F.col(cx) + F.col(cy)).cast("double")
    return cum.groupBy(*group_by).agg(
        F.sum(cx).cast("bigint").alias("n1"),
        F.sum(cy).cast("bigint").alias("n2"),
        F.sum(contrib).alias("u_stat"),
        F.sum(t * t * t - t).alias("tie_term"),
    )


def bounded_u_statistic(counts: DataFrame, value: str, cx: str, cy: str) -> DataFrame:
    """One row: n1, n2, u_stat, tie_term and ``nulls`` (rows without a value), for a value
    with few distinct values (ordinal scores): the window and the aggregate run over one row
    for each of them."""
    below = Window.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x, y = F.col(cx).cast("double"), F.col(cy).cast("double")
    known = F.col(value).isNotNull()
    t = x + y
    rows = counts.withColumn("_below", F.coalesce(F.sum(y).over(below), F.lit(0.0)))
    sums = rows.agg(
        F.sum(F.when(known, F.col(cx))).cast("bigint").alias("n1"),
        F.sum(F.when(known, F.col(cy))).cast("bigint").alias("n2"),
        F.sum(F.when(known, x * (F.col("_below") + y / F.lit(2.0)))).alias("u_stat"),
        F.sum(F.when(known, t * t * t - t)).alias("tie_term"),
        F.coalesce(F.sum(F.when(~known, F.col(cx) + F.col(cy))), F.lit(0)).cast("bigint").alias("nulls"),
    )
    return sums


def normal_z(u, n1, n2, tie_term, continuity: bool = True):
    """Tie-corrected normal approximation of U for the one-sided 'greater' test; NULL if
    all values are equal (the variance is 0)."""
    n1d, n2d = n1.cast("double"), n2.cast("double")
    n = n1d + n2d
    mu = n1d * n2d / F.lit(2.0)
    var = n1d * n2d / F.lit(12.0) * ((n + F.lit(1.0)) - F.try_divide(tie_term, n * (n - F.lit(1.0))))
    num = u - mu - (F.lit(0.5) if continuity else F.lit(0.0))
    return F.try_divide(num, F.sqrt(var))
