"""One-row aggregates attached to every row as scalar subqueries.

A global aggregate (a maximum date, class totals, quantile edges, scaler
statistics) is needed by every row of a larger table. Spark evaluates a scalar
subquery once and inlines its value, so no join (and no cross product) is
planned; identical subqueries are computed once and reused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_struct(one_row: DataFrame) -> Column:
    """The single row of ``one_row`` (a global aggregate) as a struct-valued scalar."""
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with every column of the one-row aggregate ``one_row`` added.

    The struct is attached once and its fields read from that column, so the
    plan holds a single subquery however many fields are used.
    """
    tmp = "_scalar_row"
    attached = df.select("*", scalar_struct(one_row).alias(tmp))
    return attached.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(tmp).getField(c).alias(c) for c in one_row.columns])
