"""Portable numeric helpers.

Spark and DuckDB disagree on ``round`` at representational edges
(``round(1.005, 2)`` is 1.01 in Spark, 1.0 in DuckDB) and on the result type of
``100.0 * int / int`` (decimal vs double). Every job therefore rounds with
``round_half_up`` (``floor(|x| * 10^d + 0.5) / 10^d`` with the sign of x, on doubles) and builds
percentages from doubles, so the Spark result and the SQL oracle agree bit for bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """Round a numeric column to ``digits`` decimals, halves away from zero (double result)."""
    scale = float(10**digits)
    x = _col(c).cast("double")
    size = F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.signum(x) * size + F.lit(0.0)  # no negative zero


def safe_div(num, den) -> Column:
    """Division that yields NULL instead of failing when the denominator is 0."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def pct(part, whole) -> Column:
    """``100 * part / whole`` evaluated on doubles in that order; NULL for whole = 0."""
    return F.try_divide(F.lit(100.0) * _col(part).cast("double"), _col(whole).cast("double"))


def as_long(c) -> Column:
    return _col(c).cast("bigint")


def sort_small(df, *cols):
    """Order a small aggregated result (a few categories) in one partition: no
    range-partitioning pass, which a global sort would need. The rows move in an
    exchange of their own, so the aggregation before it keeps its tasks."""
    return df.repartition(1).sortWithinPartitions(*cols)


def erfc(x: Column) -> Column:
    """The complementary error function to about 15 digits, from built-in functions.

    For |x| >= 0.5 the trapezoidal sum of its integral with step 1/2 and its pole term (below 6);
    nearer to zero the power series of erf.
    """
    a = F.abs(x)
    near, power, factor = F.lit(0.0), a, 1.0
    for n in range(14):
        near = near + power * F.lit((-1) ** n / (factor * (2 * n + 1)))
        power, factor = power * a * a, factor * (n + 1)
    near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * near
    terms = F.lit(0.5) / (a * a)
    for n in range(1, 13):
        terms = terms + F.lit(math.exp(-n * n / 4)) / (F.lit(n * n / 4) + a * a)
    pole = F.when(a < 6, F.lit(2.0) / (F.exp(F.lit(4 * math.pi) * a) - F.lit(1.0))).otherwise(0.0)
    far = a * F.exp(-a * a) * terms / F.lit(math.pi) - pole
    value = F.when(a < 0.5, near).otherwise(far)
    return F.when(x < 0, F.lit(2.0) - value).otherwise(value)


def significant(x: Column, digits: int = 9) -> Column:
    """A double rounded to so many significant digits, by its text form; NULL stays NULL."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x).cast("double"))
