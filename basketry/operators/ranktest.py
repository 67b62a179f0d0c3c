"""One-sided Mann-Whitney U test of review scores, on time against late.

The samples are reduced to counts per (group, score) by one distributed
aggregation; U, the tie term, z and the number of missing scores come from those
counts (see ``functions.ranks``), and the p-value from built-in functions.

The p-value comes from the normal approximation with continuity and tie correction, or,
with ``method="auto"``, from the exact distribution of U (``functions.exactranks``) if
either group has at most eight values and there are no ties. That choice reads the one row
of sizes and U when the job is built; the default, ``"asymptotic"``, stays a lazy plan. If
all values are equal, z is NULL and the p-value is 1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exactranks import exact_applies, exact_tail
from ..functions.numeric import as_long, erfc, round_half_up, safe_div, significant
from ..functions.ranks import bounded_u_statistic, normal_z, u_statistic
from ..functions.position import materialize
from ..sources import Views
from .delivery import LATE, ON_TIME, delivery_facts, delivery_status
from ..functions.scalars import with_scalars

# Fixed values: |r| thresholds of the effect-size labels.
EFFECT_LABELS = ((0.5, "large"), (0.3, "medium"), (0.1, "small"))


def _effect_label(r):
    a = F.abs(r)
    expr = None
    for bound, label in EFFECT_LABELS:
        expr = F.when(a >= bound, label) if expr is None else expr.when(a >= bound, label)
    return expr.otherwise("negligible")


def mann_whitney_from_values(
    values: DataFrame,
    group: str,
    value: str,
    x_group,
    y_group,
    with_p_value: bool = False,
    bounded_domain: bool = False,
    method: str = "asymptotic",
) -> DataFrame:
    """U test of ``value`` for rows with ``group == x_group`` (x) against ``y_group`` (y).

    One row: n1, n2, u_stat, z_score, effect_size (rank-biserial 2U/(n1 n2) - 1,
    positive when x ranks higher), effect_label, null_values_dropped, and with
    ``with_p_value`` the one-sided p-value P(Z >= z) from the unrounded z, to nine
    significant digits. ``bounded_domain`` declares that ``value`` takes few distinct
    values (ordinal scores), so that everything comes from one small table of counts.
    ``method`` is "asymptotic", or "auto" for the exact p-value of small untied samples.
    """
    if method not in ("asymptotic", "auto"):
        raise ValueError("method must be 'asymptotic' or 'auto'")
    in_test = F.col(group).isin([x_group, y_group])
    rows = values.where(in_test)
    counts = rows.groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col(group) == x_group).alias("cx"), F.count_if(F.col(group) == y_group).alias("cy")
    )
    if bounded_domain:
        u = bounded_u_statistic(counts, "v", "cx", "cy")
    else:
        counts = materialize(counts)
        missing = counts.agg(F.sum(F.when(F.col("v").isNull(), F.col("cx") + F.col("cy"))).alias("nulls"))
        u = with_scalars(u_statistic(counts.where("v IS NOT NULL"), "v", "cx", "cy"), missing)
    exact = None
    if with_p_value and method == "auto":
        u = materialize(u)  # one row, read here and by the result
        r0 = u.first()
        if r0["n1"] and r0["n2"] and exact_applies(r0["n1"], r0["n2"], r0["tie_term"] > 0):
            exact = exact_tail(int(r0["u_stat"]), r0["n1"], r0["n2"])
    z = normal_z(F.col("u_stat"), F.col("n1"), F.col("n2"), F.col("tie_term"))
    r = safe_div(F.lit(2.0) * F.col("u_stat"), F.col("n1").cast("double") * F.col("n2").cast("double")) - F.lit(1.0)
    tail = significant(F.lit(0.5) * erfc(z / F.lit(math.sqrt(2.0))))
    p = F.when(z.isNull() & (F.col("n1") > 0) & (F.col("n2") > 0), F.lit(1.0)).otherwise(tail)
    if exact is not None:
        p = significant(F.lit(exact))
    extra = [p.alias("p_value")] if with_p_value else []
    return u.select(
        "n1",
        "n2",
        "u_stat",
        round_half_up(z, 6).alias("z_score"),
        round_half_up(r, 6).alias("effect_size"),
        _effect_label(r).alias("effect_label"),
        F.coalesce("nulls", F.lit(0)).cast("bigint").alias("null_values_dropped"),
        *extra,
    )


def mann_whitney_u(v: Views) -> DataFrame:
    """The test on delivery facts: on-time scores (x) greater than late scores (y)?"""
    return mann_whitney_from_values(
        delivery_facts(v), "delivery_status", "review_score", ON_TIME, LATE, bounded_domain=True
    )


def mann_whitney_test(v: Views) -> DataFrame:
    """``mann_whitney_u`` with the p-value."""
    return mann_whitney_from_values(
        delivery_facts(v), "delivery_status", "review_score", ON_TIME, LATE, with_p_value=True, bounded_domain=True
    )


def yearly_payment_test(v: Views) -> DataFrame:
    """Are the yearly mean payments of on-time orders (x) greater than those of late ones?

    The values are one mean for each purchase year and delivery status, a small sample
    without ties as a rule, so the exact distribution decides where it applies.
    """
    o = delivery_status(v, F.year("purchase_ts").alias("year")).where("year IS NOT NULL")
    paid = o.join(v.payments.select("order_id", "payment_value"), "order_id")
    means = paid.groupBy("delivery_status", "year").agg(round_half_up(F.avg("payment_value"), 4).alias("mean_payment"))
    test = mann_whitney_from_values(
        means, "delivery_status", "mean_payment", ON_TIME, LATE, with_p_value=True, bounded_domain=True, method="auto"
    )
    return test.select("*", as_long(F.col("n1") + F.col("n2")).alias("n_values"))
