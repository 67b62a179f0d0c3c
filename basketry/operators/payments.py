"""Payment-method mix and credit-card installment profile.

``count_distinct(order_id)`` per method is planned by Spark as an aggregation on
(method, order_id) first, so the dominant method is spread over all reducers by
order id before the (tiny) per-method merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_long, pct, round_half_up, safe_div, sort_small
from ..sources import Views

SORT_COLUMNS = ("order_count", "pct_of_orders", "avg_order_value", "total_revenue")
MAX_TIER = 12


def payment_method_summary(v: Views, sort_by: str = "order_count") -> DataFrame:
    """Per payment type: distinct orders, mean and total value, % of the summed
    distinct-order counts (an order paid two ways counts once per way)."""
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}")
    agg = v.payments.groupBy("payment_type").agg(
        as_long(F.count_distinct("order_id")).alias("order_count"),
        round_half_up(F.avg("payment_value"), 2).alias("avg_order_value"),
        round_half_up(F.sum("payment_value"), 2).alias("total_revenue"),
    )
    everything = Window.partitionBy()  # over the handful of aggregated methods
    summary = agg.select(
        "payment_type",
        "order_count",
        "avg_order_value",
        "total_revenue",
        round_half_up(pct("order_count", F.sum("order_count").over(everything)), 1).alias("pct_of_orders"),
    )
    return sort_small(summary, F.col(sort_by).desc(), F.col("payment_type"))


def payment_type_share(v: Views, payment_type: str = "credit_card") -> DataFrame:
    """The % of orders of one payment type (no row if the type never occurs)."""
    return payment_method_summary(v).where(F.col("payment_type") == payment_type).select(
        "payment_type", "pct_of_orders"
    )


def installment_profile(v: Views, min_tier: int = 1, max_tier: int = MAX_TIER) -> DataFrame:
    """Credit-card payment rows per installment tier (1..12): row count, mean value."""
    if not 1 <= min_tier <= max_tier <= MAX_TIER:
        raise ValueError(f"tiers must lie between 1 and {MAX_TIER}")
    rows = v.payments.where(
        (F.col("payment_type") == "credit_card") & F.col("payment_installments").between(min_tier, max_tier)
    )
    profile = rows.groupBy(as_long("payment_installments").alias("payment_installments")).agg(
        as_long(F.count(F.lit(1))).alias("order_count"),
        round_half_up(F.avg("payment_value"), 2).alias("avg_value"),
    )
    return sort_small(profile, "payment_installments")


def installment_contrast(v: Views) -> DataFrame:
    """Single-installment share and value against the 6+ tiers.

    The 6+ average weights the already rounded per-tier averages by their row
    counts, as the dashboard figure does.
    """
    prof = installment_profile(v)
    tier = F.col("payment_installments")
    n = F.col("order_count")
    agg = prof.agg(
        F.sum(n).alias("total"),
        F.sum(F.when(tier == 1, n)).alias("single"),
        F.max(F.when(tier == 1, F.col("avg_value"))).alias("avg_single"),
        F.sum(F.when(tier >= 6, F.col("avg_value") * n)).alias("hi_value"),
        F.sum(F.when(tier >= 6, n)).alias("hi_rows"),
    )
    return agg.select(
        round_half_up(pct("single", "total"), 2).alias("pct_single_installment"),
        F.col("avg_single").alias("avg_value_single"),
        round_half_up(safe_div("hi_value", "hi_rows"), 2).alias("avg_value_6_plus"),
    )
