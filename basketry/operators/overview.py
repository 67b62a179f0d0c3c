"""Headline metrics, monthly trend, year-over-year and status breakdown.

All jobs are a scan, a filter and one hash aggregation (partial aggregation on
the map side, so a hot month or status never lands in one task). Anything after
the aggregation works on at most a few hundred rows (months, statuses).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.numeric import as_long, pct, round_half_up, safe_div
from ..sources import Views
from .retention import customer_order_counts
from ..functions.scalars import with_scalars


# English month abbreviations, January first (zone-free month names).
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _delivered():
    return F.col("order_status") == "delivered"


def _late():
    return F.col("delivered_ts") > F.col("estimated_ts")


def _delivered_with_dates(v: Views) -> DataFrame:
    return v.orders.where(_delivered() & F.col("delivered_ts").isNotNull() & F.col("estimated_ts").isNotNull())


def late_rate_orders(v: Views) -> DataFrame:
    """Share of delivered orders (both dates known) delivered after the estimate."""
    counts = _delivered_with_dates(v).agg(
        F.count_if(_late()).alias("late_orders"),
        F.count(F.lit(1)).alias("delivered_orders"),
    )
    return counts.select(
        as_long("late_orders").alias("late_orders"),
        as_long("delivered_orders").alias("delivered_orders"),
        round_half_up(pct("late_orders", "delivered_orders"), 1).alias("late_pct"),
    )


def kpi_summary(v: Views) -> DataFrame:
    """One row: orders, revenue, mean review, late % (over orders), returning % (persons)."""
    known = _delivered() & F.col("delivered_ts").isNotNull() & F.col("estimated_ts").isNotNull()
    orders = v.orders.agg(  # one pass over orders for the count and the late rate
        as_long(F.count(F.lit(1))).alias("total_orders"),
        F.count_if(known & _late()).alias("_late"),
        F.count_if(known).alias("_known"),
    ).select("total_orders", round_half_up(pct("_late", "_known"), 1).alias("late_pct"))
    revenue = v.payments.agg(round_half_up(F.sum("payment_value"), 2).alias("total_revenue"))
    review = v.reviews.agg(round_half_up(F.avg("review_score"), 2).alias("avg_review"))
    persons = customer_order_counts(v).agg(
        round_half_up(pct(F.count_if(F.col("total_orders") > 1), F.count(F.lit(1))), 1).alias("returning_pct")
    )
    # Each part is a global aggregate: attached as scalar subqueries.
    out = with_scalars(with_scalars(with_scalars(orders, revenue), review), persons)
    return out.select("total_orders", "total_revenue", "avg_review", "late_pct", "returning_pct")


def _month_filter(df: DataFrame, start_month: str | None, end_month: str | None) -> DataFrame:
    """Keep purchases in [start_month, end_month] ('YYYY-MM'); stated on the raw
    timestamp so the predicate can reach the scan."""
    ts = F.col("purchase_ts")
    if start_month:
        df = df.where(ts >= F.to_timestamp_ntz(F.lit(f"{start_month}-01 00:00:00")))
    if end_month:
        after = F.add_months(F.to_date(F.lit(f"{end_month}-01")), 1).cast("timestamp_ntz")
        df = df.where(ts < after)
    return df


def monthly_order_trend(v: Views, start_month: str | None = None, end_month: str | None = None) -> DataFrame:
    """Orders per purchase month; orders without a purchase time are left out."""
    df = _month_filter(v.orders.where(F.col("purchase_ts").isNotNull()), start_month, end_month)
    return df.groupBy(month_start("purchase_ts").alias("month")).agg(as_long(F.count(F.lit(1))).alias("order_count"))


def peak_and_growth(v: Views, min_orders: int = 100) -> DataFrame:
    """Peak month (earliest on ties), first month with >= ``min_orders`` orders, their ratio."""
    monthly = monthly_order_trend(v)
    peak = monthly.agg(
        F.min_by(F.struct("month", "order_count"), F.struct(-F.col("order_count"), F.col("month"))).alias("p")
    ).select(F.col("p.month").alias("peak_month"), F.col("p.order_count").alias("peak_orders"))
    base = (
        monthly.where(F.col("order_count") >= min_orders)
        .agg(F.min_by(F.struct("month", "order_count"), F.col("month")).alias("b"))
        .select(F.col("b.month").alias("base_month"), F.col("b.order_count").alias("base_orders"))
    )
    return with_scalars(peak, base).select(
        "peak_month",
        "peak_orders",
        "base_month",
        "base_orders",
        round_half_up(safe_div("peak_orders", "base_orders"), 2).alias("growth_x"),
    )


def month_over_month(v: Views, start_month: str | None = None, end_month: str | None = None) -> DataFrame:
    """% change of each month against the calendar month before it (no row if either is missing)."""
    monthly = monthly_order_trend(v)
    by_month = Window.orderBy("month")  # one row for each month
    before = monthly.select(
        "month",
        "order_count",
        F.lag("order_count").over(by_month).alias("prev_order_count"),
        F.lag("month").over(by_month).alias("_prev"),
    )
    out = before.where(F.col("_prev") == F.add_months("month", -1).cast("date"))
    if start_month:
        out = out.where(F.col("month") >= F.to_date(F.lit(f"{start_month}-01")))
    if end_month:
        out = out.where(F.col("month") <= F.to_date(F.lit(f"{end_month}-01")))
    change = (safe_div("order_count", "prev_order_count") - F.lit(1.0)) * F.lit(100.0)
    return out.select("month", "order_count", "prev_order_count", round_half_up(change, 2).alias("pct_change"))


def yoy_monthly(v: Views, years: Sequence[int] = (1999, 2000), last_month: int = 8) -> DataFrame:
    """Orders per (year, month number) for ``years``, months 1..``last_month``."""
    ts = F.col("purchase_ts")
    if not 1 <= last_month <= 12:
        raise ValueError("last_month must be between 1 and 12")
    # ranges of the raw timestamp, so that they reach the scan and prune partitions
    in_years = F.lit(False)
    for y in years:
        after = f"{y + last_month // 12:04d}-{last_month % 12 + 1:02d}-01 00:00:00"
        start, end = (F.to_timestamp_ntz(F.lit(t)) for t in (f"{y:04d}-01-01 00:00:00", after))
        in_years = in_years | ((ts >= start) & (ts < end))
    df = v.orders.where(in_years)
    return df.groupBy(
        as_long(F.year(ts)).alias("year"),
        as_long(F.month(ts)).alias("month_num"),
        F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(ts)).alias("month_name"),
    ).agg(as_long(F.count(F.lit(1))).alias("order_count"))


def yoy_pivot(v: Views, base_year: int = 1999, compare_year: int = 2000, last_month: int = 8) -> DataFrame:
    """Years side by side per month, their ratio and % change, and whether the
    compared year is ahead in every month shown (a month missing in either year
    counts as not ahead)."""
    agg = yoy_monthly(v, (base_year, compare_year), last_month)
    wide = (
        agg.groupBy("month_num")
        .pivot("year", [base_year, compare_year])
        .agg(F.sum("order_count"))
        .withColumnRenamed(str(base_year), "base_orders")
        .withColumnRenamed(str(compare_year), "compare_orders")
    )
    ratio = safe_div("compare_orders", "base_orders")
    ahead = F.coalesce(F.col("compare_orders") > F.col("base_orders"), F.lit(False))
    # At most 12 aggregated rows: the un-partitioned window is bounded.
    return wide.select(
        "month_num",
        as_long("base_orders").alias("base_orders"),
        as_long("compare_orders").alias("compare_orders"),
        round_half_up(ratio, 4).alias("ratio"),
        round_half_up((ratio - F.lit(1.0)) * F.lit(100.0), 2).alias("pct_change"),
        F.bool_and(ahead).over(Window.partitionBy()).alias("all_months_up"),
    )


def status_breakdown(v: Views) -> DataFrame:
    """Orders per status and % of all orders with a status (1 dp)."""
    counts = v.orders.where(F.col("order_status").isNotNull()).groupBy("order_status").agg(
        as_long(F.count(F.lit(1))).alias("order_count")
    )
    share = F.col("order_count") / F.sum("order_count").over(Window.partitionBy()) * F.lit(100.0)
    return counts.select("order_status", "order_count", round_half_up(share, 1).alias("pct_of_total"))
