"""Delivery lateness against review scores.

Two notions of lateness are kept apart on purpose: *Late* compares full
timestamps (delivered after the estimate, even by minutes), while ``days_late``
counts calendar-day boundaries. A delivery later on the due day is therefore
*Late* with ``days_late = 0`` and falls in the on-time bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_days
from ..functions.numeric import as_long, pct, round_half_up, sort_small
from ..sources import Views

# Status labels, bucket labels (in rank order) and upper bounds in days.
LATE = "Late"
ON_TIME = "On Time"
BUCKETS = (
    (1, "0 – On Time", 0),
    (2, "1–3 days late", 3),
    (3, "4–7 days late", 7),
    (4, "8–14 days late", 14),
    (5, "15+ days late", None),
)


def _delivered_known(v: Views) -> DataFrame:
    return v.orders.where(
        (F.col("order_status") == "delivered")
        & F.col("delivered_ts").isNotNull()
        & F.col("estimated_ts").isNotNull()
    )


def delivery_status(v: Views, *columns) -> DataFrame:
    """(order_id, delivery_status, ...) of the delivered orders with both dates, and the given columns of theirs."""
    late = F.col("delivered_ts") > F.col("estimated_ts")
    return _delivered_known(v).select("order_id", F.when(late, LATE).otherwise(ON_TIME).alias("delivery_status"), *columns)


def delivery_facts(v: Views) -> DataFrame:
    """One row per (delivered order, review): status, calendar days late, score.

    An order with two reviews appears twice; an order without one not at all.
    """
    o = delivery_status(v, calendar_days("delivered_ts", "estimated_ts").alias("days_late"))
    return o.join(v.reviews.select("order_id", "review_score"), "order_id", "inner").select(
        "order_id", "delivery_status", "days_late", as_long("review_score").alias("review_score")
    )


def delivery_status_summary(v: Views) -> DataFrame:
    """Per status: fact rows and mean score; plus the late share of all facts and
    the late minus on-time score gap (from the rounded means)."""
    per = delivery_facts(v).groupBy("delivery_status").agg(
        as_long(F.count("order_id")).alias("order_count"),
        round_half_up(F.avg("review_score"), 2).alias("avg_review_score"),
    )
    everything = Window.partitionBy()  # two aggregated rows
    late_rows = F.sum(F.when(F.col("delivery_status") == LATE, F.col("order_count"))).over(everything)
    late_avg = F.max(F.when(F.col("delivery_status") == LATE, F.col("avg_review_score"))).over(everything)
    on_avg = F.max(F.when(F.col("delivery_status") == ON_TIME, F.col("avg_review_score"))).over(everything)
    return per.select(
        "delivery_status",
        "order_count",
        "avg_review_score",
        round_half_up(pct(F.coalesce(late_rows, F.lit(0)), F.sum("order_count").over(everything)), 1).alias(
            "late_pct"
        ),
        round_half_up(late_avg - on_avg, 2).alias("score_gap"),
    )


def score_distribution(v: Views, statuses: Sequence[str] = (ON_TIME, LATE)) -> DataFrame:
    """Reviews per (status, score) and % within the status, after the status filter."""
    facts = delivery_facts(v).where(F.col("delivery_status").isin(list(statuses)) & F.col("review_score").isNotNull())
    counts = facts.groupBy("delivery_status", "review_score").agg(as_long(F.count(F.lit(1))).alias("review_count"))
    within = Window.partitionBy("delivery_status")  # at most five scores per status
    share = F.col("review_count") / F.sum("review_count").over(within) * F.lit(100.0)
    return counts.select("delivery_status", "review_score", "review_count", round_half_up(share, 2).alias("pct"))


def _bucket_rank(days_late):
    expr = None
    for rank, _, upper in BUCKETS:
        if upper is None:
            expr = expr.otherwise(F.lit(rank))
        elif expr is None:
            expr = F.when(days_late <= upper, F.lit(rank))
        else:
            expr = expr.when(days_late <= upper, F.lit(rank))
    return expr


def _bucket_label(rank):
    expr = None
    for r, label, _ in BUCKETS:
        expr = F.when(rank == r, label) if expr is None else expr.when(rank == r, label)
    return expr


def lateness_buckets(v: Views) -> DataFrame:
    """Reviews of delivered orders (delivered on or after purchase) per lateness
    bucket: count and mean score, ordered by bucket rank."""
    o = _delivered_known(v).where(F.col("delivered_ts") >= F.col("purchase_ts")).select(
        "order_id", calendar_days("delivered_ts", "estimated_ts").alias("days_late")
    )
    rows = o.join(v.reviews.select("order_id", "review_score"), "order_id", "inner")
    agg = rows.groupBy(as_long(_bucket_rank(F.col("days_late"))).alias("bucket_rank")).agg(
        as_long(F.count(F.lit(1))).alias("order_count"),
        round_half_up(F.avg("review_score"), 2).alias("avg_score"),
    )
    out = agg.select(
        "bucket_rank", _bucket_label(F.col("bucket_rank")).alias("lateness_bucket"), "order_count", "avg_score"
    )
    return sort_small(out, "bucket_rank")


def lateness_bucket_contrast(v: Views) -> DataFrame:
    """Whether 15+ days late scores higher than 8-14 days, and the on-time minus
    8-14 gap; buckets are looked up by rank (NULL when a bucket is empty)."""
    b = lateness_buckets(v)
    rank = F.col("bucket_rank")

    def avg_at(r):
        return F.max(F.when(rank == r, F.col("avg_score")))

    agg = b.agg(avg_at(1).alias("on_time_avg"), avg_at(4).alias("late_8_14_avg"), avg_at(5).alias("late_15_plus_avg"))
    return agg.select(
        "on_time_avg",
        "late_8_14_avg",
        "late_15_plus_avg",
        (F.col("late_15_plus_avg") > F.col("late_8_14_avg")).alias("late_15_plus_higher"),
        round_half_up(F.col("on_time_avg") - F.col("late_8_14_avg"), 2).alias("on_time_minus_8_14"),
    )
