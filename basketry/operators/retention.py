"""Repeat purchases: orders per person, first-to-second order gaps, return curve.

Persons are ``customer_unique_id`` (one person can have several customer ids).

Ranking a person's orders uses ``row_number() <= 2``, which Spark executes with
a partial ``WindowGroupLimit`` *before* the shuffle: each map task forwards at
most two orders per person, so a person holding a third of all orders costs no
more than any other after the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_days
from ..functions.numeric import as_long, pct, round_half_up
from ..functions.position import running_sums
from ..sources import Views
from ..functions.scalars import with_scalars

# Candidate histogram bin widths, 1-2-5 steps per power of ten.
BIN_STEPS = tuple(m * 10**e for e in range(0, 7) for m in (1, 2, 5))
# Segment names of the frequency split.
ONE_TIME, RETURNING = "One-time", "Returning"


def delivered_person_orders(v: Views) -> DataFrame:
    """Delivered orders with the person who placed them."""
    o = v.orders.where(F.col("order_status") == "delivered").select("order_id", "customer_id", "purchase_ts")
    return o.join(v.customers.select("customer_id", "customer_unique_id"), "customer_id", "inner")


def customer_order_counts(v: Views) -> DataFrame:
    """Distinct delivered orders per person."""
    return delivered_person_orders(v).groupBy("customer_unique_id").agg(
        as_long(F.count_distinct("order_id")).alias("total_orders")
    )


def purchase_frequency(v: Views) -> DataFrame:
    """One-time and returning persons: count and % of persons (1 dp)."""
    n = F.col("total_orders")
    agg = customer_order_counts(v).agg(
        F.count_if(n == 1).alias("one"), F.count_if(n > 1).alias("more"), F.count(F.lit(1)).alias("total")
    )
    rows = F.explode(
        F.array(
            F.struct(F.lit(ONE_TIME).alias("segment"), F.col("one").alias("customers")),
            F.struct(F.lit(RETURNING).alias("segment"), F.col("more").alias("customers")),
        )
    )
    return agg.select(rows.alias("r"), "total").select(
        "r.segment",
        as_long("r.customers").alias("customers"),
        round_half_up(pct("r.customers", "total"), 1).alias("pct"),
    )


def first_two_orders(rows: DataFrame, person: str = "customer_unique_id") -> DataFrame:
    """Rank each person's rows by purchase time (NULL last, then order id) and keep ranks 1-2."""
    w = Window.partitionBy(person).orderBy(F.col("purchase_ts").asc_nulls_last(), F.col("order_id").asc())
    return rows.withColumn("order_rank", F.row_number().over(w)).where(F.col("order_rank") <= 2)


def return_gaps(v: Views) -> DataFrame:
    """Calendar days between each person's first and second delivered order.

    Persons with one order, a same-day second order (gap 0) or an unknown second
    purchase time are left out.
    """
    ranked = first_two_orders(delivered_person_orders(v))
    rank = F.col("order_rank")
    gaps = ranked.groupBy("customer_unique_id").agg(
        calendar_days(F.max(F.when(rank == 2, F.col("purchase_ts"))), F.max(F.when(rank == 1, F.col("purchase_ts"))))
        .alias("days_to_return")
    )
    return gaps.where(F.col("days_to_return") > 0)


def return_gap_stats(v: Views, clip_days: int = 365) -> DataFrame:
    """Median and mean gap (whole days, truncated), returners, and returners within ``clip_days``."""
    d = F.col("days_to_return")
    return return_gaps(v).agg(
        as_long(F.floor(F.median(d))).alias("median_days"),
        as_long(F.floor(F.avg(d))).alias("mean_days"),
        as_long(F.count(F.lit(1))).alias("returners"),
        as_long(F.count_if(d <= clip_days)).alias("within_clip"),
    )


def return_gap_histogram(v: Views, clip_days: int = 365, max_bins: int = 40) -> DataFrame:
    """Returners per equal-width gap bin, for gaps up to ``clip_days``.

    The bin width is the smallest 1/2/5 x 10^k that covers the observed range in
    at most ``max_bins`` bins; bins start at multiples of the width.
    """
    d = F.col("days_to_return")
    clipped = return_gaps(v).where(d <= clip_days)
    lo, hi = F.col("lo"), F.col("hi")
    steps = F.array(*[F.lit(s) for s in BIN_STEPS])
    fits = F.filter(steps, lambda s: F.floor(hi / s) - F.floor(lo / s) + F.lit(1) <= F.lit(max_bins))
    width = clipped.agg(F.min(d).alias("lo"), F.max(d).alias("hi")).select(F.array_min(fits).alias("step"))
    start = F.floor(d / F.col("step")) * F.col("step")
    return (
        with_scalars(clipped, width)
        .groupBy(as_long(start).alias("bin_start"), F.col("step"))
        .agg(as_long(F.count(F.lit(1))).alias("customers"))
        .select("bin_start", as_long(F.col("bin_start") + F.col("step")).alias("bin_end"), "customers")
    )


def cumulative_return_curve(v: Views, max_days: int = 500, chunk_rows: int = 100_000) -> DataFrame:
    """For returners sorted by gap, ``position / returners * 100`` at each one,
    kept up to ``max_days`` (the denominator counts every returner).

    Tied gaps get successive positions. Positions come from per-day counts and
    their running sums; the rows of one day are generated in chunks of
    ``chunk_rows`` that are spread over tasks, so no task ever holds a whole day
    or the whole curve.
    """
    d = F.col("days_to_return")
    per_day = return_gaps(v).groupBy(d.alias("days")).agg(F.count(F.lit(1)).alias("c"))
    total = per_day.agg(F.sum("c").alias("n"))
    # Gap days have a bounded domain (the calendar span of the data): bucket by the day itself.
    cum = running_sums(per_day, ["days"], {"_end": F.col("c")}, bucket=F.col("days"))
    kept = with_scalars(cum.where(F.col("days") <= max_days), total)
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / F.lit(chunk_rows))))
    chunks = kept.select("days", (F.col("_end") - F.col("c")).alias("start"), "c", "n", chunk.alias("chunk"))
    chunks = chunks.repartition("days", "chunk")
    first = F.col("start") + F.col("chunk") * chunk_rows + 1
    last = F.col("start") + F.least(F.col("c"), (F.col("chunk") + 1) * chunk_rows)
    pos = chunks.select("days", "n", F.explode(F.sequence(first, last)).alias("pos"))
    return pos.select(as_long("days").alias("days"), (F.col("pos") / F.col("n") * F.lit(100)).alias("cumulative_pct"))


def return_milestones(v: Views, horizons: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """% of returners whose gap is at most each horizon (days)."""
    d = F.col("days_to_return")
    agg = return_gaps(v).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(d <= h).alias(f"w{h}") for h in horizons])
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("days"), F.col(f"w{h}").alias("k")) for h in horizons]))
    return agg.select(rows.alias("r"), "n").select(
        as_long("r.days").alias("days"),
        round_half_up(F.try_divide(F.col("r.k"), F.col("n")) * F.lit(100), 2).alias("pct_returned"),
    )
