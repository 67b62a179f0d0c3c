"""Recency / frequency / monetary scoring and segments.

Quintile scores follow ``pandas.qcut(x, 5, duplicates='drop')``: edges are the
linearly interpolated 0, 20, ..., 100 % quantiles, duplicate edges are dropped,
bins are right-closed and the lowest value is included. A value's score is
``1 + #(inner edges < value)``, so scoring is a per-row comparison against a
one-row table of edges (broadcast), not a sort. Recency is inverted with the
observed number of bins (``bins + 1 - score``), so when edges collapse the top
recency score is below 5. A constant column scores 1 (the dashboard would fail).

Monetary totals are rounded to cents before the edges are taken, so ties and
edges do not depend on the summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_days
from ..functions.numeric import as_long, round_half_up, sort_small
from ..functions.position import log_bucket, materialize
from ..functions.quantiles import bin_count, inner_edges, quantile_edges_multi, quantile_score
from ..functions.sampling import SAMPLE, mix_bits, seeded_mix
from ..functions.selection import smallest_rows
from ..sources import Views
from .retention import delivered_person_orders
from ..functions.scalars import with_scalars

# Segment names, in the order the rules are tried.
CHAMPIONS = "Champions"
LOYAL = "Loyal Customers"
NEW = "New Customers"
AT_RISK = "At Risk"
LOST = "Lost"
POTENTIAL = "Potential Loyalists"
SEGMENTS = (CHAMPIONS, LOYAL, NEW, POTENTIAL, AT_RISK, LOST)


def rfm_base(v: Views) -> DataFrame:
    """Per person with a delivered, paid order: days since their last purchase
    (measured from the latest purchase over *all* orders), distinct orders, total paid."""
    ref = v.orders.agg(F.max("purchase_ts").alias("ref_ts"))
    # Pre-aggregate payments to one row per order before joining (fan-out 1:1).
    paid = v.payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    rows = delivered_person_orders(v).join(paid, "order_id", "inner")
    per = rows.groupBy("customer_unique_id").agg(
        F.max("purchase_ts").alias("last_ts"),
        as_long(F.count_distinct("order_id")).alias("frequency"),
        round_half_up(F.sum("paid"), 2).alias("monetary"),
    )
    return with_scalars(per, ref).select(
        "customer_unique_id",
        calendar_days("ref_ts", "last_ts").alias("recency_days"),
        "frequency",
        "monetary",
    )


def rfm_scores(v: Views, method: str = "exact") -> DataFrame:
    """``rfm_base`` plus r_score, f_score, m_score (quintiles) and their sum.

    The base is written once when the job is built. The jobs below take the scores of
    an earlier call as ``scores``, so that several of them share one scoring."""
    # Read by the quantile pass and the scoring pass: compute and write it once.
    base = materialize(rfm_base(v))
    wide = quantile_edges_multi(
        base, ["recency_days", "frequency", "monetary"], method=method, bucket=log_bucket(F.col("v"))
    )
    edges = wide.select(
        *[
            x
            for prefix, col in (("r", "recency_days"), ("f", "frequency"), ("m", "monetary"))
            for x in (
                inner_edges(F.col(f"{col}_edges")).alias(f"{prefix}_inner"),
                bin_count(F.col(f"{col}_edges")).alias(f"{prefix}_bins"),
            )
        ]
    )
    r_raw = quantile_score(F.col("recency_days"), F.col("r_inner"))
    scored = with_scalars(base, edges).select(
        "customer_unique_id",
        "recency_days",
        "frequency",
        "monetary",
        (F.col("r_bins") + 1 - r_raw).alias("r_score"),
        quantile_score(F.col("frequency"), F.col("f_inner")).alias("f_score"),
        quantile_score(F.col("monetary"), F.col("m_inner")).alias("m_score"),
    )
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def segment_of(r, f, m):
    """The six-way rule, first match wins."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), CHAMPIONS)
        .when((r >= 3) & (f >= 3), LOYAL)
        .when((r >= 4) & (f <= 2), NEW)
        .when((r <= 2) & (f >= 3), AT_RISK)
        .when((r <= 2) & (f <= 2), LOST)
        .otherwise(POTENTIAL)
    )


def rfm_segments(v: Views, method: str = "exact", scores: DataFrame | None = None) -> DataFrame:
    s = rfm_scores(v, method) if scores is None else scores
    return s.withColumn("segment", segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score")))


def summarize_segments(segs: DataFrame) -> DataFrame:
    """Per segment: persons, mean recency/frequency/monetary (1 dp), % of persons."""
    per = segs.groupBy("segment").agg(
        as_long(F.count("customer_unique_id")).alias("customers"),
        round_half_up(F.avg("recency_days"), 1).alias("avg_recency"),
        round_half_up(F.avg("frequency"), 1).alias("avg_frequency"),
        round_half_up(F.avg("monetary"), 1).alias("avg_monetary"),
    )
    share = F.col("customers") / F.sum("customers").over(Window.partitionBy()) * F.lit(100)  # <= 6 rows
    return sort_small(per.select("*", round_half_up(share, 1).alias("pct_of_base")), F.col("customers").desc())


def rfm_segment_summary(v: Views, method: str = "exact", scores: DataFrame | None = None) -> DataFrame:
    return summarize_segments(rfm_segments(v, method, scores))


def rfm_segment_coverage(v: Views, method: str = "exact", scores: DataFrame | None = None) -> DataFrame:
    """All six segments with their % of persons (0 when empty), an empty flag, and
    the % of persons with a single order.

    One aggregation per segment carries both counts, so the persons are scored
    once; the shares are windows over the six joined rows.
    """
    segs = rfm_segments(v, method, scores)
    per = segs.groupBy("segment").agg(
        as_long(F.count("customer_unique_id")).alias("customers"),
        as_long(F.count_if(F.col("frequency") == 1)).alias("_one"),
    )
    names = segs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(SEGMENTS)], "segment_order int, segment string")
    rows = names.join(F.broadcast(per), "segment", "left")  # six names x six rows at most
    six = Window.partitionBy()  # the six segment rows
    total = F.sum("customers").over(six)
    share = F.col("customers") / total * F.lit(100)
    one_order = F.lit(100.0) * F.try_divide(F.sum("_one").over(six).cast("double"), total.cast("double"))
    return rows.select(
        "segment",
        as_long(F.coalesce(F.col("customers"), F.lit(0))).alias("customers"),
        F.coalesce(round_half_up(share, 1), F.lit(0.0)).alias("pct_of_base"),
        F.col("customers").isNull().alias("is_empty"),
        round_half_up(one_order, 2).alias("one_order_pct"),
    )


def rfm_sample(
    v: Views, n: int = 3000, seed: int = 42, method: str = "exact", scores: DataFrame | None = None
) -> DataFrame:
    """Exactly ``min(n, persons)`` scored persons, drawn without replacement in a seeded
    order. Any ``n``: the key of the n-th person is found from histograms, then one filter
    keeps them (``functions.selection``), so no task holds n rows. The scores are read a
    few times; without ``scores`` they are written first."""
    scores = materialize(rfm_scores(v, method)) if scores is None else scores
    keyed = scores.withColumn("_mix", seeded_mix(scores, "customer_unique_id", seed, SAMPLE))
    drawn = smallest_rows(keyed, n, "_mix", "customer_unique_id", mix_bits(scores, "customer_unique_id"))
    return rfm_segments(v, method, drawn.drop("_mix"))
