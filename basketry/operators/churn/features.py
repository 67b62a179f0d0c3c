"""First delivered, paid order of each person as a feature row, plus the repeat label.

Payments and reviews are aggregated to one row per order before any join, so
the joins are 1:1 on order id (an order with two reviews gets their mean; with
none, the neutral score 3). The person's first order and their distinct-order
count come from one aggregation per person: ``min_by`` over the order's
fields with the key (purchase time missing?, purchase time, order id), so NULL
times sort last and ties go to the lower order id, next to ``count_distinct``.
Both are combined on the map side, so a person with a third of all orders is
reduced before the shuffle, and the orders x payments join is computed once. The
state of ``min_by`` is a struct, so Spark aggregates by sorting, not hashing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.dates import calendar_days
from ...functions.numeric import as_long, round_half_up
from ...sources import Views

# Feature columns in model order, and their display labels.
FEATURES = (
    "payment_value",
    "payment_installments",
    "review_score",
    "is_credit_card",
    "days_late",
    "purchase_month",
)
FEATURE_LABELS = (
    "Order Value (R$)",
    "Installments",
    "Review Score",
    "Credit Card",
    "Days Late",
    "Purchase Month",
)
NEUTRAL_REVIEW = 3.0
PERSON = "customer_unique_id"


def first_order_features(v: Views) -> DataFrame:
    pay = v.payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
        F.max(F.when(F.col("payment_type") == "credit_card", 1).otherwise(0)).alias("is_credit_card"),
    )
    rev = v.reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    orders = v.orders.where(F.col("order_status") == "delivered").select(
        "order_id", "customer_id", "purchase_ts", "delivered_ts", "estimated_ts"
    )
    rows = orders.join(v.customers.select("customer_id", PERSON), "customer_id", "inner").join(pay, "order_id", "inner")
    fields = ["order_id", "purchase_ts", "delivered_ts", "estimated_ts", "payment_value", "payment_installments",
              "is_credit_card"]
    first_key = F.struct(F.col("purchase_ts").isNull(), F.col("purchase_ts"), F.col("order_id"))
    per_person = rows.groupBy(PERSON).agg(
        F.min_by(F.struct(*fields), first_key).alias("_first"),
        F.count_distinct("order_id").alias("total_orders"),
    )
    firsts = per_person.select(PERSON, "total_orders", *[F.col(f"_first.{f}").alias(f) for f in fields])
    joined = firsts.join(rev, "order_id", "left")
    late = F.col("delivered_ts") > F.col("estimated_ts")
    return joined.select(
        PERSON,
        round_half_up("payment_value", 2).alias("payment_value"),
        as_long("payment_installments").alias("payment_installments"),
        F.coalesce(F.col("review_score").cast("double"), F.lit(NEUTRAL_REVIEW)).alias("review_score"),
        as_long("is_credit_card").alias("is_credit_card"),
        F.when(late, calendar_days("delivered_ts", "estimated_ts")).otherwise(0).cast("bigint").alias("days_late"),
        as_long(F.month("purchase_ts")).alias("purchase_month"),
        F.when(F.col("total_orders") > 1, 1).otherwise(0).cast("bigint").alias("label"),
    )


def label_balance(features: DataFrame) -> DataFrame:
    """Rows of the modelling set, repeaters, and the repeat % (1 dp)."""
    return features.agg(
        as_long(F.count(F.lit(1))).alias("customers"),
        as_long(F.sum("label")).alias("repeaters"),
        round_half_up(F.lit(100.0) * F.avg("label"), 1).alias("repeat_pct"),
    )
