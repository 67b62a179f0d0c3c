"""Order-analytics views derived from the benchmark tables.

The benchmark data (``orders``, ``customer``, ``lineitem``) has no delivery
dates, reviews or payments, so they are derived arithmetically from the keys.
The rules are stated in FIXTURES.md; ``plans.oracle`` holds the same rules as
SQL for the DuckDB oracle. Everything here is a lazy projection of a parquet
scan, so the views grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import days, hours
from ..functions.memo import Memo
from . import Views


_SCHEMAS = Memo()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; its schema is inferred once for the same files and then passed to
    the reader, which saves a schema-inference job on every later read."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_SCHEMAS.get(spark, path, [path], lambda: spark.read.parquet(path).schema)).parquet(path)


def view_paths(sf_dir: str) -> list[str]:
    """The tables that the views are made of."""
    return [f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "lineitem")]


# The derivation rules of FIXTURES.md, as SQL expressions. ``selectExpr`` parses
# them inside the JVM, so building a view costs a few calls instead of hundreds
# of Column round trips from Python.
ORDERS_EXPR = (
    "o_orderkey AS order_id",
    "o_custkey AS customer_id",
    "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status",
    "CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR * ((o_orderkey * 7) % 24) AS purchase_ts",
    "CAST(CASE WHEN o_orderkey % 50 = 7 THEN NULL"
    " WHEN o_orderkey % 97 = 3 THEN CAST(o_orderdate AS TIMESTAMP_NTZ) - INTERVAL '1' DAY"
    " ELSE CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL '1' DAY * ((o_orderkey * 7919) % 45)"
    " + INTERVAL '1' HOUR * ((o_orderkey * 11) % 24) END AS TIMESTAMP_NTZ) AS delivered_ts",
    "CAST(CASE WHEN o_orderkey % 61 = 5 THEN NULL"
    " ELSE CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL '1' DAY * (24 + (o_orderkey % 5) * 2) END"
    " AS TIMESTAMP_NTZ) AS estimated_ts",
)
CUSTOMERS_EXPR = (
    "c_custkey AS customer_id",
    "c_custkey - CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE 0 END AS customer_unique_id",
)
PAYMENTS_EXPR = (
    "l_orderkey AS order_id",
    "CASE WHEN l_linestatus = 'F' THEN 'credit_card' WHEN l_returnflag = 'A' THEN 'boleto'"
    " WHEN l_returnflag = 'N' THEN 'voucher' ELSE 'debit_card' END AS payment_type",
    "CAST(l_quantity AS INT) AS payment_installments",
    "l_extendedprice AS payment_value",
)
REVIEWS_FIRST_EXPR = (
    "order_id",
    "CAST(CASE WHEN delivered_ts > estimated_ts THEN 1 + (order_id * 13) % 3"
    " ELSE 3 + (order_id * 17) % 3 END AS INT) AS review_score",
)
REVIEWS_SECOND_EXPR = ("order_id", "CAST(1 + (order_id * 13) % 5 AS INT) AS review_score")
SCORED_EXPR = (
    "o_orderkey AS order_id",
    "CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0D AS score",
    "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS label",
    "CAST(CASE WHEN CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0D >= 0.5D THEN 1 ELSE 0 END AS BIGINT)"
    " AS prediction",
)


def orders_view(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*ORDERS_EXPR)


def customers_view(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(*CUSTOMERS_EXPR)


def payments_view(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*PAYMENTS_EXPR)


def reviews_view(f_orders: DataFrame) -> DataFrame:
    """10 % of orders without a review, some with two."""
    first = f_orders.where("order_id % 10 <> 0").selectExpr(*REVIEWS_FIRST_EXPR)
    second = f_orders.where("order_id % 40 = 1").selectExpr(*REVIEWS_SECOND_EXPR)
    return first.unionByName(second)


def scored_view(orders: DataFrame) -> DataFrame:
    """A deterministic score/label table for the metric jobs (ties intended)."""
    return orders.selectExpr(*SCORED_EXPR)


def fixture_views(spark: SparkSession, sf_dir: str) -> Views:
    f_orders = orders_view(_table(spark, sf_dir, "orders"))
    return Views(
        orders=f_orders,
        customers=customers_view(_table(spark, sf_dir, "customer")),
        payments=payments_view(_table(spark, sf_dir, "lineitem")),
        reviews=reviews_view(f_orders),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_view(_table(spark, sf_dir, "orders"))


def _as_source_text(ts, k):
    """Timestamp text as the exports carry it, with some broken values mixed in.

    Built from the date and time fields: formatting a ``timestamp_ntz`` with
    ``date_format`` goes through the session time zone and moves wall clocks
    that fall into a daylight-saving gap.
    """
    y, mo, d, h, mi = F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts)
    day_first = F.format_string("%02d-%02d-%02d %02d:%02d", d, mo, y % 100, h, mi)
    iso = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, mo, d, h, mi, F.second(ts))
    return (
        F.when(k % 53 == 1, F.lit("n/a"))
        .when(ts.isNull(), F.lit(None).cast("string"))
        .when(k % 59 == 2, iso)
        .otherwise(day_first)
    )


def orders_raw_view(f_orders: DataFrame) -> DataFrame:
    """Orders as the CSV export writes them: text ids, day-first text timestamps.

    Approval is one hour after purchase and carrier hand-over one day before
    delivery; neither is used by any job (they are parsed only).
    """
    k = F.col("order_id")
    stamps = {
        "order_purchase_timestamp": F.col("purchase_ts"),
        "order_approved_at": F.col("purchase_ts") + hours(F.lit(1)),
        "order_delivered_carrier_date": F.col("delivered_ts") - days(F.lit(1)),
        "order_delivered_customer_date": F.col("delivered_ts"),
        "order_estimated_delivery_date": F.col("estimated_ts"),
    }
    return f_orders.select(
        k.cast("string").alias("order_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        "order_status",
        *[_as_source_text(ts, k).alias(name) for name, ts in stamps.items()],
    )


PAYMENTS_RAW_EXPR = (
    "CAST(payment_value AS STRING) AS payment_value",
    "CAST(payment_installments AS STRING) AS payment_installments",
    "payment_type",
    "CAST(order_id AS STRING) AS order_id",
)
CUSTOMERS_RAW_EXPR = (
    "CAST(customer_unique_id AS STRING) AS customer_unique_id",
    "CAST(customer_id AS STRING) AS customer_id",
)
# The comment comes before the id and holds quotes, commas and line breaks.
REVIEWS_RAW_EXPR = (
    "CASE order_id % 4 WHEN 0 THEN concat('\"good\", \"really\" ', order_id, ',\\nmore')"
    " WHEN 1 THEN NULL WHEN 2 THEN concat('plain ', order_id) ELSE 'a, b' END AS review_comment_message",
    "CAST(order_id AS STRING) AS order_id",
    "CASE WHEN order_id % 31 = 3 THEN 'five' ELSE CAST(review_score AS STRING) END AS review_score",
)
ITEMS_RAW_EXPR = (
    "CAST(l_orderkey AS STRING) AS order_id",
    "CAST(l_linenumber AS STRING) AS order_item_id",
    "CAST(l_partkey AS STRING) AS product_id",
    "CAST(l_suppkey AS STRING) AS seller_id",
    "CAST(l_extendedprice AS STRING) AS price",
    "CAST(l_tax AS STRING) AS freight_value",
    "CAST(l_shipdate AS TIMESTAMP_NTZ) AS _limit",
)


def items_raw_view(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.selectExpr(*ITEMS_RAW_EXPR)
    return rows.withColumn("shipping_limit_date", _as_source_text(F.col("_limit"), F.lit(0))).drop("_limit")


def raw_exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five tables in their export form: every column as text."""
    v = fixture_views(spark, sf_dir)
    return {
        "orders": orders_raw_view(v.orders),
        "payments": v.payments.selectExpr(*PAYMENTS_RAW_EXPR),
        "customers": v.customers.selectExpr(*CUSTOMERS_RAW_EXPR),
        "reviews": v.reviews.selectExpr(*REVIEWS_RAW_EXPR),
        "items": items_raw_view(_table(spark, sf_dir, "lineitem")),
    }


# Payment lines as an export with damage would hold them: some have a field too many (in
# front, where it would shift all others), some lack the last one.
DAMAGED_HEADER = "payment_value,payment_installments,payment_type,order_id"
DAMAGED_EXPR = (
    "CASE (l_orderkey * 7 + l_linenumber) % 101"
    " WHEN 7 THEN concat_ws(',', 'x', l_extendedprice, CAST(l_quantity AS INT), 'boleto', l_orderkey)"
    " WHEN 11 THEN concat_ws(',', l_extendedprice, CAST(l_quantity AS INT), 'boleto')"
    " ELSE concat_ws(',', l_extendedprice, CAST(l_quantity AS INT), 'boleto', l_orderkey) END AS line",
)


def damaged_payment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*DAMAGED_EXPR)
