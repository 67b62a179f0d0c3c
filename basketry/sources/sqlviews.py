"""The input tables as SQL temporary views.

``SqlSession`` registers the tables of a ``Views`` bundle under fixed names, so that plain
SQL text runs on them beside the jobs. A registered view is a name for the lazy table:
nothing is copied, and predicates and column pruning reach the scan as they do for the
jobs. Names can carry a prefix, so several data sets live in one session; leaving the
block drops the names that it made. A name that is taken is refused unless
``replace=True``; tables absent from the bundle get no name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import Views

# The names of the registered tables.
NAMES = {
    "orders": "orders_tbl",
    "payments": "payments_tbl",
    "items": "items_tbl",
    "customers": "customers_tbl",
    "reviews": "reviews_tbl",
}


class SqlSession:
    def __init__(self, spark: SparkSession, views: Views, prefix: str = "", replace: bool = False):
        self.spark = spark
        self.names: dict[str, str] = {}
        tables = {t: getattr(views, t) for t in NAMES if getattr(views, t) is not None}
        wanted = {t: prefix + NAMES[t] for t in tables}
        taken = {t.name for t in spark.catalog.listTables() if t.isTemporary}
        if not replace and taken.intersection(wanted.values()):
            raise ValueError(f"views exist already: {sorted(taken.intersection(wanted.values()))}")
        for t, name in wanted.items():
            tables[t].createOrReplaceTempView(name)
            self.names[t] = name

    def sql(self, text: str, **args: object) -> DataFrame:
        """The result of a statement. ``:name`` parameters are bound to ``args``; ``{orders}``
        and so on stand for the registered names."""
        return self.spark.sql(text.format(**self.names), args=args or None)

    def close(self) -> None:
        for name in self.names.values():
            self.spark.catalog.dropTempView(name)
        self.names = {}

    def __enter__(self) -> SqlSession:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


#: Statements of the library's jobs as SQL text over the registered names.
STATEMENTS = {
    "customer_order_counts": """
        SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS total_orders
        FROM {orders} o JOIN {customers} c ON o.customer_id = c.customer_id
        WHERE o.order_status = 'delivered'
        GROUP BY c.customer_unique_id""",
    "installment_values": """
        SELECT CAST(payment_installments AS BIGINT) AS payment_installments, count(*) AS order_count,
               floor(avg(payment_value) * 100 + 0.5D) / 100 AS avg_value
        FROM {payments}
        WHERE payment_type = :payment_type AND payment_installments BETWEEN :low AND :high
        GROUP BY payment_installments""",
    "return_gaps": """
        WITH ranked AS (
          SELECT c.customer_unique_id, o.purchase_ts,
                 row_number() OVER (PARTITION BY c.customer_unique_id ORDER BY o.purchase_ts NULLS LAST, o.order_id) AS nth
          FROM {orders} o JOIN {customers} c ON o.customer_id = c.customer_id
          WHERE o.order_status = 'delivered'),
        pairs AS (
          SELECT customer_unique_id,
                 datediff(max(CASE WHEN nth = 2 THEN purchase_ts END), max(CASE WHEN nth = 1 THEN purchase_ts END)) AS gap
          FROM ranked WHERE nth <= 2 GROUP BY customer_unique_id)
        SELECT customer_unique_id, CAST(gap AS BIGINT) AS days_to_return FROM pairs WHERE gap > 0""",
}


def run_statement(spark: SparkSession, views: Views, name: str, prefix: str = "basketry_", **args: object) -> DataFrame:
    """A statement of ``STATEMENTS`` on ``views``. The plan is resolved against the tables
    before the names are dropped, so the result stays usable."""
    with SqlSession(spark, views, prefix, replace=True) as session:
        return session.sql(STATEMENTS[name], **args)
