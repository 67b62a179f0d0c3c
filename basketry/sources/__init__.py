"""Typed inputs of the analytics jobs.

Every job takes a ``Views`` bundle: the four tables the analytics read, with the
library's column names:

* ``orders``: order_id, customer_id, order_status, purchase_ts, delivered_ts,
  estimated_ts (timestamps are ``timestamp_ntz``; approval and carrier dates may
  be present and are never used)
* ``customers``: customer_id, customer_unique_id (one person, many ids)
* ``payments``: order_id, payment_type, payment_installments, payment_value
* ``reviews``: order_id, review_score

``sources.csv`` reads them from the day-first CSV exports, ``sources.fixtures``
derives them from the benchmark tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Views:
    orders: DataFrame
    customers: DataFrame
    payments: DataFrame
    reviews: DataFrame
    items: DataFrame | None = None
