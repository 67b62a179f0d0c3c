from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from basketry.session import build_session  # noqa: E402
from basketry.sources import Views  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, app="basketry-tests")
    yield s
    s.stop()


def ts(text: str | None):
    return None if text is None else dt.datetime.fromisoformat(text)


ORDERS_SCHEMA = (
    "order_id bigint, customer_id bigint, order_status string, purchase_ts timestamp_ntz, "
    "delivered_ts timestamp_ntz, estimated_ts timestamp_ntz"
)


def make_views(spark, orders=(), customers=(), payments=(), reviews=()) -> Views:
    """Views from inline rows.

    orders: (order_id, customer_id, status, purchase, delivered, estimated) with ISO text times
    customers: (customer_id, person); payments: (order_id, type, installments, value);
    reviews: (order_id, score)
    """
    o = [(a, b, c, ts(d), ts(e), ts(f)) for a, b, c, d, e, f in orders]
    return Views(
        orders=spark.createDataFrame(o, ORDERS_SCHEMA),
        customers=spark.createDataFrame(list(customers), "customer_id bigint, customer_unique_id bigint"),
        payments=spark.createDataFrame(
            list(payments), "order_id bigint, payment_type string, payment_installments int, payment_value double"
        ),
        reviews=spark.createDataFrame(list(reviews), "order_id bigint, review_score int"),
    )


@pytest.fixture
def views(spark):
    return lambda **kw: make_views(spark, **kw)
