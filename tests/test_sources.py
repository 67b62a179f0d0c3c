"""CSV exports -> typed views: columns by header name, permissive casts."""

from __future__ import annotations

import datetime as dt
import tempfile
from pathlib import Path

import pytest

from basketry.operators import overview, payments
from basketry.sources.csv import read_csv_views, read_payments, read_reviews


def _write(folder: Path, name: str, text: str) -> str:
    path = folder / name
    path.write_text(text)
    return str(path)


def test_read_csv_views_by_header_name(spark):
    d = Path(tempfile.mkdtemp(prefix="basketry-csv-"))
    paths = {
        "orders": _write(d, "orders.csv", (
            "order_status,order_id,customer_id,order_purchase_timestamp,order_approved_at,"
            "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date,extra\n"
            "delivered,o1,c1,07-08-18 15:27,07-08-18 16:00,,10-08-18 09:00,12-08-18 00:00,x\n"
            "canceled,o2,c2,n/a,,,,,y\n"
        )),
        "payments": _write(d, "payments.csv", (
            "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
            "o1,1,credit_card,3,99.5\no1,2,voucher,1,0.5\no2,1,boleto,one,10\n"
        )),
        "customers": _write(d, "customers.csv", "customer_unique_id,customer_id,customer_city\nu1,c1,X\nu1,c2,Y\n"),
        "reviews": _write(d, "reviews.csv", "review_id,order_id,review_score\nr1,o1,5\nr2,o2,\n"),
    }
    v = read_csv_views(spark, paths)
    o = {r.order_id: r for r in v.orders.collect()}
    assert o["o1"].purchase_ts == dt.datetime(2018, 8, 7, 15, 27) and o["o1"].carrier_ts is None
    assert o["o2"].purchase_ts is None and o["o2"].order_status == "canceled"
    p = sorted(tuple(r) for r in v.payments.collect())
    assert p[1] == ("o1", "voucher", 1, 0.5) and p[2] == ("o2", "boleto", None, 10.0)  # bad int -> NULL
    assert {tuple(r) for r in v.customers.collect()} == {("c1", "u1"), ("c2", "u1")}
    assert {tuple(r) for r in v.reviews.collect()} == {("o1", 5), ("o2", None)}
    assert overview.late_rate_orders(v).first().late_orders == 0


def test_null_keys_follow_each_source_rule(views):
    v = views(
        orders=[(1, 1, None, "2020-01-01 10:00", None, None), (2, 1, "delivered", "2020-01-02 10:00", None, None)],
        payments=[(1, None, 1, 5.0), (2, "credit_card", 1, 7.0)],
    )
    # pandas-derived status breakdown drops the NULL status
    assert [r.order_status for r in overview.status_breakdown(v).collect()] == ["delivered"]
    # the SQL-derived payment summary keeps the NULL payment type as a group
    types = {r.payment_type for r in payments.payment_method_summary(v).collect()}
    assert types == {None, "credit_card"}


def test_quotes_commas_and_line_breaks(spark):
    d = Path(tempfile.mkdtemp(prefix="basketry-csv-"))
    text = (
        'review_comment_message,order_id,review_score\n'
        '"good ""really"", item",o1,5\n'
        '"first line\n second, ""more""",o2,4\n'
        '"",o3,\n'
    )
    rows = read_reviews(spark, _write(d, "reviews.csv", text)).collect()
    assert sorted(map(tuple, rows)) == [
        ("o1", 5, 'good "really", item'), ("o2", 4, 'first line\n second, "more"'), ("o3", None, None),
    ]


def test_a_file_with_another_header_fails(spark):
    d = Path(tempfile.mkdtemp(prefix="basketry-csv-"))
    _write(d, "a.csv", "order_id,payment_type,payment_installments,payment_value\no1,boleto,2,50.0\n")
    _write(d, "b.csv", "order_id,payment_type,payment_value,payment_installments\no2,boleto,50.0,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_payments(spark, str(d)).collect()
