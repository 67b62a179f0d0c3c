"""One small inline case per semantic trap."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from basketry.functions.dates import calendar_days, parse_day_first
from basketry.operators import delivery, payments, retention, rfm
from basketry.operators.churn import features as churn_features
from basketry.operators.churn import sampling

D = "delivered"


def test_day_first_parsing_and_two_digit_years(spark):
    rows = [
        ("07-08-18 15:27", dt.datetime(2018, 8, 7, 15, 27)),
        ("7-8-18 9:05", dt.datetime(2018, 8, 7, 9, 5)),
        ("31-12-68 00:00", dt.datetime(2068, 12, 31)),
        ("31-12-69 00:00", dt.datetime(1969, 12, 31)),
        ("01-03-95 10:00", dt.datetime(1995, 3, 1, 10)),
        ("07-08-18 15:27:00", None),
        ("2018-08-07 15:27:00", None),
        ("32-01-18 00:00", None),
        ("n/a", None),
        (None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = [r[0] for r in df.select(parse_day_first("s")).collect()]
    assert got == [r[1] for r in rows]


def test_calendar_days_counts_midnights(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 2, 1)), (dt.datetime(2020, 1, 1, 1), dt.datetime(2020, 1, 1, 23))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert [r[0] for r in df.select(calendar_days("b", "a")).collect()] == [1, 0]


def _lateness_views(views):
    return views(
        orders=[
            # late by hours on the due day: Late, 0 days, on-time bucket
            (1, 1, D, "2020-01-01 10:00", "2020-01-10 15:00", "2020-01-10 00:00"),
            # 23:00 -> 01:00 next day: 1 day late
            (2, 1, D, "2020-01-01 10:00", "2020-01-11 01:00", "2020-01-10 23:00"),
            # early
            (3, 2, D, "2020-01-01 10:00", "2020-01-05 12:00", "2020-01-10 00:00"),
            # missing estimate: dropped
            (4, 2, D, "2020-01-01 10:00", "2020-01-05 12:00", None),
            # delivered before purchase: in facts, not in buckets
            (5, 3, D, "2020-01-05 10:00", "2020-01-04 12:00", "2020-01-10 00:00"),
            # not delivered: dropped
            (6, 3, "shipped", "2020-01-01 10:00", "2020-01-20 12:00", "2020-01-10 00:00"),
        ],
        reviews=[(1, 2), (2, 1), (2, 3), (3, 5), (4, 5), (5, 4), (6, 1)],
    )


def test_late_flag_and_days_late_are_separate(views):
    v = _lateness_views(views)
    facts = {(r.order_id, r.review_score): r for r in delivery.delivery_facts(v).collect()}
    assert facts[(1, 2)].delivery_status == "Late" and facts[(1, 2)].days_late == 0
    assert facts[(2, 1)].days_late == 1 and facts[(2, 3)].days_late == 1  # two reviews -> two rows
    assert facts[(3, 5)].delivery_status == "On Time" and facts[(3, 5)].days_late < 0
    assert (4, 5) not in facts and (6, 1) not in facts
    assert (5, 4) in facts


def test_buckets_drop_delivery_before_purchase(views):
    v = _lateness_views(views)
    b = {r.bucket_rank: r for r in delivery.lateness_buckets(v).collect()}
    assert b[1].order_count == 2  # orders 1 (late, 0 days) and 3 (early)
    assert b[2].order_count == 2  # order 2 twice
    assert sum(r.order_count for r in b.values()) == 4  # order 5 excluded here only
    assert b[1].lateness_bucket.startswith("0")


def test_late_rate_has_two_denominators(views):
    from basketry.operators import overview

    v = _lateness_views(views)
    orders_rate = overview.late_rate_orders(v).first()
    assert (orders_rate.late_orders, orders_rate.delivered_orders) == (2, 4)
    summary = {r.delivery_status: r for r in delivery.delivery_status_summary(v).collect()}
    assert summary["Late"].order_count == 3  # over order x review rows
    assert summary["Late"].late_pct == 60.0


def _repeat_views(views):
    return views(
        orders=[
            # person 10: two ids, tied first timestamps (order id breaks the tie), NULL time last
            (1, 100, D, "2020-01-01 10:00", None, None),
            (2, 101, D, "2020-01-01 10:00", None, None),
            (3, 100, D, None, None, None),
            (4, 101, D, "2020-03-01 09:00", None, None),
            # person 20: same-day repeat (gap 0) -> returning but no gap
            (5, 200, D, "2020-02-01 08:00", None, None),
            (6, 200, D, "2020-02-01 20:00", None, None),
            # person 30: one order; person 40: not delivered
            (7, 300, D, "2020-02-01 08:00", None, None),
            (8, 400, "canceled", "2020-06-01 08:00", None, None),
        ],
        customers=[(100, 10), (101, 10), (200, 20), (300, 30), (400, 40)],
        payments=[(1, "credit_card", 1, 10.0), (2, "boleto", 1, 5.0), (4, "credit_card", 3, 7.5),
                  (5, "voucher", 1, 1.0), (8, "credit_card", 1, 99.0)],
        reviews=[(1, 5), (1, 3)],
    )


def test_return_gaps_tie_break_and_same_day(views):
    v = _repeat_views(views)
    counts = {r.customer_unique_id: r.total_orders for r in retention.customer_order_counts(v).collect()}
    assert counts == {10: 4, 20: 2, 30: 1}
    gaps = {r.customer_unique_id: r.days_to_return for r in retention.return_gaps(v).collect()}
    # person 10: first = order 1, second = order 2 (same time, higher id) -> 0 days -> dropped
    assert gaps == {}
    freq = {r.segment: r.customers for r in retention.purchase_frequency(v).collect()}
    assert freq == {"One-time": 1, "Returning": 2}


def test_rfm_needs_payment_and_uses_global_reference(views):
    v = _repeat_views(views)
    base = {r.customer_unique_id: r for r in rfm.rfm_base(v).collect()}
    assert set(base) == {10, 20}  # person 30 has no payment row
    # reference date is the latest purchase over all orders (the canceled one, 2020-06-01)
    assert base[10].recency_days == (dt.date(2020, 6, 1) - dt.date(2020, 3, 1)).days
    assert base[10].frequency == 3 and base[10].monetary == 22.5


def test_first_order_features_defaults(views):
    v = _repeat_views(views)
    f = {r.customer_unique_id: r for r in churn_features.first_order_features(v).collect()}
    assert f[10].review_score == 4.0  # two reviews averaged
    assert f[20].review_score == 3.0  # no review -> neutral
    assert f[10].label == 1
    assert f[20].label == 0  # the second order has no payment row, so it does not count
    assert f[10].purchase_month == 1 and f[10].is_credit_card == 1
    assert 30 not in f


def test_installments_count_rows_and_weight_rounded_averages(views):
    v = views(
        payments=[(1, "credit_card", 1, 10.0), (1, "credit_card", 1, 20.0), (2, "credit_card", 6, 10.004),
                  (3, "credit_card", 6, 10.004), (4, "credit_card", 12, 20.0), (5, "credit_card", 13, 1.0),
                  (6, "credit_card", 0, 1.0), (7, "boleto", 1, 3.0)],
    )
    prof = {r.payment_installments: r for r in payments.installment_profile(v).collect()}
    assert set(prof) == {1, 6, 12} and prof[1].order_count == 2 and prof[6].avg_value == 10.0
    c = payments.installment_contrast(v).first()
    assert c.pct_single_installment == 40.0
    assert c.avg_value_6_plus == 13.33  # from the rounded tier means (13.34 from raw values)
    pm = {r.payment_type: r.order_count for r in payments.payment_method_summary(v).collect()}
    assert pm["credit_card"] == 6  # distinct orders, not rows


def test_potential_loyalists_rule(spark):
    import itertools

    df = spark.createDataFrame(list(itertools.product(range(1, 6), repeat=3)), "r int, f int, m int")
    out = df.select("r", "f", "m", rfm.segment_of(F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()
    for row in out:
        assert (row.s == rfm.POTENTIAL) == (row.r == 3 and row.f <= 2)
    assert {row.s for row in out} == set(rfm.SEGMENTS)


def test_majority_class_found_from_data(spark):
    rows = [(i, 1 if i % 10 else 0) for i in range(1, 101)]  # 90 % class 1
    df = spark.createDataFrame(rows, "customer_unique_id bigint, label bigint")
    out = sampling.undersample_majority(df)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 10, 1: 10}
    w = {r.label: r.weight for r in sampling.class_weights(df).select("label", "weight").distinct().collect()}
    assert w == {0: 100 / 20, 1: 100 / 180}


def test_split_is_stratified_disjoint_and_complete(spark):
    rows = [(i, 1 if i % 4 else 0) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "customer_unique_id bigint, label bigint")
    out = sampling.stratified_split(df).collect()
    assert len(out) == 1000 and len({r.customer_unique_id for r in out}) == 1000
    test = [r for r in out if r.split == "test"]
    assert sum(1 for r in test if r.label == 1) == 150 and sum(1 for r in test if r.label == 0) == 50


def test_parse_ignores_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("10-03-24 02:30",)], "s string")  # inside the DST gap there
        assert df.select(parse_day_first("s")).first()[0] == dt.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_export_text_ignores_session_time_zone(spark):
    from basketry.sources.fixtures import orders_raw_view

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:  # 1998-10-11 00:00 does not exist there (clocks jumped to 01:00)
        df = spark.createDataFrame(
            [(3, 1, "delivered", dt.datetime(1998, 10, 11, 0, 0), None, dt.datetime(1998, 10, 11, 0, 0))],
            "order_id bigint, customer_id bigint, order_status string, purchase_ts timestamp_ntz, "
            "delivered_ts timestamp_ntz, estimated_ts timestamp_ntz",
        )
        row = orders_raw_view(df).first()
        assert row.order_purchase_timestamp == "11-10-98 00:00"
        assert row.order_estimated_delivery_date == "11-10-98 00:00"
        assert row.order_delivered_customer_date is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
