"""Job parameters (the dashboard's controls) on the benchmark data."""

from __future__ import annotations

import datetime as dt

import pytest

from basketry.operators import delivery, overview, payments, retention
from basketry.sources.fixtures import fixture_views

from .conftest import MEDIUM


def test_month_range_filters_the_trend(spark):
    v = fixture_views(spark, MEDIUM)
    full = {r.month: r.order_count for r in overview.monthly_order_trend(v).collect()}
    part = {r.month: r.order_count for r in overview.monthly_order_trend(v, "1996-03", "1996-05").collect()}
    assert set(part) == {dt.date(1996, 3, 1), dt.date(1996, 4, 1), dt.date(1996, 5, 1)}
    assert all(part[m] == full[m] for m in part)
    mom = overview.month_over_month(v, "1996-03", "1996-05").collect()
    assert {r.month for r in mom} == set(part)
    for r in mom:
        assert r.prev_order_count == full[dt.date(r.month.year - (r.month.month == 1), (r.month.month - 2) % 12 + 1, 1)]


def test_status_filter_is_applied_before_shares(spark):
    v = fixture_views(spark, MEDIUM)
    late_only = delivery.score_distribution(v, statuses=("Late",)).collect()
    assert {r.delivery_status for r in late_only} == {"Late"}
    assert abs(sum(r.pct for r in late_only) - 100.0) < 0.05


def test_installment_range_and_sort(spark):
    v = fixture_views(spark, MEDIUM)
    rows = payments.installment_profile(v, 3, 5).collect()
    assert [r.payment_installments for r in rows] == [3, 4, 5]
    by_revenue = payments.payment_method_summary(v, sort_by="total_revenue").collect()
    assert [r.total_revenue for r in by_revenue] == sorted((r.total_revenue for r in by_revenue), reverse=True)
    assert abs(sum(r.pct_of_orders for r in by_revenue) - 100.0) < 0.3


def test_clip_and_bins(spark):
    v = fixture_views(spark, MEDIUM)
    hist = retention.return_gap_histogram(v, clip_days=90).collect()
    stats = retention.return_gap_stats(v, clip_days=90).first()
    assert sum(r.customers for r in hist) == stats.within_clip
    assert len(hist) <= 40 and all(r.bin_end - r.bin_start == hist[0].bin_end - hist[0].bin_start for r in hist)
    curve = retention.cumulative_return_curve(v, max_days=100).collect()
    assert max(r.days for r in curve) <= 100
    assert len(curve) == sum(1 for r in retention.return_gaps(v).collect() if r.days_to_return <= 100)


def test_out_of_range_parameters_raise(views):
    v = views(payments=[(1, "credit_card", 1, 5.0)])
    for bad in ({"max_tier": 24}, {"min_tier": 0}, {"min_tier": 5, "max_tier": 4}):
        with pytest.raises(ValueError):
            payments.installment_profile(v, **bad)
    with pytest.raises(ValueError):
        overview.yoy_monthly(v, last_month=13)
