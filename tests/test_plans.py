"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import pytest

from basketry.functions.position import running_sums
from basketry.operators import overview
from basketry.plans import registry
from basketry.sources import Views

from .conftest import MEDIUM, SMALL


# rate tables of a handful of rows against a range condition
NESTED_LOOPS: set[str] = set()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans as they are for large tables: no automatic broadcast, so only the
    explicit, size-bounded broadcast hints remain."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = {}
        for name, fn in registry.queries().items():
            if name in registry.MODEL_JOBS:
                continue
            out[name] = plan_of(fn(spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return out


def test_no_python_udf_in_sql_jobs(plans):
    for name, plan in plans.items():
        assert "EvalPython" not in plan and "PythonUDF" not in plan, name


def test_no_cartesian_product(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        for line in plan.splitlines():  # nested loops only over explicitly bounded sides
            if "NestedLoopJoin" in line:
                assert name in NESTED_LOOPS, (name, line)


def test_single_partition_steps_follow_an_aggregation(plans):
    """Rows go to a single partition only after a group-by, or as one row per task."""
    for name, plan in plans.items():
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" not in line:
                continue
            depth = len(line) - len(line.lstrip(" :+-"))
            below = [x for x in lines[i + 1 :] if len(x) - len(x.lstrip(" :+-")) > depth]
            assert any("Aggregate" in x or "TakeOrdered" in x or "LocalTableScan" in x or "LocalLimit" in x for x in below[:12]), (name, line)
        assert "Coalesce 1" not in plan, name


def test_person_ranking_is_limited_before_the_shuffle(spark):
    df = registry.queries()["return_gaps"](spark, SMALL)
    text = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_first_order_is_a_partial_aggregation(spark):
    df = registry.queries()["first_order_features"](spark, SMALL)
    text = df._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min_by" in text and "Window " not in text


def test_scan_reads_only_needed_columns(spark):
    df = registry.queries()["payment_method_summary"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in text.splitlines() if "lineitem" in line and "ReadSchema" in line]
    assert scan, text
    for col in ("l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate"):
        assert col not in scan[0]


def exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange ") or plan_of(df).count("Exchange ")


def test_filters_reach_the_scan(spark, tmp_path):
    """On a table with real columns the predicates are pushed to the scan."""
    rows = registry.fixture_views(spark, SMALL).orders.where("purchase_ts is not null")
    rows.write.parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    v = Views(orders=orders, customers=None, payments=None, reviews=None)
    pushed = lambda df: [x for x in plan_of(df).splitlines() if "PushedFilters" in x][0]
    assert "EqualTo(order_status,delivered)" in pushed(overview.late_rate_orders(v))
    assert "GreaterThanOrEqual(purchase_ts,1999-01-01" in pushed(overview.yoy_monthly(v))
    assert "GreaterThanOrEqual(purchase_ts,1998-03-01" in pushed(overview.monthly_order_trend(v, "1998-03"))
    assert "PushedFilters: []" not in pushed(overview.status_breakdown(v))


def test_rank_test_joins_once(plans):
    for name in ("mann_whitney_u", "mann_whitney_test"):
        assert plans[name].count("SortMergeJoin") == 1, plans[name]


def test_month_over_month_reads_once(plans):
    assert plans["month_over_month"].count("FileScan") == 1
    assert "Join" not in plans["month_over_month"]


def test_roc_and_standardisation_read_one_table(plans):
    # the cumulative counts: points, totals and origin
    assert plans["roc_curve_and_auc"].count("orders") == 0
    assert "Window" not in plans["standardize_features"]
