"""Every job with an oracle statement equals DuckDB on the smallest data set."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from basketry.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    res = duck.execute(ORACLE[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    s_rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)


def test_every_job_registered_with_survey_key():
    keys = set(registry.queries())
    survey = {
        "csv_ingest", "parse_order_timestamps", "kpi_summary", "late_rate_orders", "monthly_order_trend",
        "peak_and_growth", "month_over_month", "yoy_monthly", "yoy_pivot", "status_breakdown",
        "payment_method_summary", "payment_type_share", "installment_profile", "installment_contrast",
        "delivery_facts", "delivery_status_summary", "score_distribution", "lateness_buckets",
        "lateness_bucket_contrast", "mann_whitney_u", "customer_order_counts", "purchase_frequency",
        "return_gaps", "return_gap_stats", "return_gap_histogram", "cumulative_return_curve",
        "return_milestones", "rfm_base", "rfm_scores", "rfm_segments", "rfm_segment_summary",
        "rfm_segment_coverage", "rfm_sample", "first_order_features", "label_balance", "stratified_split",
        "class_weights", "undersample_majority", "standardize_features", "churn_logistic",
        "churn_boosted_trees", "roc_curve_and_auc", "classification_metrics", "model_comparison",
        "score_profiles",
    }
    assert survey <= keys


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["segment", "customers", "avg_recency", "avg_frequency", "avg_monetary", "pct_of_base"]
    assert sum(r["customers"] for r in rows) > 0
