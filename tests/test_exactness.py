"""Exact rank test, draws of any size, corners of the ROC curve, SQL text over the views."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.exactranks import arrangements_up_to, exact_applies, exact_tail
from basketry.functions.selection import smallest_rows
from basketry.operators import payments, ranktest, retention, rfm
from basketry.operators.churn import metrics
from basketry.plans import registry
from basketry.sources.fixtures import fixture_views
from basketry.sources.sqlviews import SqlSession, run_statement

from .conftest import SMALL


def _u_values(n1, n2):
    """U of every choice of n1 ranks."""
    return [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]


@pytest.mark.parametrize("n1,n2", [(1, 1), (1, 6), (2, 5), (5, 2), (3, 3), (4, 7), (6, 6), (8, 5)])
def test_exact_distribution_is_the_enumerated_one(n1, n2):
    us = _u_values(n1, n2)
    for u in range(n1 * n2 + 1):
        assert arrangements_up_to(u, n1, n2) == sum(x <= u for x in us)
        assert exact_tail(u, n1, n2) == sum(x >= u for x in us) / len(us)


def test_exact_distribution_with_one_large_sample():
    # the whole distribution adds up, and half of it lies on each side of the middle
    assert arrangements_up_to(8 * 400, 8, 400) == math.comb(408, 8)
    assert exact_tail(0, 8, 10**9) == 1.0
    assert abs(exact_tail(4 * 10**9, 8, 10**9) - 0.5) < 1e-6
    # n1 = 1: U is uniform on 0..n2
    assert exact_tail(10**8, 1, 10**9) == pytest.approx(1 - 10**8 / (10**9 + 1), rel=1e-12)


def test_rule_that_selects_the_exact_distribution():
    assert exact_applies(8, 500, False) and exact_applies(500, 8, False)
    assert not exact_applies(9, 9, False) and not exact_applies(3, 3, True) and not exact_applies(0, 3, False)


def test_rank_test_uses_the_exact_distribution_for_small_untied_samples(spark):
    x, y = [1.5, 4.0, 9.0, 7.0], [2.0, 3.0, 0.5, 8.0, 1.0]
    rows = [("x", v) for v in x] + [("y", v) for v in y]
    df = spark.createDataFrame(rows + [("y", None)], "g string, v double")
    u = sum(a > b for a in x for b in y)
    us = _u_values(4, 5)
    for bounded in (True, False):
        r = ranktest.mann_whitney_from_values(df, "g", "v", "x", "y", True, bounded, method="auto").first()
        assert (r.n1, r.n2, r.u_stat) == (4, 5, u)
        assert r.p_value == pytest.approx(sum(v >= u for v in us) / len(us), rel=1e-8)
    tied = spark.createDataFrame(rows + [("y", 4.0)], "g string, v double")
    auto = ranktest.mann_whitney_from_values(tied, "g", "v", "x", "y", True, method="auto").first()
    assert auto == ranktest.mann_whitney_from_values(tied, "g", "v", "x", "y", True).first()
    empty = ranktest.mann_whitney_from_values(df.limit(0), "g", "v", "x", "y", True, method="auto").first()
    assert empty.p_value is None
    with pytest.raises(ValueError):
        ranktest.mann_whitney_from_values(df, "g", "v", "x", "y", method="exact")


@pytest.mark.parametrize("bits", [31, 64])
def test_smallest_rows_of_any_number(spark, bits):
    rnd = random.Random(bits)
    low, high = (0, 2**31 - 1) if bits == 31 else (-(2**63), 2**63 - 1)
    # few keys with many ids each, and keys that differ in their last bits only
    keys = [rnd.randint(low, high) for _ in range(40)] + [12345, 12345, 12346, 12347] * 20
    rows = [(k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k bigint, id bigint").repartition(5)
    for n in (0, 1, 2, 39, 45, 60, 61, 100, len(rows) - 1, len(rows), len(rows) + 5):
        got = {(r.k, r.id) for r in smallest_rows(df, n, "k", "id", bits).collect()}
        assert got == set(sorted(rows)[:n]), n
    assert smallest_rows(df.limit(0), 3, "k", "id", bits).count() == 0


def test_half_of_all_persons_without_a_global_limit(spark):
    df = registry.queries()["rfm_sample_half"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan and "TakeOrdered" not in plan
    persons = registry.rfm_scores(spark, SMALL).count()
    assert df.count() == (persons + 1) // 2


def _corners(counts):
    """Thresholds kept by the rule: first, last, and those where a second difference isn't 0."""
    ordered = sorted(counts, reverse=True)
    tp = list(itertools.accumulate(counts[t][0] for t in ordered))
    fp = list(itertools.accumulate(counts[t][1] for t in ordered))
    keep = set()
    for i, t in enumerate(ordered):
        inner = 0 < i < len(ordered) - 1
        if not inner or tp[i + 1] - 2 * tp[i] + tp[i - 1] or fp[i + 1] - 2 * fp[i] + fp[i - 1]:
            keep.add(t)
    return keep


@pytest.mark.parametrize("bucket", [None, "floor(threshold * 8)", "0"])
def test_roc_corners(spark, bucket):
    rnd = random.Random(4)
    rows = []
    for g in ("a", "b"):
        for i in range(120):
            step = [(1, 0), (0, 1), (1, 0), (1, 1)][(i // 9) % 4]
            # runs of equal steps, over empty ranges, with scores below 1/4096 as well
            score = i / 120 if g == "a" else i / 1e7 + (0.9 if i > 70 else 0)
            rows += [(g, score, 1)] * step[0] + [(g, score, 0)] * step[1]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, score double, label int")
    expr = None if bucket is None else F.expr(bucket)
    got = metrics.roc_points(df, group_by=["g"], bucket=expr, drop_collinear=True).collect()
    full = {(r.g, r.threshold, r.fpr, r.tpr) for r in metrics.roc_points(df, group_by=["g"], bucket=expr).collect()}
    assert {(r.g, r.threshold, r.fpr, r.tpr) for r in got} <= full
    for g in ("a", "b"):
        counts = {}
        for h, s, y in rows:
            if h == g:
                c = counts.setdefault(s, [0, 0])
                c[0 if y else 1] += 1
        assert {r.threshold for r in got if r.g == g} == _corners(counts) | {math.inf}
        assert len(counts) > len(_corners(counts))


def test_roc_ranges_follow_the_scores(spark):
    # all scores below 1/4096: still spread over many ranges
    df = spark.range(5000).selectExpr("id / 1e9 AS score", "CAST(id % 2 AS INT) AS label")
    cum = metrics._cumulative(df, "score", "label", (), None)
    assert cum.groupBy("_range").count().agg(F.max("count")).first()[0] < 500


def test_sql_text_equals_the_jobs(spark):
    v = fixture_views(spark, SMALL)
    names = {"customer_order_counts": retention.customer_order_counts, "return_gaps": retention.return_gaps}
    for name, job in names.items():
        want = job(v)
        got = run_statement(spark, v, name).select(want.columns)
        assert sorted(got.collect()) == sorted(want.collect())
    got = run_statement(spark, v, "installment_values", payment_type="boleto", low=2, high=3)
    assert {r.payment_installments for r in got.collect()} == {2, 3}
    assert payments.payment_method_summary(v).where("payment_type = 'boleto'").count() == 1


def test_sql_session_names(spark):
    v = fixture_views(spark, SMALL)
    with SqlSession(spark, v, "t_") as s:
        assert set(s.names) == {"orders", "payments", "customers", "reviews"}  # no items in this bundle
        assert s.sql("SELECT count(*) AS n FROM {orders} WHERE order_status = :s", s="delivered").first().n > 0
        pushed = s.sql("SELECT payment_type FROM t_payments_tbl WHERE payment_value > 5")
        assert "l_tax" not in pushed._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ValueError):
            SqlSession(spark, v, "t_")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("t_")]
