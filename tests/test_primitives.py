"""Distributed primitives against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.functions.position import row_positions, running_sums
from basketry.functions.numeric import erfc, round_half_up
from basketry.functions.sampling import SAMPLE, SPLIT, seeded_mix
from basketry.operators.churn.sampling import undersample_majority
from basketry.functions.quantiles import exact_quantiles, inner_edges, quantile_edges, quantile_score
from basketry.functions.ranks import u_statistic
from basketry.operators.ranktest import mann_whitney_from_values


def test_running_sums_match_cumsum(spark):
    rnd = random.Random(7)
    rows = [(g, float(rnd.randint(0, 50)), rnd.randint(1, 9), i) for i, g in enumerate([rnd.randint(0, 2) for _ in range(2000)])]
    df = spark.createDataFrame(rows, "g int, k double, w int, id int")
    out = running_sums(df, ["k", "id"], {"cum": F.col("w").cast("bigint")}, partition_by=["g"], key="k", n_buckets=16)
    got = {r.id: r.cum for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["g", "k", "w", "id"]).sort_values(["g", "k", "id"])
    pdf["cum"] = pdf.groupby("g")["w"].cumsum()
    assert got == dict(zip(pdf["id"], pdf["cum"]))


def test_row_positions_are_a_permutation(spark):
    df = spark.range(5000).withColumn("key", (F.col("id") * 7919 % 1000).cast("double"))
    out = row_positions(df, ["key", "id"], key="key", n_buckets=32).collect()
    expected = sorted(range(5000), key=lambda i: (i * 7919 % 1000, i))
    assert [r.id for r in sorted(out, key=lambda r: r.position)] == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles_match_numpy(spark, seed):
    rnd = np.random.default_rng(seed)
    vals = np.round(rnd.gamma(2.0, 50.0, size=777), 2)
    vals[:100] = 12.5  # heavy tie
    df = spark.createDataFrame([(float(x),) for x in vals], "x double")
    probs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    got = {r.prob: r.value for r in exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert math.isclose(got[p], float(np.quantile(vals, p)), rel_tol=1e-12, abs_tol=1e-9)


def _qcut_expected(values):
    """pd.qcut(q=5, duplicates='drop') semantics on edges rounded to 6 dp.

    Rounding keeps floating noise in the interpolation position ((n - 1) * 0.6 is
    6.000000000000001 for n = 11) from creating a spurious extra bin.
    """
    edges = np.unique(np.round(np.quantile(np.array(values), [0, 0.2, 0.4, 0.6, 0.8, 1.0]), 6))
    if len(edges) < 2:
        return [1] * len(values)
    return list(pd.cut(pd.Series(values), bins=edges, labels=False, include_lowest=True).astype(int) + 1)


@pytest.mark.parametrize(
    "values",
    [
        [5.0] * 20,  # constant: one bin
        [1.0] * 97 + [2.0, 3.0, 4.0],  # edges collapse
        [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
        [float(x) for x in range(11)],
        [0.5, 0.5, 0.5, 1.0, 2.0, 2.0, 2.0, 3.0, 9.0, 9.0, 9.0],
    ],
)
def test_quantile_scores_match_qcut(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    edges = quantile_edges(df, "x").select(inner_edges(F.col("edges")).alias("inner"))
    got = df.crossJoin(edges).select("i", quantile_score(F.col("x"), F.col("inner")).alias("s")).collect()
    got = [r.s for r in sorted(got, key=lambda r: r.i)]
    assert got == _qcut_expected(values)
    if len(set(values)) > 1 and len(values) != 11:
        assert got == list(pd.qcut(pd.Series(values), q=5, labels=False, duplicates="drop").astype(int) + 1)


def test_random_quintile_scores_match_qcut(spark):
    rnd = np.random.default_rng(11)
    for _ in range(5):
        n = int(rnd.integers(6, 200))
        values = [float(x) for x in rnd.integers(0, 8, size=n)]
        if len(set(values)) == 1:
            continue
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
        edges = quantile_edges(df, "x").select(inner_edges(F.col("edges")).alias("inner"))
        got = df.crossJoin(edges).select("i", quantile_score(F.col("x"), F.col("inner")).alias("s")).collect()
        got = [r.s for r in sorted(got, key=lambda r: r.i)]
        assert got == _qcut_expected(values)


def _brute_u(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def test_u_statistic_against_brute_force(spark):
    rnd = random.Random(3)
    x = [rnd.randint(1, 5) for _ in range(20)]
    y = [rnd.randint(1, 5) for _ in range(10)]
    rows = [("x", float(v)) for v in x] + [("y", float(v)) for v in y]
    df = spark.createDataFrame(rows, "g string, v double")
    res = mann_whitney_from_values(df, "g", "v", "x", "y", with_p_value=True).first()
    assert res.u_stat == _brute_u(x, y)
    swapped = mann_whitney_from_values(df, "g", "v", "y", "x").first()
    assert swapped.u_stat == len(x) * len(y) - res.u_stat
    # tie-corrected normal approximation with continuity correction, by hand
    n1, n2, n = len(x), len(y), len(x) + len(y)
    t = pd.Series(x + y).value_counts().to_numpy()
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    z = (res.u_stat - n1 * n2 / 2 - 0.5) / sigma
    assert math.isclose(res.z_score, z, abs_tol=1e-6)
    assert math.isclose(res.p_value, 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=1e-9)


def test_u_statistic_all_tied_and_disjoint(spark):
    counts = spark.createDataFrame([(1.0, 4, 6)], "v double, cx bigint, cy bigint")
    r = u_statistic(counts, "v", "cx", "cy").first()
    assert r.u_stat == 12.0  # every pair tied: n1 n2 / 2
    counts = spark.createDataFrame([(1.0, 0, 6), (2.0, 4, 0)], "v double, cx bigint, cy bigint")
    assert u_statistic(counts, "v", "cx", "cy").first().u_stat == 24.0


def test_percentile_method_agrees_with_exact(spark):
    from basketry.functions.quantiles import quantile_edges_multi

    rnd = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rnd.integers(0, 40, 500).astype(float), "b": np.round(rnd.gamma(2, 30, 500), 2)})
    df = spark.createDataFrame(pdf)
    exact = quantile_edges_multi(df, ["a", "b"], method="exact").first()
    builtin = quantile_edges_multi(df, ["a", "b"], method="percentile").first()
    assert exact["a_edges"] == builtin["a_edges"] and exact["b_edges"] == builtin["b_edges"]


def test_all_equal_values_have_p_value_one(spark):
    df = spark.createDataFrame([("x", 3.0)] * 5 + [("y", 3.0)] * 4 + [("y", None)], "g string, v double")
    for bounded in (True, False):
        r = mann_whitney_from_values(df, "g", "v", "x", "y", with_p_value=True, bounded_domain=bounded).first()
        assert (r.n1, r.n2, r.u_stat, r.z_score, r.p_value, r.null_values_dropped) == (5, 4, 10.0, None, 1.0, 1)


def test_erfc_matches_the_library(spark):
    xs = [-8.0, -2.5, -0.7, -0.5, -0.3, -1e-9, 0.0, 1e-12, 0.2, 0.499, 0.5, 0.9, 2.0, 5.0, 12.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("e")).collect()
    for r in got:
        assert math.isclose(r.e, math.erfc(r.x), rel_tol=1e-13), (r.x, r.e, math.erfc(r.x))


def test_rounding_is_symmetric(spark):
    xs = [1.005, -1.005, 2.5, -2.5, -0.004, 0.0, -1.25]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_half_up("x", 1).alias("r")).collect()
    for r in got:
        assert r.r == math.copysign(math.floor(abs(r.x) * 10 + 0.5) / 10, r.x) and str(r.r) != "-0.0"


def _draw(spark, seed, purpose, n=2000, k=300):
    df = spark.range(n).withColumnRenamed("id", "i")
    return {r.i for r in df.orderBy(seeded_mix(df, "i", seed, purpose), "i").limit(k).collect()}


def test_seeds_and_purposes_give_unrelated_draws(spark):
    base = _draw(spark, 42, SAMPLE)
    assert base == _draw(spark, 42, SAMPLE)
    for other in (_draw(spark, 43, SAMPLE), _draw(spark, 1000, SAMPLE), _draw(spark, 42, SPLIT)):
        assert 20 < len(base & other) < 80  # 45 expected of 300


def test_seeded_mix_is_even_and_one_to_one(spark):
    df = spark.range(1 << 16).withColumnRenamed("id", "i")
    keys = df.select(seeded_mix(df, "i", 5, SPLIT).alias("k"))
    row = keys.agg(F.count_distinct("k").alias("n"), F.avg(F.col("k") / 2.0**31).alias("m")).first()
    assert row.n == 1 << 16 and abs(row.m - 0.5) < 0.01


def test_undersampling_one_class_gives_nothing(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)], "customer_unique_id bigint, label bigint")
    assert undersample_majority(df).count() == 0
