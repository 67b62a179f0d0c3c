"""Property tests: distributed primitives equal a sort-based brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.position import running_sums
from basketry.functions.quantiles import exact_quantiles
from basketry.operators.churn.metrics import auc

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

rows = st.lists(
    st.tuples(st.integers(0, 2), st.integers(-20, 20), st.integers(1, 5)), min_size=1, max_size=80
)


@SETTINGS
@given(rows)
def test_running_sums_property(spark, data):
    pdf = pd.DataFrame(data, columns=["g", "k", "w"]).reset_index().rename(columns={"index": "id"})
    df = spark.createDataFrame(pdf[["id", "g", "k", "w"]].values.tolist(), "id bigint, g bigint, k bigint, w bigint")
    out = running_sums(df, ["k", "id"], {"cum": F.col("w")}, partition_by=["g"], n_buckets=4)
    got = {r.id: r.cum for r in out.collect()}
    pdf = pdf.sort_values(["g", "k", "id"])
    pdf["cum"] = pdf.groupby("g")["w"].cumsum()
    assert got == dict(zip(pdf["id"], pdf["cum"]))


@SETTINGS
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60))
def test_exact_quantiles_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.2, 0.5, 0.8, 1.0]
    got = {r.prob: r.value for r in exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert abs(got[p] - float(np.quantile(np.array(values, dtype=float), p))) < 1e-9


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=2, max_size=60))
def test_auc_property(spark, data):
    df = spark.createDataFrame([(float(s), y) for s, y in data], "score double, label bigint")
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    got = auc(df).first().auc
    if not pos or not neg:
        assert got is None
    else:
        brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got - brute) < 1e-12
