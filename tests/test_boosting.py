"""Boosted trees with exact splits against a plain implementation, and saved models."""

from __future__ import annotations

import math
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry.functions.workspace import Workspace
from basketry.operators.churn import boosting, models, saved
from basketry.operators.churn.features import FEATURES

ROOT = str(Path(__file__).resolve().parents[1])


def plain_fit(rows, features, rounds, depth, step, used, weights):
    """The same trees by looping over every cut of every feature."""
    y = [r["label"] for r in rows]
    total, ones = sum(weights), sum(w for w, v in zip(weights, y, strict=True) if v)
    start = math.log(ones / (total - ones))
    margin = [start] * len(rows)
    trees = []

    def grow(part, residual, hessian, level):
        best = None
        if level < depth:
            for i, f in enumerate(features):
                values = sorted({rows[k][f] for k in part})
                for a, b in zip(values, values[1:], strict=False):
                    left = [k for k in part if rows[k][f] <= a]
                    right = [k for k in part if rows[k][f] > a]
                    wl, wr = sum(weights[k] for k in left), sum(weights[k] for k in right)
                    ml = sum(weights[k] * residual[k] for k in left) / wl
                    mr = sum(weights[k] * residual[k] for k in right) / wr
                    gain = wl * wr / (wl + wr) * (ml - mr) ** 2
                    if gain > 1e-12 and (best is None or (-round(gain, 9), i, a) < best[0]):
                        best = ((-round(gain, 9), i, a), f, (a + b) / 2, left, right, gain)
        if best is None:
            h = sum(weights[k] * hessian[k] for k in part)
            return ("leaf", step * sum(weights[k] * residual[k] for k in part) / h if h else 0.0)
        _, f, cut, left, right, gain = best
        return ("split", f, cut, gain, grow(left, residual, hessian, level + 1), grow(right, residual, hessian, level + 1))

    def value(tree, row):
        while tree[0] == "split":
            tree = tree[4] if row[tree[1]] <= tree[2] else tree[5]
        return tree[1]

    for r in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        residual = [v - q for v, q in zip(y, p, strict=True)]
        hessian = [q * (1 - q) for q in p]
        tree = grow([k for k in range(len(rows)) if used[r][k]], residual, hessian, 0)
        trees.append(tree)
        margin = [m + value(tree, row) for m, row in zip(margin, rows, strict=True)]
    return start, trees, margin


def shape(node):
    if node.feature is None:
        return ("leaf", pytest.approx(node.value, abs=1e-9))
    return ("split", node.feature, pytest.approx(node.threshold), pytest.approx(node.gain, abs=1e-9), shape(node.left), shape(node.right))


def data(n=160, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = round(r.uniform(-5, 300), 2), r.randint(1, 5), r.choice([0, 1])
        odds = 0.02 * a - 0.8 * b + (1.5 if c and b > 2 else 0)
        rows.append({"id": i, "a": a, "b": b, "c": c, "label": int(r.random() < 1 / (1 + math.exp(-odds))), "w": r.choice([0.5, 1.0, 2.5])})
    return rows


@pytest.mark.parametrize("subsample,weight", [(1.0, None), (0.7, "w")])
def test_trees_are_those_of_a_plain_search(spark, subsample, weight):
    rows = data()
    df = spark.createDataFrame(rows, "id bigint, a double, b int, c int, label int, w double").repartition(3)
    features, rounds = ("a", "b", "c"), 3
    with Workspace(spark) as work:
        got = boosting.fit_boosted_trees(df, features, work, "id", weight=weight, rounds=rounds, depth=3, step=0.3, subsample=subsample)
    used = []
    for i in range(rounds):
        part = df.filter(boosting.drawn(F.col("id"), 42, i, subsample)) if subsample < 1 else df
        ids = {x["id"] for x in part.collect()}
        used.append([k in ids for k in range(len(rows))])
    weights = [x[weight] if weight else 1.0 for x in rows]
    start, trees, margin = plain_fit(rows, features, rounds, 3, 0.3, used, weights)
    assert got.start == pytest.approx(start)
    assert [shape(t) for t in got.trees] == trees
    scored = {x["id"]: x["score"] for x in got.score(df).collect()}
    assert scored == {k: pytest.approx(1 / (1 + math.exp(-m))) for k, m in enumerate(margin)}
    shares = got.importances()
    assert sum(shares.values()) == pytest.approx(1) and all(x >= 0 for x in shares.values())


def test_odd_training_rows(spark):
    schema = "id bigint, a double, b int, label int"
    with Workspace(spark) as work:
        one = boosting.fit_boosted_trees(spark.createDataFrame([(1, 1.0, 2, 1), (2, 2.0, 2, 1)], schema), ("a", "b"), work, "id", rounds=2)
        none = boosting.fit_boosted_trees(spark.createDataFrame([], schema), ("a", "b"), work, "id", rounds=2)
        rows = [(i, None if i == 3 else 1.0, 2, i % 2) for i in range(10)]
        flat = boosting.fit_boosted_trees(spark.createDataFrame(rows, schema), ("a", "b"), work, "id", rounds=2, subsample=1.0)
        assert one.trees == none.trees == []
        assert [t.feature for t in flat.trees] == [None, None]  # constant features: nothing to split
        assert flat.score(spark.createDataFrame(rows, schema)).count() == 9


@pytest.fixture(scope="module")
def fitted(spark):
    rows, r = [], random.Random(5)
    for i in range(400):
        x = (round(r.uniform(10, 500), 2), r.randint(1, 10), r.randint(1, 5), r.randint(0, 1), r.randint(-20, 20), r.randint(1, 12))
        repeat = int(r.random() < 1 / (1 + math.exp(3.5 - 0.006 * x[0] - 0.3 * x[2])))
        rows.append((i, *x, repeat))
    types = ", ".join(f"{f} {t}" for f, t in zip(FEATURES, ("double", "int", "int", "int", "int", "int"), strict=True))
    features = spark.createDataFrame(rows, f"customer_unique_id bigint, {types}, label int")
    return features, models.fit_churn_models(features, gbt_rounds=5)


def test_saved_models_score_as_the_fitted_ones_in_another_session(spark, fitted):
    features, cm = fitted
    with Workspace(spark) as work:
        path = saved.save_models(cm, work.path("models"))
        loaded = saved.load_models(spark, path)
        assert tuple(loaded.pipelines) == models.MODEL_ORDER
        before = {(r["model"], r["customer_unique_id"]): r["score"] for r in models.test_predictions(cm).collect()}
        profiles = cm.test.select("customer_unique_id", *FEATURES)
        for name in models.MODEL_ORDER:
            for r in loaded.score(name, profiles).collect():
                assert r["score"] == pytest.approx(before.pop((name, r["customer_unique_id"])), abs=1e-12)
        assert not before
        mine = {r["customer_unique_id"]: tuple(r) for r in models.score_profiles(cm, features).collect()}
        theirs = {r["customer_unique_id"]: tuple(r) for r in loaded.score_profiles(features).collect()}
        assert mine == theirs
        assert [s.__class__.__name__ for s in loaded.pipelines[models.LR_WEIGHTED].stages] == [
            "SQLTransformer", "VectorAssembler", "LogisticRegressionModel",
        ]
        with pytest.raises(ValueError):
            loaded.score(models.LR_WEIGHTED, profiles.withColumn("score", F.lit(1)))

        profiles.write.parquet(work.root + "/profiles")
        code = (
            f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from basketry.session import build_session\n"
            "from basketry.operators.churn import models, saved\n"
            "spark = build_session('local[2]')\n"
            f"got = saved.load_models(spark, {path!r}).score(models.LR_WEIGHTED, spark.read.parquet({work.root + '/profiles'!r}))\n"
            "print('TOTAL', repr(sum(r['score'] for r in got.orderBy('customer_unique_id').collect())))\n"
        )
        run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        total = float(run.stdout.split("TOTAL ")[1])
        own = sum(r["score"] for r in loaded.score(models.LR_WEIGHTED, profiles).orderBy("customer_unique_id").collect())
        assert total == pytest.approx(own, abs=1e-9)
