"""Model sanity on synthetic data and metric edge cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from basketry.functions.memo import Memo
from basketry.operators.churn import checks, metrics
from basketry.operators.churn import models as M
from basketry.operators.churn.features import FEATURES
from basketry.plans import registry

from .conftest import SMALL


def _synthetic(spark, n=600, signal=True, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        label = 1 if rnd.random() < 0.7 else 0
        base = 3.0 if (signal and label) else 0.0
        rows.append((i, round(100 + 50 * base + rnd.gauss(0, 10), 2), rnd.randint(1, 12), float(rnd.randint(1, 5)),
                     rnd.randint(0, 1), rnd.randint(0, 10), rnd.randint(1, 12), label))
    schema = ("customer_unique_id bigint, payment_value double, payment_installments bigint, review_score double, "
              "is_credit_card bigint, days_late bigint, purchase_month bigint, label bigint")
    return spark.createDataFrame(rows, schema)


def test_separable_data_reaches_high_auc(spark):
    cm = M.fit_churn_models(_synthetic(spark), gbt_rounds=10)
    cmp = {r.model: r for r in M.model_comparison(cm).collect()}
    assert set(cmp) == set(M.MODEL_ORDER)
    assert all(r.roc_auc > 0.9 for r in cmp.values())
    assert sum(r.is_best for r in cmp.values()) == 1
    imp = M.feature_importance(cm, spark).collect()
    assert imp[0].feature == "payment_value" and abs(sum(r.importance for r in imp) - 1.0) < 1e-9
    prof = M.score_profiles(cm, _synthetic(spark, n=20)).collect()
    assert all(abs(r.repeat_probability + r.churn_probability - 1) < 1e-12 for r in prof)
    assert all(r.likely_to_return == (r.repeat_probability >= 0.4) for r in prof)
    assert set(FEATURES) <= set(prof[0].asDict())


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([(0.3, 1, 0), (0.3, 0, 0), (0.3, 1, 0)], "score double, label bigint, prediction bigint")
    cells = metrics.classification_metrics(df).collect()
    assert len(cells) == 4 and {r.precision for r in cells} == {0.0} and {r.f1 for r in cells} == {0.0}
    auc = metrics.auc(df).first().auc
    assert auc == 0.5  # every score tied
    single = df.where(F.col("label") == 1)
    assert metrics.auc(single).first().auc is None


def test_roc_curve_ends_at_one_and_matches_auc(spark):
    rnd = random.Random(9)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label bigint")
    pts = sorted(((r.fpr, r.tpr) for r in metrics.roc_points(df).collect()))
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))
    assert abs(area - metrics.auc(df).first().auc) < 1e-9


def test_a_missing_feature_does_not_stop_training(spark):
    month = F.when(F.col("customer_unique_id") % 50 == 3, None).otherwise(F.col("purchase_month"))
    rows = _synthetic(spark, n=200).withColumn("purchase_month", month)
    cm = M.fit_churn_models(rows, gbt_rounds=2)
    held = cm.test.count()
    assert M.test_predictions(cm).groupBy("model").count().select("count").distinct().collect()[0][0] == held > 0
    assert M.score_profiles(cm, rows).count() == 196


def test_comparison_checks_count_ranks_and_not_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(m, i, int(rnd.random() < 0.4), rnd.randint(0, 6) / 6) for m in ("a", "b") for i in range(90)]
    preds = spark.createDataFrame(rows, "model string, person int, label int, score double")
    preds = preds.withColumn("prediction", (F.col("score") > 0.5).cast("int"))

    def area(m):
        yes, no = ([x[3] for x in rows if x[0] == m and x[2] == y] for y in (1, 0))
        return sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))

    said = [(m, round(area(m) + off, 3), 0.0, 0.0, 0.0) for m, off in (("a", 0.0), ("b", 0.01))]
    table = spark.createDataFrame(said, "model string, roc_auc double, precision double, recall double, f1 double")
    monkeypatch.setattr(checks, "test_predictions", lambda cm: preds)
    monkeypatch.setattr(checks, "model_comparison", lambda cm, digits: table)
    joined = []
    join = type(preds).join
    monkeypatch.setattr(type(preds), "join", lambda a, b, *on, **kw: joined.append(set(a.columns) | set(b.columns)) or join(a, b, *on, **kw))
    got = {r["model"]: r["auc_agrees"] for r in checks.comparison_checks(None).collect()}
    assert got == {"a": True, "b": False}
    assert not any({"a", "b"} <= columns for columns in joined)  # scores of one label beside those of the other


def test_a_job_fits_the_models_it_reads(spark, monkeypatch):
    def refuse(self, rows):
        raise AssertionError("a boosted model was fitted")

    monkeypatch.setattr(registry, "_HELD", Memo())
    monkeypatch.setattr(registry, "GBT_ROUNDS", 2)
    with monkeypatch.context() as m:
        m.setattr(M.GBTClassifier, "fit", refuse)
        assert {r.gradient_vanishes for r in registry.queries()["churn_logistic_optimum"](spark, SMALL).collect()} == {True}
        logistic = registry.queries()["churn_logistic"](spark, SMALL).collect()
    fitted = []
    fit = M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, rows: fitted.append(self) or fit(self, rows))
    assert registry.queries()["churn_feature_importance"](spark, SMALL).count() == len(FEATURES)
    assert len(fitted) == 1
    rows = registry.queries()["churn_test_rows"](spark, SMALL).collect()  # reads all four, fits the one that is missing
    assert len(fitted) == 2 and len(rows) == 2 * len(logistic) and {r.model for r in rows} == set(M.MODEL_ORDER)


def test_training_rows_come_in_parts_by_their_number(spark):
    rows = _synthetic(spark).repartition(30)
    cm = M.fit_churn_models(rows, gbt_rounds=1)
    assert {r.rdd.getNumPartitions() for r, _, _ in cm.training.values()} == {1}
    parted = M.prepare_churn_models(rows, gbt_rounds=2, rows_a_part=100).fit(M.MODEL_ORDER)
    for name in (M.LR_WEIGHTED, M.LR_UNDERSAMPLED):
        whole, part = cm.training[name][0], parted.training[name][0]
        assert part.rdd.getNumPartitions() == -(-whole.count() // 100) > 1
        key = ["customer_unique_id", "label", "raw_features"]
        assert sorted(map(repr, part.select(key).collect())) == sorted(map(repr, whole.select(key).collect()))
        ids = part.select("customer_unique_id").rdd.mapPartitions(lambda x: [[r[0] for r in x]]).collect()
        assert all(x == sorted(x) for x in ids)
    assert all(r.roc_auc > 0.9 for r in M.model_comparison(parted).collect())
