"""Four churn models: logistic regression and gradient-boosted trees, each with
class weighting and with majority undersampling.

Mapping of the reference settings onto MLlib:

* logistic regression with L2 strength ``C = 1`` on standardised inputs is
  MLlib's objective with ``regParam = 1 / (C * sum of weights)``,
  ``elasticNetParam = 0`` and ``standardization = False`` (inputs are already
  standardised with the training statistics, population sd);
* boosted trees: 200 rounds, depth 4, step 0.05, row subsampling 0.8, seed 42,
  on unscaled features. MLlib bins features and fits its own leaf values, so
  trees are not identical to other libraries; compare by AUC and importance order.

A person with a missing feature (an unreadable purchase time leaves no month) takes no
part in fitting and gets no score.

A round of boosting is four short jobs, one for each level of its tree, so a fit's time is
the overhead of its 800 jobs. Hence a model is fitted when a job first asks for it, those
asked for together run side by side, and their training rows are written tables of vectors
(a short lineage, which every task carries) read in parts of ``ROWS_A_PART`` rows: the
number of tasks, and with it what their results send to the driver, follows the rows and
not the files or cores. Intermediate RDDs of the boosting loop are checkpointed to the
session's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import round_half_up
from ...functions.position import materialize
from ...session import ensure_checkpoint_dir
from .features import FEATURE_LABELS, FEATURES, PERSON
from .metrics import auc, classification_metrics
from .sampling import TEST, TRAIN, class_weights, scaler_stats, standardize, stratified_split, undersample_majority
from ...functions.scalars import with_scalars

# Model names in display order.
LR_WEIGHTED = "Logistic Regression (Class Weighting)"
LR_UNDERSAMPLED = "Logistic Regression (Undersampling)"
GB_WEIGHTED = "Gradient Boosting (Class Weighting)"
GB_UNDERSAMPLED = "Gradient Boosting (Undersampling)"
MODEL_ORDER = (LR_WEIGHTED, LR_UNDERSAMPLED, GB_WEIGHTED, GB_UNDERSAMPLED)
RETURN_THRESHOLD = 0.4

_RAW = "raw_features"
_SCALED = "scaled_features"


#: Training rows that one task of a fit works on.
ROWS_A_PART = 50_000


@dataclass
class ChurnModels:
    estimators: dict  # name -> (estimator, training rows, features column)
    scaler: DataFrame  # one row of training means and sds
    test: DataFrame  # test part with both feature vectors
    training: dict  # name -> (training rows, weight column, L2 strength) of the logistic models
    models: dict = field(default_factory=dict)  # name -> (fitted model, features column), of those asked for
    raw_column: str = _RAW  # the column of unscaled features

    def fit(self, names: Iterable[str]) -> ChurnModels:
        """Fits those of the named models that aren't fitted yet."""
        wanted = [name for name in MODEL_ORDER if name in names and name not in self.models]
        # independent jobs: submitted together, so that one fit's small stages fill the other's gaps
        with ThreadPoolExecutor(len(wanted) or 1) as pool:
            started = {name: pool.submit(self.estimators[name][0].fit, self.estimators[name][1]) for name in wanted}
            self.models |= {name: (fit.result(), self.estimators[name][2]) for name, fit in started.items()}
        return self

    @property
    def gb_weighted_importances(self) -> list[float]:
        return [float(x) for x in self.models[GB_WEIGHTED][0].featureImportances.toArray()]


def _vectors(df: DataFrame, stats: DataFrame) -> DataFrame:
    z = standardize(df, stats)
    raw = VectorAssembler(inputCols=list(FEATURES), outputCol=_RAW, handleInvalid="skip").transform(z)
    return VectorAssembler(inputCols=[f"z_{f}" for f in FEATURES], outputCol=_SCALED, handleInvalid="skip").transform(raw)


def _sum(df: DataFrame, col) -> float:
    return float(df.agg(F.sum(col)).first()[0] or 0.0)


def _in_parts(rows: DataFrame, n: int, rows_a_part: int) -> DataFrame:
    """``rows`` (about ``n``) as a written table, read in as many parts as their number asks for.

    The boosting draws rows by their place in a part and lines parts up again when one is
    lost, so the order in a part is fixed: that of the one file, or that of the persons."""
    parts = -(-n // rows_a_part) or 1
    if parts == 1:
        return materialize(rows.coalesce(1)).coalesce(1)
    return materialize(rows).repartition(parts, PERSON).sortWithinPartitions(PERSON)


def prepare_churn_models(
    features: DataFrame, seed: int = 42, gbt_rounds: int = 200, lr_max_iter: int = 1000, rows_a_part: int = ROWS_A_PART
) -> ChurnModels:
    """The four models' estimators with their training rows and the test part, nothing fitted."""
    ensure_checkpoint_dir(features.sparkSession)
    split = materialize(stratified_split(features, seed=seed))  # read by five branches below
    train_rows = split.where(F.col("split") == TRAIN).drop("split")
    stats = scaler_stats(train_rows)
    per_label = [r["count"] for r in train_rows.groupBy("label").count().collect()]  # two rows
    columns = [PERSON, "label", F.col("label").cast("double").alias("label_d"), _RAW, _SCALED]
    weighted = _vectors(class_weights(train_rows), stats).select(*columns, "weight")
    weighted = _in_parts(weighted, sum(per_label), rows_a_part)
    balanced = _vectors(undersample_majority(train_rows, seed=seed), stats).select(*columns)
    balanced = _in_parts(balanced, 2 * min(per_label, default=0), rows_a_part)
    test = _vectors(split.where(F.col("split") == TEST).drop("split"), stats)

    w_total = _sum(weighted, "weight")
    n_balanced = _sum(balanced, F.lit(1.0))

    def logistic(reg: float, weight_col: str | None):
        lr = LogisticRegression(
            featuresCol=_SCALED,
            labelCol="label_d",
            regParam=reg,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=lr_max_iter,
        )
        if weight_col:
            lr.setWeightCol(weight_col)
        return lr

    def boosted(weight_col: str | None):
        gb = GBTClassifier(
            featuresCol=_RAW,
            labelCol="label_d",
            maxIter=gbt_rounds,
            maxDepth=4,
            stepSize=0.05,
            subsamplingRate=0.8,
            seed=seed,
            checkpointInterval=10,
        )
        if weight_col:
            gb.setWeightCol(weight_col)
        return gb

    reg_weighted, reg_balanced = (1.0 / n if n else 0.0 for n in (w_total, n_balanced))
    estimators = {
        LR_WEIGHTED: (logistic(reg_weighted, "weight"), weighted, _SCALED),
        LR_UNDERSAMPLED: (logistic(reg_balanced, None), balanced, _SCALED),
        GB_WEIGHTED: (boosted("weight"), weighted, _RAW),
        GB_UNDERSAMPLED: (boosted(None), balanced, _RAW),
    }
    training = {LR_WEIGHTED: (weighted, "weight", reg_weighted), LR_UNDERSAMPLED: (balanced, None, reg_balanced)}
    return ChurnModels(estimators=estimators, scaler=stats, test=test, training=training)


def fit_churn_models(features: DataFrame, seed: int = 42, gbt_rounds: int = 200, lr_max_iter: int = 1000) -> ChurnModels:
    """All four models, fitted."""
    return prepare_churn_models(features, seed, gbt_rounds, lr_max_iter).fit(MODEL_ORDER)


def _predict(model, features_col: str, df: DataFrame, name: str) -> DataFrame:
    scored = model.setFeaturesCol(features_col).transform(df)
    return scored.select(
        F.lit(name).alias("model"),
        PERSON,
        "label",
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("bigint").alias("prediction"),
    )


def test_predictions(cm: ChurnModels, names=MODEL_ORDER) -> DataFrame:
    """Scores and 0/1 predictions of the named models on the test part."""
    out = None
    for name in names:
        model, col = cm.models[name]
        p = _predict(model, col, cm.test, name)
        out = p if out is None else out.unionByName(p)
    return out


def feature_importance(cm: ChurnModels, spark) -> DataFrame:
    """Importances of the class-weighted boosted model, largest first."""
    rows = list(zip(FEATURES, FEATURE_LABELS, cm.gb_weighted_importances))
    df = spark.createDataFrame(rows, "feature string, feature_label string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


def model_comparison(cm: ChurnModels, digits: int = 3) -> DataFrame:
    """One row per model: AUC, precision / recall / F1 of class 1, and the best
    model by AUC (the first in display order on ties)."""
    preds = test_predictions(cm)
    spark = preds.sparkSession
    a = auc(preds, group_by=["model"])
    m = classification_metrics(preds, group_by=["model"]).where(
        (F.col("actual") == 1) & (F.col("predicted") == 1)
    ).select("model", "precision", "recall", "f1")
    order = spark.createDataFrame(list(enumerate(MODEL_ORDER)), "model_rank int, model string")
    rows = order.join(a, "model", "inner").join(m, "model", "inner")  # four rows each
    best = rows.agg(F.min_by("model", F.struct(-F.col("auc"), F.col("model_rank"))).alias("_best"))
    return with_scalars(rows, best).select(
        "model",
        round_half_up("auc", digits).alias("roc_auc"),
        round_half_up("precision", digits).alias("precision"),
        round_half_up("recall", digits).alias("recall"),
        round_half_up("f1", digits).alias("f1"),
        (F.col("model") == F.col("_best")).alias("is_best"),
    )


def score_profiles(cm: ChurnModels, profiles: DataFrame, threshold: float = RETURN_THRESHOLD) -> DataFrame:
    """Repeat and churn probability of each profile (a first order described by
    the six features) under the class-weighted boosted model."""
    model, col = cm.models[GB_WEIGHTED]
    vec = VectorAssembler(inputCols=list(FEATURES), outputCol=_RAW, handleInvalid="skip").transform(profiles)
    scored = model.setFeaturesCol(col).transform(vec)
    p = vector_to_array("probability")[1]
    keep = [c for c in profiles.columns if c not in ("label",)]
    return scored.select(
        *keep,
        p.alias("repeat_probability"),
        (F.lit(1.0) - p).alias("churn_probability"),
        (p >= F.lit(threshold)).alias("likely_to_return"),
    )
