"""Churn models on disk: each one a pipeline with its scaler, assembler and model as stages.

A saved model scores a table of first-order profiles in any later session, without the
training data: ``SQLTransformer`` (the training part's means and deviations, written into the
statement), ``VectorAssembler``, and the fitted model. The boosted models read the unscaled
features and have no scaler stage. ``save_models`` writes one folder for each model and a
table that names them; ``load_models`` reads them back.

A profile with a missing feature gets no score (it is left out), as in ``score_profiles``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import FEATURES
from .models import GB_WEIGHTED, MODEL_ORDER, RETURN_THRESHOLD, ChurnModels

_INPUT = "_model_input"
_OUTPUTS = ("rawPrediction", "probability", "prediction")
_CATALOG = "catalog"


def _scaler(stats: dict[str, float]) -> SQLTransformer:
    """The standardisation of every feature, as a stage; a deviation of 0 counts as 1."""

    def scaled(f: str) -> str:
        mean, sd = stats[f"_mean_{f}"], stats[f"_sd_{f}"]
        return f"(CAST(`{f}` AS DOUBLE) - CAST('{mean!r}' AS DOUBLE)) / CAST('{sd or 1.0!r}' AS DOUBLE) AS `_z_{f}`"

    return SQLTransformer(statement=f"SELECT *, {', '.join(map(scaled, FEATURES))} FROM __THIS__")


def model_pipeline(cm: ChurnModels, name: str) -> PipelineModel:
    """The fitted model ``name`` with the stages that lead from profiles to its input."""
    model, column = cm.models[name]
    scaled = column != cm.raw_column
    model = model.copy()
    model.setFeaturesCol(_INPUT)
    inputs = [f"_z_{f}" if scaled else f for f in FEATURES]
    assembler = VectorAssembler(inputCols=inputs, outputCol=_INPUT, handleInvalid="skip")
    first = []
    if scaled:
        row = cm.scaler.first().asDict()
        first = [_scaler({k: float(v or 0.0) for k, v in row.items()})]
    return PipelineModel(stages=[*first, assembler, model])


def save_models(cm: ChurnModels, path: str, names: Iterable[str] = MODEL_ORDER) -> str:
    """Writes the models and their catalog under ``path`` (which it replaces) and returns it."""
    spark = cm.test.sparkSession
    listed = []
    for i, name in enumerate(names):
        folder = f"model-{i}"
        model_pipeline(cm, name).write().overwrite().save(f"{path}/{folder}")
        listed.append((i, name, folder))
    catalog = spark.createDataFrame(listed, "model_rank int, model string, folder string").coalesce(1)  # a row for each model
    catalog.write.mode("overwrite").parquet(f"{path}/{_CATALOG}")
    return path


@dataclass(frozen=True)
class SavedModels:
    pipelines: dict[str, PipelineModel]

    def score(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score``, the probability of a repeat order, and ``prediction`` (0 or 1)."""
        clash = [c for c in (*_OUTPUTS, _INPUT, "score") if c in rows.columns]
        if clash:
            raise ValueError(f"columns that the models write: {', '.join(clash)}")
        scored = self.pipelines[name].transform(rows)
        return scored.select(
            *[F.col(f"`{c}`") for c in rows.columns],
            vector_to_array("probability")[1].alias("score"),
            F.col("prediction").cast("bigint").alias("prediction"),
        )

    def score_profiles(self, profiles: DataFrame, threshold: float = RETURN_THRESHOLD, name: str = GB_WEIGHTED) -> DataFrame:
        """Repeat and churn probability of each profile, as ``models.score_profiles`` gives them."""
        scored = self.score(name, profiles.drop("label"))
        p = F.col("score")
        return scored.withColumns(
            {"repeat_probability": p, "churn_probability": F.lit(1.0) - p, "likely_to_return": p >= F.lit(threshold)}
        ).drop("score", "prediction")


def load_models(spark: SparkSession, path: str) -> SavedModels:
    """The models under ``path``, in the order they were saved in."""
    listed = spark.read.parquet(f"{path}/{_CATALOG}").orderBy("model_rank").collect()  # a row for each model
    return SavedModels({r["model"]: PipelineModel.load(f"{path}/{r['folder']}") for r in listed})
