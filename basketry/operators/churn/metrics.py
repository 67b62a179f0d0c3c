"""ROC curve, AUC and classification metrics from a score / prediction table.

Everything starts from counts per distinct score (or per actual x predicted
cell), aggregated in parallel. Cumulative counts over descending scores come
from ``functions.position.running_sums``; the AUC is the Mann-Whitney U of the
positives' scores against the negatives' divided by ``n_pos * n_neg`` (ties
count one half), which equals the area under the step ROC curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.numeric import round_half_up
from ...functions.position import BUCKET, materialize, running_sums, with_bucket
from ...functions.scalars import with_scalars


def _score_counts(scored: DataFrame, score: str, label: str, group_by: Sequence[str]) -> DataFrame:
    return scored.where(F.col(score).isNotNull()).groupBy(*group_by, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


_RANGE = "_range"


def _cumulative(scored: DataFrame, score: str, label: str, group_by: Sequence[str], bucket: Column | None) -> DataFrame:
    """Written once: counts per distinct score with the counts at or below it, and the
    range of scores (``_range``) that a task handled."""
    counts = _score_counts(scored, score, label, group_by)
    if bucket is None:  # ranges with about as many distinct scores each, wherever they lie
        counts = with_bucket(materialize(counts), "threshold").withColumnRenamed(BUCKET, _RANGE)
    else:
        counts = counts.withColumn(_RANGE, bucket)
    sums = {"_pos_le": F.col("pos"), "_neg_le": F.col("neg")}
    return materialize(running_sums(counts, ["threshold"], sums, partition_by=group_by, bucket=F.col(_RANGE)))


def _corners(cum: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """``cum`` without the thresholds whose point lies midway on the line of its neighbours.

    The step to a point adds its ``pos`` and ``neg`` rows; a point is dropped if the step
    to the next lower threshold adds the same, the first and the last one never. The next
    lower threshold is in the same range, or it is the highest of the nearest range below:
    those edge rows are exchanged through a table of one row for each range.
    """
    step = F.struct("pos", "neg")
    inside = Window.partitionBy(*group_by, _RANGE).orderBy("threshold")
    edges = cum.groupBy(*group_by, _RANGE).agg(F.max_by(step, F.col("threshold")).alias("_top"))
    across = Window.partitionBy(*group_by).orderBy(_RANGE)  # one row for each range
    below = edges.select(
        *group_by, _RANGE, F.lag("_top").over(across).alias("_below"), F.lead(F.lit(1)).over(across).alias("_above")
    )
    near = cum.withColumn("_next", F.lag(step).over(inside)).withColumn("_higher", F.lead(F.lit(1)).over(inside))
    joined = near.join(below, [*group_by, _RANGE])
    following = F.coalesce("_next", "_below")
    highest = F.col("_higher").isNull() & F.col("_above").isNull()
    return joined.where(highest | following.isNull() | (step != following)).select(*[F.col(c) for c in cum.columns])


def _totals(cum: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Class totals and AUC: each threshold adds the trapezoid under its part of the curve."""
    below = (F.col("_neg_le") - F.col("neg")).cast("double")
    area = F.col("pos").cast("double") * (below + F.col("neg").cast("double") / F.lit(2.0))
    sums = cum.groupBy(*group_by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.sum(area).alias("_area"))
    pairs = F.col("_P").cast("double") * F.col("_N").cast("double")
    return sums.select(*group_by, "_P", "_N", F.try_divide(F.col("_area"), pairs).alias("auc"))


def _points(cum: DataFrame, totals: DataFrame, group_by: Sequence[str]) -> DataFrame:
    # one row per group (bounded by the caller's handful of models), or one row
    joined = cum.join(F.broadcast(totals), list(group_by), "inner") if group_by else with_scalars(cum, totals)
    tp = F.col("_P") - (F.col("_pos_le") - F.col("pos"))
    fp = F.col("_N") - (F.col("_neg_le") - F.col("neg"))
    points = joined.select(
        *group_by,
        "threshold",
        F.try_divide(fp, F.col("_N")).alias("fpr"),
        F.try_divide(tp, F.col("_P")).alias("tpr"),
        "auc",
    )
    origin = totals.select(
        *group_by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), "auc"
    )
    return points.unionByName(origin)


def roc_points(
    scored: DataFrame,
    score: str = "score",
    label: str = "label",
    group_by: Sequence[str] = (),
    bucket: Column | None = None,
    drop_collinear: bool = False,
) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the origin at threshold +inf.

    A point counts the rows with ``score >= threshold`` as predicted positive.
    ``drop_collinear`` leaves out points midway on the line between their neighbours, as
    they change no curve. ``bucket``, a monotone expression of ``threshold``, spreads the
    scores over tasks; by default quantiles of the distinct scores do.
    """
    cum = _cumulative(scored, score, label, group_by, bucket)
    shown = _corners(cum, group_by) if drop_collinear else cum
    return _points(shown, _totals(cum, group_by), group_by).drop("auc")


def auc(
    scored: DataFrame,
    score: str = "score",
    label: str = "label",
    group_by: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """ROC AUC per group (NULL when a class is missing)."""
    return _totals(_cumulative(scored, score, label, group_by, bucket), group_by).select(*group_by, "auc")


def roc_curve_and_auc(
    scored: DataFrame, score: str = "score", label: str = "label", drop_collinear: bool = False
) -> DataFrame:
    """The ROC points with the AUC repeated on each row, from one table of cumulative counts."""
    cum = _cumulative(scored, score, label, (), None)
    return _points(_corners(cum, ()) if drop_collinear else cum, _totals(cum, ()), ())


def classification_metrics(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    group_by: Sequence[str] = (),
    digits: int = 6,
) -> DataFrame:
    """Confusion matrix in long form (all four cells, zeros included) with the
    precision, recall and F1 of class 1 on every row (0 where undefined)."""
    counts = scored.groupBy(
        *group_by, F.col(label).cast("bigint").alias("actual"), F.col(prediction).cast("bigint").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(
        F.array(*[F.struct(F.lit(a).cast("bigint").alias("actual"), F.lit(p).cast("bigint").alias("predicted"))
                  for a in (0, 1) for p in (0, 1)])
    )
    if group_by:  # every group gets the four cells
        grid = counts.select(*group_by).distinct().select(*group_by, cells.alias("c")).select(*group_by, "c.*")
    else:
        grid = scored.sparkSession.range(1).select(cells.alias("c")).select("c.*")
    keys = [*group_by, "actual", "predicted"]
    full = grid.join(counts, keys, "left").select(*keys, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    w = Window.partitionBy(*group_by)  # four rows per group

    def cell(a, p):
        return F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))).over(w).cast("double")

    tp, fp, fn = cell(1, 1), cell(0, 1), cell(1, 0)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return full.select(
        *keys,
        "n",
        round_half_up(ratio(tp, tp + fp), digits).alias("precision"),
        round_half_up(ratio(tp, tp + fn), digits).alias("recall"),
        round_half_up(ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), digits).alias("f1"),
    )
