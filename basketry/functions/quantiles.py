"""Exact quantiles and quantile scores.

``exact_quantiles`` gives the same numbers as SQL ``percentile`` /
``quantile_cont`` (linear interpolation between the order statistics at
``floor`` and ``ceil`` of ``(n - 1) * q``) but never builds a map of all distinct
values in one reducer: distinct values are counted in parallel, their global
positions come from ``running_sums``, and only the few order statistics needed
are picked out by a join with a broadcast table of ``len(probs)`` targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import round_half_up
from .position import materialize, running_sums

QUINTILE_PROBS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def exact_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], group_by: Sequence[str] = (), bucket: Column | None = None
) -> DataFrame:
    """Rows ``(*group_by, prob, value)`` for each group and requested probability
    (no rows for an empty group). ``bucket`` is a monotone expression of the value
    column ``v`` that spreads it over tasks; without it approximate quantiles do."""
    groups = list(group_by)
    vals = df.where(F.col(col).isNotNull()).groupBy(*groups, F.col(col).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    vals = materialize(vals)  # distinct values and counts, read by four branches below
    cum = running_sums(vals, ["v"], {"_end": F.col("c")}, partition_by=groups, bucket=bucket)
    cum = cum.select(*groups, "v", (F.col("_end") - F.col("c")).alias("_start"), "_end")
    total = vals.groupBy(*groups).agg(F.sum("c").alias("n")).where(F.col("n") > 0)
    # groups x probs rows: bounded by the caller's handful of groups
    tg = {g: f"_t_{g}" for g in groups}  # renamed: both sides derive from ``vals``
    targets = F.broadcast(
        total.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .select(*[F.col(g).alias(tg[g]) for g in groups], "prob",
                ((F.col("n") - 1).cast("double") * F.col("prob")).alias("pos"))
        .select(*tg.values(), "prob", "pos", F.floor("pos").alias("lo"), F.ceil("pos").alias("hi"))
    )
    hit_lo = (F.col("_start") <= F.col("lo")) & (F.col("lo") < F.col("_end"))
    hit_hi = (F.col("_start") <= F.col("hi")) & (F.col("hi") < F.col("_end"))
    cond = hit_lo | hit_hi
    for g in groups:
        cond = cond & (F.col(g) == F.col(tg[g]))
    picked = (
        cum.join(targets, cond, "inner")
        .groupBy(*groups, "prob")
        .agg(
            F.max(F.when(hit_lo, F.col("v"))).alias("v_lo"),
            F.max(F.when(hit_hi, F.col("v"))).alias("v_hi"),
            F.first("pos").alias("pos"),
            F.first("lo").alias("lo"),
        )
    )
    value = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.col("lo"))
    return picked.select(*groups, "prob", value.alias("value"))


def quantile_edges(df: DataFrame, col: str, probs: Sequence[float] = QUINTILE_PROBS, method: str = "exact",
                   digits: int = 6) -> DataFrame:
    """One row with ``edges``: the quantiles of ``col`` at ``probs`` rounded to ``digits``."""
    wide = quantile_edges_multi(df, [col], probs, method, digits)
    return wide.select(F.col(f"{col}_edges").alias("edges"))


def quantile_edges_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUINTILE_PROBS,
                         method: str = "exact", digits: int = 6, bucket: Column | None = None) -> DataFrame:
    """One row with ``<col>_edges`` for every column, from a single pass over a
    long (column, value) form of ``df``.

    ``method='exact'`` uses the distributed order-statistic path above;
    ``method='percentile'`` uses Spark's built-in exact ``percentile`` aggregate,
    which is simpler but keeps every distinct value of a column in one reducer.
    """
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in cols]))
        .alias("kv")
    ).select("kv.metric", "kv.x")
    if method == "percentile":
        arr = F.percentile(F.col("x"), list(probs))
        per = long.groupBy("metric").agg(F.transform(arr, lambda e: round_half_up(e, digits)).alias("edges"))
    else:
        q = exact_quantiles(long, "x", probs, group_by=["metric"], bucket=bucket)
        pairs = F.array_sort(F.collect_list(F.struct("prob", round_half_up("value", digits).alias("edge"))))
        per = q.groupBy("metric").agg(F.transform(pairs, lambda s: s["edge"]).alias("edges"))
    return per.agg(*[F.max(F.when(F.col("metric") == c, F.col("edges"))).alias(f"{c}_edges") for c in cols])


def inner_edges(edges: Column) -> Column:
    """Distinct edges without the first and the last (the bin boundaries that split)."""
    uniq = F.array_distinct(edges)
    return F.filter(uniq, lambda e, i: (i > 0) & (i < F.size(uniq) - 1))


def quantile_score(x: Column, inner: Column) -> Column:
    """Bin number of ``x`` for right-closed bins with dropped duplicate edges.

    Equals ``pd.qcut(x, q, duplicates='drop')`` + 1: the lowest value is in bin 1,
    a value equal to an edge belongs to the lower bin. A constant column has no
    inner edge and scores 1.
    """
    return (F.lit(1) + F.size(F.filter(inner, lambda e: e < x.cast("double")))).cast("bigint")


def bin_count(edges: Column) -> Column:
    """Number of bins after dropping duplicate edges (at least 1)."""
    return F.greatest(F.size(F.array_distinct(edges)) - 1, F.lit(1)).cast("bigint")
