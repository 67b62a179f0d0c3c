"""Mixing sources to target weights by Poisson replication (built-in functions only).

A source with size s and target weight w gets the mean repetition rate

    rate = budget * w / s        (sizes and budget in characters)

Each document's count is drawn by inverting the Poisson distribution of that mean at
a uniform number hashed from the seed and the document's key, so the draw is the same
in every run and on any partitioning. A document is repeated that many times (not at
all for a count of 0), and the repetitions are put in a global order by another hash.

Defined results: a null source is a source of its own; a null text has size 0; rows
with equal keys get equal counts; a source of size or weight 0 has rate 0; without
rows the result is empty. Columns of the input named like an output column
(``copy``, ``shuffle_key``, ``rate``) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..functions.workspace import Workspace, session_workspace

UNIFORM_HEX = 13  # hex digits of a hash that make a uniform number: 52 bits


def hashed_bits(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts joined by ``|`` (null: empty), as a bigint."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *texts)), 1, UNIFORM_HEX)
    return F.conv(digits, 16, 10).cast("bigint")


def source_rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(source, size, rate), one row for each source.

    Target weights are ``weights`` (a source that it doesn't name gets 0), or else
    size ** temperature; they are scaled to sum to 1. The budget is ``epochs`` times
    the size of all documents.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("double").alias("size")
    )
    if weights is None:
        weight = F.pow("size", F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighted = sizes.withColumn("weight", weight)
    totals = weighted.agg(F.sum("size").alias("_sizes"), F.sum("weight").alias("_weights"))
    rate = F.lit(float(epochs)) * F.col("_sizes") * F.col("weight") / F.col("_weights") / F.col("size")
    return with_scalars(weighted, totals).select(
        "source", "size", F.when((F.col("size") > 0) & (F.col("_weights") > 0), rate).otherwise(0.0).alias("rate")
    )


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where the rest is below 1e-12."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 12).cast("int")
    start = F.struct(
        (-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all")
    )

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    summed = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])
    return F.when(rate > 0, summed).otherwise(F.array(F.lit(1.0)))


def replicate(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
    seed: int = 11,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    max_broadcast: int = 1_000_000,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``docs`` with one row for each repetition, in a global random order.

    Adds ``copy`` (from 1), ``shuffle_key`` (the order) and ``rate`` (of the source). The
    sources' distributions are broadcast if they hold at most ``max_broadcast`` numbers.
    """
    rows = docs.drop("copy", "shuffle_key", "rate")
    work = workspace or session_workspace(docs.sparkSession)
    rates = source_rates(docs, weights, temperature, epochs, source, text).select(
        F.col("source").alias("_source"), "rate", poisson_cdf(F.col("rate")).alias("_cdf")
    )
    rates = work.table(rates, "source-rates")
    # broadcast what is known to be small; beyond that the adaptive join splits a hot source
    if (rates.agg(F.sum(F.size("_cdf"))).first()[0] or 0) <= max_broadcast:
        rates = F.broadcast(rates)
    joined = rows.join(rates, rows[source].eqNullSafe(rates["_source"]))
    u = hashed_bits(str(seed), "count", F.col(key)) / float(16**UNIFORM_HEX)
    drawn = joined.withColumn("_u", u).withColumn("_n", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))))
    copies = drawn.filter("_n > 0").select(
        *[F.col(f"`{c}`") for c in rows.columns], F.explode(F.sequence(F.lit(1), "_n")).alias("copy"), "rate"
    )
    order = hashed_bits(str(seed), "order", F.col(key), F.col("copy"))
    shuffled = copies.withColumn("shuffle_key", order)
    return shuffled.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key", key, "copy")
