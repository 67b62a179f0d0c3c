"""Global running sums and row positions without a single-task window.

``Window.orderBy(...)`` with no partition pulls every row into one task. The
functions here range-bucket the rows on the leading order key instead:

1. bucket edges are approximate quantiles of that key (``percentile_approx``,
   at most ``n_buckets`` values) computed inside the plan as a one-row table that
   is broadcast; a row's bucket is the number of edges below its key, a
   monotone function of the key, so bucket order equals key order. Nothing is
   collected. The input is read by several branches of the plan (edges, bucket
   totals, rows); callers pass an input that is cheap to re-read (a checkpointed
   aggregate, see ``materialize``). Callers whose key is already spread evenly (a
   seeded hash) or has a bounded domain (days) pass a monotone ``bucket``
   expression instead and skip the edges;
2. rows are bucketed by that expression;
3. per-bucket totals (at most ``n_buckets`` rows per group) give each bucket its
   offset via a window over that small table;
4. the running sum inside a bucket is an ordinary window partitioned by
   (group, bucket), so each task sorts only about ``1 / n_buckets`` of the group.

Everything is a deterministic function of the data and the fixed edges, so a
recomputed partition (lost executor) yields the same numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import with_scalars
from .workspace import current_workspace

DEFAULT_BUCKETS = 128
# Leading bits of an evenly spread key that make its bucket: 4096 buckets, so that a
# group is ordered in that many tasks' worth of pieces.
BUCKET_BITS = 12
BUCKET = _BUCKET = "_pos_bucket"  # the column that ``with_bucket`` adds


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the session's shared checkpoint folder
    and continue from that table.

    Used before a result is read by more than one pass. The input is computed
    once (an eager ``checkpoint()`` of an unpersisted plan would compute it
    twice), the lineage is cut, the files survive the loss of executors, and
    later reads get column pruning and filter pushdown. The current workspace
    (``working_in``, else the session's) owns the table and removes it.
    """
    return current_workspace(df.sparkSession).table(df)


def uniform_bucket(key: str, key_bits: int = 31, bucket_bits: int = BUCKET_BITS) -> Column:
    """Monotone bucket for an integer key spread evenly over ``[0, 2^key_bits)``
    (or the signed 64-bit range with ``key_bits=64``): its top ``bucket_bits`` bits."""
    return F.shiftright(F.col(key), key_bits - bucket_bits)


def log_bucket(value: Column, per_doubling: int = 64) -> Column:
    """Monotone bucket for amounts, counts and days: equal parts of the logarithm of
    1 + |value|, so no pass over the data is needed for the edges."""
    size = F.floor(F.log2(F.abs(value) + F.lit(1.0)) * F.lit(float(per_doubling)))
    return F.when(value < 0, -size).otherwise(size)


def with_bucket(df: DataFrame, key: str, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Add ``_pos_bucket``: a range bucket on ``key`` (non-null numeric) from
    approximate quantile edges of ``key``, all inside the plan."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    accuracy = 8 * n_buckets  # edges within an eighth of a bucket
    edges = df.agg(
        F.array_distinct(F.percentile_approx(F.col(key).cast("double"), probs, accuracy)).alias("_pos_edges")
    )
    x = F.col(key).cast("double")
    bucketed = with_scalars(df, edges)  # at most n_buckets edges
    # the place of the key among the edges, without a lambda: Spark may copy this expression
    # to the other side of a self-join, and it loses sight of a column inside a lambda
    place = F.array_position(F.sort_array(F.array_append("_pos_edges", x)), x)
    return bucketed.withColumn(_BUCKET, place.cast("int")).drop("_pos_edges")


def running_sums(
    df: DataFrame,
    order_by: Sequence[str | Column],
    sums: Mapping[str, Column],
    partition_by: Sequence[str] = (),
    key: str | None = None,
    n_buckets: int = DEFAULT_BUCKETS,
    bucket: Column | None = None,
    totals_as: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums ``sums[name]`` in ``order_by`` order per ``partition_by``.

    ``key`` (default: the first ``order_by`` entry, which must then be a column
    name) is the numeric column used for bucketing; ``order_by`` must sort by it
    first. Rows that tie on the full ``order_by`` get successive values, like
    ``ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW``. ``bucket``, if given,
    must be non-decreasing in ``key``; it replaces the quantile bucketing.
    ``totals_as`` names columns for the sums of a whole group, which the bucket
    totals give without another pass.
    """
    if key is None:
        first = order_by[0]
        if not isinstance(first, str):
            raise ValueError("pass key= when order_by starts with an expression")
        key = first
    parts = list(partition_by)
    tmp_vals = {name: f"_pos_v_{name}" for name in sums}
    staged = df.select("*", *[expr.alias(tmp_vals[name]) for name, expr in sums.items()])
    if bucket is not None:
        staged = staged.withColumn(_BUCKET, bucket)
    else:
        staged = with_bucket(staged, key, n_buckets)

    totals = staged.groupBy(*parts, _BUCKET).agg(*[F.sum(tmp_vals[n]).alias(tmp_vals[n]) for n in sums])
    before = Window.partitionBy(*parts).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    wholes = totals_as or {}
    offsets = totals.select(
        *parts,
        _BUCKET,
        *[F.coalesce(F.sum(tmp_vals[n]).over(before), F.lit(0)).alias(f"_pos_off_{n}") for n in sums],
        *[F.sum(tmp_vals[n]).over(Window.partitionBy(*parts)).alias(c) for n, c in wholes.items()],
    )

    inside = Window.partitionBy(*parts, _BUCKET).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = staged.select("*", *[F.sum(tmp_vals[n]).over(inside).alias(f"_pos_in_{n}") for n in sums])
    joined = running.join(offsets, [*parts, _BUCKET], "inner")
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_pos_off_{n}") + F.col(f"_pos_in_{n}")).alias(n) for n in sums],
        *wholes.values(),
    )
    return out


def row_positions(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    key: str | None = None,
    name: str = "position",
    n_buckets: int = DEFAULT_BUCKETS,
    bucket: Column | None = None,
    sizes: str | None = None,
) -> DataFrame:
    """1-based position of every row in ``order_by`` order within ``partition_by``, and with
    ``sizes`` the number of rows of the group under that name."""
    one = {name: F.lit(1).cast("bigint")}
    return running_sums(df, order_by, one, partition_by, key, n_buckets, bucket, {name: sizes} if sizes else None)
