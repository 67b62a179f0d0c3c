"""The n rows with the smallest keys, for any n, without a global sort or limit.

A row's key is an integer (a seeded hash) and an id that breaks ties. The cutoff is found
by histograms: the rows are counted by the leading bits of the key, the bucket in which
the n-th row lies is looked up, and only that bucket is counted again by its next bits,
until the key of the n-th row is known. Then one filter keeps exactly n rows. Each
histogram has at most ``2^LEVEL_BITS`` rows after a map-side combine and the driver gets
one row of it, so the cost is a few passes over (key, id) for any n; nothing is shuffled
but the histograms and the rows that share the cutoff key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BITS = 12


def _level(rows: DataFrame, value, n: int):
    """(bucket, rows before it, its rows) of the bucket that holds the n-th row, or None."""
    sizes = rows.groupBy(value.alias("b")).agg(F.count(F.lit(1)).alias("size"))
    upto = F.sum("size").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sizes.withColumn("upto", upto)  # at most 2^LEVEL_BITS rows
    return placed.where(F.col("upto") >= F.lit(n)).orderBy("upto").select(
        "b", (F.col("upto") - F.col("size")).alias("before"), "size"
    ).first()


def smallest_rows(df: DataFrame, n: int, key: str, id_col: str, key_bits: int) -> DataFrame:
    """The ``min(n, rows)`` rows of ``df`` that are first by (``key``, ``id_col``).

    ``key`` is a bigint that is not null, from ``[0, 2^key_bits)`` or, with 64 bits, of
    any sign. ``df`` is read once a level: pass a written table. Rows equal in key and id
    are taken in any order.
    """
    if n <= 0:
        return df.limit(0)
    rest, rows, low, shift = n, df.select(key, id_col), None, key_bits
    while shift > 0:
        shift = max(0, shift - LEVEL_BITS)
        found = _level(rows, F.shiftright(F.col(key), shift), rest)
        if found is None:
            return df  # fewer than n rows
        low, rest = found["b"], rest - found["before"]
        rows = rows.where(F.shiftright(F.col(key), shift) == F.lit(low))
        if rest == found["size"]:  # the whole bucket is in
            return df.where(F.shiftright(F.col(key), shift) <= F.lit(low))
    # the n-th row shares its key with later ones (ids of a hash collision): order those by id
    tied = df.where(F.col(key) == F.lit(low))
    place = F.row_number().over(Window.partitionBy(key).orderBy(id_col))
    first = tied.withColumn("_place", place).where(F.col("_place") <= F.lit(rest)).drop("_place")
    return df.where(F.col(key) < F.lit(low)).unionByName(first)
