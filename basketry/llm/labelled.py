"""A bounded, reproducible sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import session_workspace


def crc_bucket(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus`` (a null key counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, dict[int, int]]:
    """Rows (text, y) of at most ``per_class`` keys for each label 0 and 1, and the class
    sizes over all labelled keys that ``keep`` admits.

    The keys are those with the smallest hash, so the draw is the same in every run.
    A key with several labels counts as its largest. Null keys and labels are left out.
    The rows are written once, so that training reads the documents only for them.
    """
    rows = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & keep)
        .groupBy(F.col(key).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    sizes = {0: 0, 1: 0} | {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    drawn = [rows.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    # 2 * per_class rows at most
    body = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = body.join(F.broadcast(ids), "_id").select("text", "y")
    return session_workspace(docs.sparkSession).table(sample, "labelled-sample"), sizes
