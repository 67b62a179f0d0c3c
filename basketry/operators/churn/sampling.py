"""Stratified split, class weights, undersampling and standardisation.

Seeded draws are prefixes of a seeded order (``functions.sampling``). The
positions inside a class come from ``functions.position.row_positions``, which
range-buckets the seeded key instead of sorting a whole class in one task.
Class sizes come from the bucket totals of the same pass. Tables of per-class counts
have one row per class (labels are 0/1), so broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import round_half_up
from ...functions.position import BUCKET_BITS, materialize, row_positions, uniform_bucket
from ...functions.sampling import SPLIT, UNDERSAMPLE, mix_bits, seeded_mix
from .features import FEATURES, PERSON
from ...functions.scalars import with_scalars

TRAIN, TEST = "train", "test"


def stratified_split(
    features: DataFrame, test_fraction: float = 0.2, seed: int = 42, bucket_bits: int = BUCKET_BITS
) -> DataFrame:
    """Add ``split``: within each label the first ``ceil(test_fraction * n_label)``
    persons in seeded order are 'test', the rest 'train'."""
    keyed = features.withColumn("_mix", seeded_mix(features, PERSON, seed, SPLIT))
    bucket = uniform_bucket("_mix", mix_bits(features, PERSON), bucket_bits)
    ranked = row_positions(
        keyed, ["_mix", PERSON], partition_by=["label"], key="_mix", name="_pos", bucket=bucket, sizes="_n"
    )
    cut = F.ceil(F.col("_n").cast("double") * F.lit(float(test_fraction)))
    return ranked.withColumn("split", F.when(F.col("_pos") <= cut, TEST).otherwise(TRAIN)).drop("_mix", "_pos", "_n")


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weights ``n / (2 * n_class)`` for every training row."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("_nc"))
    total = train.agg(F.count(F.lit(1)).alias("_n"))
    per_class = with_scalars(counts, total).select(
        "label", (F.col("_n").cast("double") / (F.lit(2.0) * F.col("_nc").cast("double"))).alias("weight")
    )
    return train.join(F.broadcast(per_class), "label", "inner")


def undersample_majority(train: DataFrame, seed: int = 42, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """All minority rows plus an equal number of majority rows drawn without
    replacement in seeded order. The majority class is read from the data (on
    equal counts class 0 is treated as the majority). With one class only there is
    nothing to draw against, and the result is empty."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("_nc"))
    roles = counts.agg(
        F.max_by("label", F.struct(F.col("_nc"), -F.col("label"))).alias("_major"),
        F.when(F.count(F.lit(1)) > 1, F.min("_nc")).otherwise(0).alias("_keep"),
    )
    tagged = with_scalars(train, roles)
    minority = tagged.where(F.col("label") != F.col("_major"))
    majority = tagged.where(F.col("label") == F.col("_major"))
    majority = majority.withColumn("_mix", seeded_mix(train, PERSON, seed, UNDERSAMPLE))
    bucket = uniform_bucket("_mix", mix_bits(train, PERSON), bucket_bits)
    drawn = row_positions(majority, ["_mix", PERSON], key="_mix", name="_pos", bucket=bucket)
    drawn = drawn.where(F.col("_pos") <= F.col("_keep"))
    cols = train.columns
    return minority.select(*cols).unionByName(drawn.select(*cols))


def scaler_stats(train: DataFrame) -> DataFrame:
    """One row: mean and population standard deviation of every feature."""
    aggs = []
    for f in FEATURES:
        aggs += [F.avg(f).alias(f"_mean_{f}"), F.stddev_pop(f).alias(f"_sd_{f}")]
    return train.agg(*aggs)


def standardize(df: DataFrame, stats: DataFrame, digits: int | None = None) -> DataFrame:
    """Add ``z_<feature>`` = (x - mean) / sd with the training statistics (sd 0 -> 1)."""
    out = with_scalars(df, stats)
    zs = []
    for f in FEATURES:
        sd = F.col(f"_sd_{f}")
        z = (F.col(f).cast("double") - F.col(f"_mean_{f}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        zs.append((round_half_up(z, digits) if digits is not None else z).alias(f"z_{f}"))
    return out.select(*df.columns, *zs)


def standardize_features(features: DataFrame, seed: int = 42, digits: int = 6) -> DataFrame:
    """Standardised features of every person, scaled with the training part's statistics."""
    split = materialize(stratified_split(features, seed=seed))  # read by the statistics and the rows
    stats = scaler_stats(split.where(F.col("split") == TRAIN))
    z = standardize(split, stats, digits)
    return z.select(PERSON, "label", "split", *[f"z_{f}" for f in FEATURES])
