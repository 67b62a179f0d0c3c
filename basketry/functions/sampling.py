"""Seeded, reproducible row order for sampling and splitting.

A draw "without replacement, seeded" becomes: order rows by a hash of their id, the
seed and the purpose of the draw, then take a prefix. The hash works on 31 bits with
operations that every SQL engine has: three rounds of exclusive-or with a round key,
multiplication and a shift. Each round is a bijection, so ids below 2^31 get different
keys, and the id itself breaks the ties of larger ones. The round keys depend on seed
and purpose, so draws with another seed or for another purpose are unrelated.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# Modulus and odd multipliers of the rounds, and the shift after each.
MIX_MODULUS = 2147483648
MIX_BITS = 31
MIX_ROUNDS = ((1664525, 15), (1103515245, 13), (214013, 16))

SPLIT, UNDERSAMPLE, SAMPLE = "split", "undersample", "sample"


def round_keys(seed: int, purpose: str) -> list[int]:
    return [zlib.crc32(f"{seed}|{purpose}|{r}".encode()) % MIX_MODULUS for r in range(len(MIX_ROUNDS))]


def mix_bits(df: DataFrame, id_col: str) -> int:
    """Bit width of the range ``seeded_mix`` draws from (for monotone bucketing)."""
    return MIX_BITS if isinstance(df.schema[id_col].dataType, IntegralType) else 64


def seeded_mix(df: DataFrame, id_col: str, seed: int, purpose: str) -> Column:
    """A pseudo-random bigint order key for ``id_col``."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        return F.xxhash64(F.lit(seed), F.lit(purpose), F.col(id_col))
    x = F.pmod(F.col(id_col).cast("bigint"), F.lit(MIX_MODULUS))
    for key, (factor, shift) in zip(round_keys(seed, purpose), MIX_ROUNDS, strict=True):
        x = (x.bitwiseXOR(F.lit(key).cast("bigint")) * F.lit(factor).cast("bigint")) % F.lit(MIX_MODULUS).cast("bigint")
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x
