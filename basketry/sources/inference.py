"""Column types of a CSV export, from all of its rows.

Types form a lattice: a column without text < ``bigint`` < ``double`` < ``string``, with
``boolean`` and ``day_first`` (an order timestamp) beside the numbers. A column gets the
least type that holds every text in it. What is kept of the rows read so far are five
counts a column, which add up, so one aggregation with a partial stage does it, and a
single odd row anywhere widens its column.

Defined results: NULL and blank text say nothing about a type; a column without text is
``string``; a whole number beyond 64 bits is a ``double``; ids written in digits are
``bigint`` (a declared schema, ``sources.schemas``, is the way to keep them as text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_day_first
from .csv import read_text_table
from .quarantine import FAIL

WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: From the narrowest; a column has the first that all its texts have.
KINDS = ("bigint", "double", "boolean", "day_first")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _tests(text: Column) -> dict[str, Column]:
    return {
        "bigint": text.rlike(WHOLE) & text.try_cast("bigint").isNotNull(),
        "double": text.rlike(NUMBER),
        "boolean": F.lower(text).isin("true", "false"),
        "day_first": parse_day_first(text).isNotNull(),
    }


def inferred_types(raw: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_values, n_bigint, n_double, n_boolean, n_day_first, type) for
    each column of a table of texts."""
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(raw.columns):
        text = F.nullif(F.trim(_quoted(name)), F.lit(""))
        counts.append(F.count(text).alias(f"c{i}"))
        counts += [F.count_if(test).alias(f"c{i}_{kind}") for kind, test in _tests(text).items()]
    rows = []
    for i, name in enumerate(raw.columns):
        n, kinds = F.col(f"c{i}"), {k: F.col(f"c{i}_{k}") for k in KINDS}
        kind = F.when(n == 0, "string")
        for k, found in kinds.items():
            kind = kind.when(found == n, k)
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"), F.col("rows").alias("n_rows"), n.alias("n_values"),
                *[found.alias(f"n_{k}") for k, found in kinds.items()], kind.otherwise("string").alias("type"),
            )
        )
    return raw.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def read_inferred(spark: SparkSession, path: str, multi_line: bool = False, malformed: str = FAIL) -> DataFrame:
    """The table with its inferred types: one pass for the types, then the typed read."""
    raw = read_text_table(spark, path, multi_line, malformed)
    kinds = {r["column_name"]: r["type"] for r in inferred_types(raw).collect()}  # a row a column
    out = []
    for name in raw.columns:
        text = F.nullif(F.trim(_quoted(name)), F.lit(""))
        if kinds[name] == "string":
            typed = F.nullif(_quoted(name), F.lit(""))
        else:
            typed = parse_day_first(text) if kinds[name] == "day_first" else text.cast(kinds[name])
        out.append(typed.alias(name))
    return raw.select(*out)
