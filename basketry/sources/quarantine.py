"""Malformed rows of CSV exports: found, kept apart and counted, never shifted.

A row is malformed if it hasn't as many fields as the header. The reader sees that only
while it holds all fields of a row, so the checked reads turn column pruning off and carry
the text of a malformed row in a column of its own. Which rows are malformed doesn't depend
on the columns a job needs.

Three ways to read a table (``MODES``):

* ``fail``: the first malformed row ends the job, with the row in the message;
* ``quarantine``: malformed rows are left out of the table; ``malformed_rows`` has them with
  their file, ``row_counts`` the numbers for each file;
* ``pad``: short rows are filled with NULL and the surplus of long ones is cut, as a reader
  without a check would.

Blank lines are no rows. A quoted field with line breaks is one field in a table read with
``multi_line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAIL, QUARANTINE, PAD = "fail", "quarantine", "pad"
MODES = (FAIL, QUARANTINE, PAD)
#: The column that holds the text of a malformed row (NULL in the others).
MALFORMED = "_malformed_row"
_FILE = "_file"


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)  # a file with another header fails
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def header_of(spark: SparkSession, path: str, multi_line: bool = False) -> list[str]:
    """The column names of a table, from one file's header row."""
    return _reader(spark, multi_line).csv(path).columns


def _schema(names: list[str], extra: str | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([extra] if extra else [])]])


def read_marked(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All rows as text, with ``_malformed_row`` and the file a row comes from (``_file``)."""
    names = header_of(spark, path, multi_line)
    if MALFORMED in names or _FILE in names:
        raise ValueError(f"the export has a column named {MALFORMED} or {_FILE}")
    rows = (
        _reader(spark, multi_line)
        .schema(_schema(names, MALFORMED))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", False)
        .csv(path)
    )
    return rows.select("*", F.col("_metadata.file_path").alias(_FILE))


def read_rows(spark: SparkSession, path: str, multi_line: bool = False, malformed: str = FAIL) -> DataFrame:
    """All columns as text, named by the header row; malformed rows by ``malformed``."""
    if malformed not in MODES:
        raise ValueError(f"malformed has to be one of {', '.join(MODES)}")
    if malformed == PAD:
        return _reader(spark, multi_line).option("mode", "PERMISSIVE").csv(path)
    if malformed == FAIL:
        names = header_of(spark, path, multi_line)
        strict = _reader(spark, multi_line).option("mode", "FAILFAST").option("columnPruning", False)
        return strict.schema(_schema(names)).csv(path)
    marked = read_marked(spark, path, multi_line)
    return marked.filter(F.col(MALFORMED).isNull() & _reads_fields(marked)).drop(MALFORMED, _FILE)


def _reads_fields(marked: DataFrame) -> Column:
    """True for every row; a query on the malformed text alone would be refused."""
    return F.coalesce(F.length(F.col(f"`{marked.columns[0]}`")), F.lit(0)) >= 0


def malformed_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, row): the malformed rows as they stand in their file."""
    marked = read_marked(spark, path, multi_line)
    return marked.filter(F.col(MALFORMED).isNotNull() & _reads_fields(marked)).select(
        F.col(_FILE).alias("file"), F.col(MALFORMED).alias("row")
    )


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).cast("bigint").alias(name)


def row_counts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, n_rows, n_accepted, n_malformed) of each file that has rows."""
    marked = read_marked(spark, path, multi_line)
    bad = F.col(MALFORMED).isNotNull()
    return marked.filter(_reads_fields(marked)).groupBy(F.col(_FILE).alias("file")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), _count(~bad, "n_accepted"), _count(bad, "n_malformed")
    )


def quarantine(spark: SparkSession, path: str, target: str, multi_line: bool = False) -> DataFrame:
    """Writes the malformed rows to the Parquet table ``target`` and returns that table."""
    malformed_rows(spark, path, multi_line).write.mode("overwrite").parquet(target)
    return spark.read.schema("file string, row string").parquet(target)
