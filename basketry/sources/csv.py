"""CSV exports -> typed views.

The exports have a header row. Fields may be quoted, with doubled quotes inside, and a
table whose texts hold line breaks is read with ``multi_line`` (such files can't be
split, so it is a choice for each table). All files of a table must have the same
header; one that differs fails the read. A row with more or fewer fields than the header
fails the read too, or is put in quarantine (``sources.quarantine``). Columns are picked by header name and cast;
empty text is NULL, and text that does not convert becomes NULL (``try_cast`` / ``try_to_timestamp``),
as a permissive reader would. Order timestamps are day-first text
(``dd-MM-yy HH:mm``) and parsed with ``functions.dates.parse_day_first``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_day_first
from . import Views, schemas
from .quarantine import FAIL, QUARANTINE, read_rows
from .quarantine import quarantine as write_quarantine

#: Tables whose texts may hold line breaks.
MULTI_LINE = ("reviews",)


def read_text_table(spark: SparkSession, path: str, multi_line: bool = False, malformed: str = FAIL) -> DataFrame:
    """All columns as text, named by the header row (no inference pass)."""
    return read_rows(spark, path, multi_line, malformed)


def _typed(raw: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    out = []
    for header, (name, kind) in columns.items():
        c = F.col(f"`{header}`")
        if kind == "day_first":
            out.append(parse_day_first(c).alias(name))
        elif kind == "string":
            out.append(F.nullif(c, F.lit("")).alias(name))
        else:
            out.append(F.trim(c).try_cast(kind).alias(name))
    return raw.select(*out)


def parse_order_timestamps(raw_orders: DataFrame) -> DataFrame:
    """Typed orders from their text form: every timestamp column parsed day-first."""
    return _typed(raw_orders, schemas.ORDERS)


def timestamp_null_counts(raw_orders: DataFrame) -> DataFrame:
    """Per timestamp column: rows, text present, parsed, and NULL after parsing."""
    aggs = []
    for header in schemas.ORDER_TIMESTAMP_HEADERS:
        c = F.col(f"`{header}`")
        name = schemas.ORDERS[header][0]
        aggs += [
            F.count_if(c.isNotNull()).alias(f"{name}__text"),
            F.count_if(parse_day_first(c).isNull()).alias(f"{name}__null"),
        ]
    wide = raw_orders.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    rows = [
        F.struct(
            F.lit(schemas.ORDERS[h][0]).alias("column_name"),
            F.col(f"{schemas.ORDERS[h][0]}__text").alias("with_text"),
            F.col(f"{schemas.ORDERS[h][0]}__null").alias("null_after_parse"),
        )
        for h in schemas.ORDER_TIMESTAMP_HEADERS
    ]
    return wide.select("rows", F.explode(F.array(*rows)).alias("r")).select(
        "r.column_name",
        F.col("rows").cast("bigint").alias("total_rows"),
        F.col("r.with_text").cast("bigint").alias("with_text"),
        F.col("r.null_after_parse").cast("bigint").alias("null_after_parse"),
    )


def read_payments(spark: SparkSession, path: str, malformed: str = FAIL) -> DataFrame:
    return _typed(read_text_table(spark, path, malformed=malformed), schemas.PAYMENTS)


def read_customers(spark: SparkSession, path: str, malformed: str = FAIL) -> DataFrame:
    return _typed(read_text_table(spark, path, malformed=malformed), schemas.CUSTOMERS)


def read_items(spark: SparkSession, path: str, malformed: str = FAIL) -> DataFrame:
    return _typed(read_text_table(spark, path, malformed=malformed), schemas.ITEMS)


def read_reviews(spark: SparkSession, path: str, malformed: str = FAIL) -> DataFrame:
    """Reviews, with their comment text if the export has it (which may hold line breaks)."""
    raw = read_text_table(spark, path, multi_line=True, malformed=malformed)
    extra = {h: c for h, c in schemas.REVIEW_COMMENT.items() if h in raw.columns}
    return _typed(raw, schemas.REVIEWS | extra)


def read_csv_views(
    spark: SparkSession, paths: Mapping[str, str], malformed: str = FAIL, quarantine: str | None = None
) -> Views:
    """Typed views from CSV exports; ``paths`` maps orders/payments/customers/reviews
    (and optionally items) to a file or directory. With ``malformed="quarantine"`` the
    malformed rows of each table are written as Parquet to its folder under ``quarantine``,
    if that is given."""
    if malformed == QUARANTINE and quarantine:
        for name, path in paths.items():
            write_quarantine(spark, path, f"{quarantine.rstrip('/')}/{name}", name in MULTI_LINE)
    return Views(
        orders=parse_order_timestamps(read_text_table(spark, paths["orders"], malformed=malformed)),
        payments=read_payments(spark, paths["payments"], malformed),
        customers=read_customers(spark, paths["customers"], malformed),
        reviews=read_reviews(spark, paths["reviews"], malformed),
        items=read_items(spark, paths["items"], malformed) if "items" in paths else None,
    )


def write_csv(df: DataFrame, path: str) -> str:
    """Write ``df`` as header CSV (the export format) and return ``path``."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def write_lines(lines: DataFrame, header: str, path: str) -> str:
    """Write a table of whole lines (one text column) as they are, under ``header``."""
    whole = lines.toDF(header)
    # no line holds the separator, so nothing is quoted
    whole.write.mode("overwrite").option("header", True).option("sep", "\x01").option("quote", "\x02").csv(path)
    return path
