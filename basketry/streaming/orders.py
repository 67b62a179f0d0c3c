"""Order exports as a stream of typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from ..sources import schemas
from ..sources.csv import parse_order_timestamps

# The file source needs its schema up front: every export column as text.
_ORDERS_TEXT = StructType([StructField(h, StringType(), True) for h in schemas.ORDERS])


def order_export_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of typed orders from header CSV files dropped into ``folder``.

    The export columns must come in the header order of ``schemas.ORDERS`` (a streaming
    file source cannot pick columns by header name); a file with another header fails.
    """
    reader = (
        spark.readStream.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        .option("quote", '"').option("escape", '"').schema(_ORDERS_TEXT)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_order_timestamps(reader.csv(folder))
