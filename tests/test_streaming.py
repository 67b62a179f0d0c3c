"""The streaming ingest yields the same typed rows as the batch reader."""

from __future__ import annotations

import tempfile

from basketry.sources import csv as csv_source
from basketry.sources.fixtures import fixture_views, orders_raw_view
from basketry.streaming import order_export_stream

from .conftest import SMALL


def test_stream_matches_batch(spark):
    folder = tempfile.mkdtemp(prefix="basketry-stream-in-")
    raw = orders_raw_view(fixture_views(spark, SMALL).orders)
    csv_source.write_csv(raw, folder + "/part")
    batch = csv_source.parse_order_timestamps(csv_source.read_text_table(spark, folder + "/part"))

    stream = order_export_stream(spark, folder + "/part")
    query = (
        stream.writeStream.format("memory")
        .queryName("orders_stream_test")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="basketry-stream-ckpt-"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.table("orders_stream_test")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
