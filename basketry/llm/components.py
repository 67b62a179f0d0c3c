"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b); the label is the component's smallest node.

    Each round gives every node the smallest label among its neighbours, then follows
    the label's own label (twice the reach in each round). Only the number of changed
    labels comes back to the driver.
    """
    both = edges.filter("a <> b").select("a", "b")
    both = work.table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = least.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("beyond", "next")).alias("label"), "old"
        )
        moved = work.table(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
