"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import packed, stage


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is its smallest node.

    Rounds of taking the smallest label among the neighbours and then the label's own
    label, so that long chains close in few rounds. Labels are written to the shared folder
    each round; only the number of edges and whether any label changed reach the driver.
    ``edges`` is read twice, so it should be a written table.
    """
    rows = 2 * edges.count()
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = stage(packed(both, rows), "edges")
    first = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = stage(packed(first, rows), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a").agg(F.min("label").alias("near"))
        )
        hooked = (
            labels.join(near, labels["node"] == near["a"], "left")
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(up, "label", "left").select(
            "node", "old", F.least("label", "up").alias("label")
        )
        done = stage(packed(jumped, rows), "labels")
        labels = done.select("node", "label")
        if done.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
