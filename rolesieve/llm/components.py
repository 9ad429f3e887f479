"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node reachable.

    Each round, a node takes the smallest label among its neighbours and then the label of that
    label, so that long chains shrink by halves.  A node with very many links is summed up in the
    tasks before the shuffle; joins with it are left to adaptive execution, which splits them.
    Each round is a written table.  No links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        least = stored(
            labels.join(around, labels.node == around.a)
            .select("node", F.col("component").alias("before"), F.least("component", "near").alias("label")), "labels")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stored(least.join(up, "label", "left").select("node", "before", F.least("label", "above").alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            return labels
