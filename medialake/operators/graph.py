"""Connected components over an edge table: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.storage import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable, itself included.

    Each round takes the least label among a node and its neighbours (partial minima are combined before the
    shuffle, so a node with very many neighbours is no hot spot), then jumps to the label's own label. The only
    value that reaches the driver is the number of changed labels. Null ends are ignored; self loops make a node
    of its own; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = stored(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = least.select(F.col("node").alias("up_node"), F.col("component").alias("up"))
        jumped = least.join(up, F.col("component") == F.col("up_node"), "left").select("node", F.least("component", "up").alias("component"), "old")
        jumped = stored(jumped, "labels")
        changed = jumped.where("component <> old").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
