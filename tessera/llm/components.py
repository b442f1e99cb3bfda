"""Connected components of an edge table by joins: least labels spread along edges, then labels jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_clean as cut


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """node and component (least node reachable) for every end of edges (a, b).

    Jumps halve the distance to the least node, so rounds grow with the logarithm of a path's length."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        up = labels.select(F.col("node").alias("_up"), F.col("component").alias("_to"))
        fresh = cut(
            spread.join(up, spread["component"] == up["_up"]).select("node", "old", F.least("component", "_to").alias("component")),
            "labels",
        )
        labels = fresh.select("node", "component")
        if fresh.filter("old != component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
