"""Connected components of an undirected graph by spreading least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its least node.

    Each round gives a node the least label of its neighbours, then the label of that label; long chains halve. Edges within one
    label are dropped. Tables of every round are written, so a round is never computed twice.
    """
    edges = stored(edges.where("a <> b").distinct(), "graph-edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("component")), "graph-labels")
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
        between = stored(edges.join(a, "a").join(b, "b").where("x <> y").select("x", "y").distinct(), "graph-between")
        if between.isEmpty():
            return labels
        # Labels are nodes themselves: hook each to the least label next to it, then follow the hooks.
        both = between.unionByName(between.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hooks = stored(both.groupBy("x").agg(F.min("y").alias("y")).where("y < x"), "graph-hooks")
        while True:
            up = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            jumped = hooks.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved"))
            jumped = stored(jumped, "graph-hooks")
            hooks = jumped.select("x", "y")
            if jumped.where("moved").isEmpty():
                break
        moved = labels.join(hooks, F.col("component") == F.col("x"), "left")
        labels = stored(moved.select("node", F.coalesce("y", "component").alias("component")), "graph-labels")
