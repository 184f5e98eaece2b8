"""Connected components as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the undirected edges with the smallest node of its component.

    Labels start as the smallest neighbour; each round takes the smallest label around a node and then the label's own
    label (pointer jumping), so rounds grow with the logarithm of the diameter. Each round is written to the shared folder.
    First, of the edges from a node all but that to its smallest neighbour are moved to that neighbour, which joins the same
    nodes; where many nodes have the same few neighbours, they become one edge each.
    Hot nodes are combined map-side in the aggregate and split by AQE in the joins. Null ends are left out.
    """
    rows = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    least = rows.withColumn("least", F.min("v").over(Window.partitionBy("u")))
    moved = least.select("u", F.col("least").alias("v")).unionByName(least.select(F.col("least").alias("u"), "v")).where("u <> v")
    rows = moved.unionByName(rows.where("u = v"))
    both = materialize(rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component")), "labels")
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        lower = labels.join(around, labels["node"] == around["u"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        lower = materialize(lower, "lower")
        up = lower.select(F.col("node").alias("parent"), F.col("low").alias("up"))
        new = lower.join(up, lower["low"] == up["parent"]).select("node", F.least("low", "up").alias("component"), (F.least("low", "up") != F.col("was")).alias("moved"))
        new = materialize(new, "labels")
        if not new.where("moved").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
