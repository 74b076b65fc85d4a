"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (one of its nodes, the same for all) for every node that an edge
    (columns a, b) touches. A round maps each node to the smallest of itself and its neighbours and
    carries the edges over, until none is left between different nodes; with ids that don't follow
    the links' order that takes a number of rounds logarithmic in the longest chain. An edge with a null end
    and one from a node to itself are ignored; without edges there are no rows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    live = saved(both, "edges")
    labels = None
    while not live.isEmpty():
        step = saved(live.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("to")), "step")
        if labels is None:
            labels = step.withColumnRenamed("a", "node").withColumnRenamed("to", "component")
        else:
            moved = labels.join(step, labels["component"] == step["a"], "left")
            labels = saved(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        other = step.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        live = saved(live.join(step, "a").join(other, "b").select(F.col("to").alias("a"), F.col("b_to").alias("b")).filter("a <> b").distinct(), "edges")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels
