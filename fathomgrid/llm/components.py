"""Connected components of an edge list by joins alone: nothing is collected, lineage is cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.session import cut_lineage


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges (x, y) -> (node, component), the component being its smallest node.

    Every round each node takes the smallest label among itself and its neighbours and then its
    label's label (pointer jumping), so the number of rounds grows with the logarithm of a
    component's diameter.  Raises if ``rounds`` don't do.
    """
    both = cut_lineage(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label"))
    labels = cut_lineage(labels)
    for _ in range(rounds):
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        up = step.select(F.col("node").alias("up"), F.col("new").alias("up_label"))
        jumped = step.join(up, step["new"] == up["up"], "left").select("node", F.least("new", F.coalesce("up_label", "new")).alias("label"), "old")
        jumped = cut_lineage(jumped)
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
