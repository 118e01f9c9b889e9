"""Connected components of an edge table, by repeated smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropscan.session import stored


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for every node of the (a, b) edges: the smallest node it is joined with.

    Each round takes the smallest label next to a node and then the label of that label, so
    that a chain of n nodes takes about log n rounds. Every round is a table in the shared
    folder; the driver sees one number a round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, f"{name}-edges")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")),
        name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = stored(better.join(jump, "new").select("node", "label", F.least("new", "far").alias("new")), name)
        changed = step.where("new < label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
