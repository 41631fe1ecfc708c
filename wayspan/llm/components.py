"""Connected components by least labels with pointer jumping, over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its least node.

    Labels are written to the shared folder each round. With ``rounds`` it stops early, and labels are then nodes of
    the same component that may not be the least yet.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    label = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "label0")
    i = 0
    while rounds is None or i < rounds:
        i += 1
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near, label.node == near.a).select("node", "component", F.least("component", "m").alias("c"))
        up = label.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = new.join(up, "c").select("node", F.least("c", "up").alias("new"), F.col("component").alias("old"))
        new = scratch.write(new, f"step{i}")
        moved = new.filter("new <> old").limit(1).count()
        scratch.drop(f"label{i - 1}" if i == 1 else f"step{i - 1}")
        label = new.select("node", F.col("new").alias("component"))
        if not moved:
            break
    return label
