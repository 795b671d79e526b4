"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest
    node that can be reached. Each round takes the smallest label among a
    node and its neighbours, then the label of that label, so long chains
    halve; labels are written every round and rounds end when none
    changes. An edgeless graph gives no rows; loops and repeated edges do
    no harm."""
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low"))
                           .select("node", F.least("node", "_low").alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        of_label = labels.select(F.col("node").alias("comp"), F.col("comp").alias("_comp2"))
        jumped = scratch.write(labels.join(of_label, "comp")
                               .select("node", F.col("_comp2").alias("comp")), f"{name}-jump-{step}")
        near = both.join(jumped.select(F.col("node").alias("b"), "comp"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        new = scratch.write(jumped.join(near, "node").select(
            "node", F.least("comp", "_near").alias("comp"),
            (F.col("_near") < F.col("comp")).alias("_changed")), f"{name}-{step}")
        changed = not new.where("_changed").isEmpty()
        new = new.drop("_changed")
        moved = changed or not new.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("_comp2")),
                                        "comp").where("_comp2 <> comp").isEmpty()
        scratch.drop(f"{name}-{step - 1}", f"{name}-jump-{step}")
        labels = new
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
