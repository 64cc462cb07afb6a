"""Connected components of an edge list, by smallest labels and pointer jumping over stored tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattlens.plans.staging import stage


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node that links reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so a chain of n nodes needs
    about log n rounds. Every round is written to the shared folder. A hub's edges meet its one label row in a join
    that the optimizer may split, and labels are pre-aggregated before they move. No edges: no rows.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_near")))
        step = labels.join(near, "node").select("node", F.col("label").alias("_old"),
                                                F.least("label", "_near").alias("_new"))
        jumped = step.join(labels.select(F.col("node").alias("_new"), F.col("label").alias("_jump")), "_new")
        labels = stage(jumped.select("node", F.least("_new", "_jump").alias("label"),
                                     (F.least("_new", "_jump") != F.col("_old")).alias("_moved")), "labels")
        if labels.filter("_moved").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
