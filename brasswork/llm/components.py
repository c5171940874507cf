"""Connected components of an undirected graph, kept distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.llm.common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """node, label: the least node of its component, for each node of edges (a, b).

    Each turn a node takes the least label of its neighbours, then the label of its label's node. Messages to a node
    are combined before they are shuffled, so that a node with many neighbours does no harm; what a turn gives is
    written to the shared folder. Raises RuntimeError if `most` turns are not enough.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    for turn in range(1, most + 1):
        sent = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("heard"))
        lower = labels.join(sent, F.col("node") == F.col("b"), "left").select("node", "label", F.least("label", "heard").alias("heard"))
        ends = labels.select(F.col("node").alias("end"), F.col("label").alias("beyond"))
        jumped = lower.join(ends, F.col("heard") == F.col("end"), "left").select("node", F.least("heard", "beyond").alias("label"), F.col("label").alias("before"))
        new = scratch.keep(jumped, f"{name}-{turn}")
        changed = new.where("label <> before").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
    raise RuntimeError(f"components are not found after {most} turns")
