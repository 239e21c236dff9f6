"""Connected components of an edge table, by minimum labels and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that links reach) for every node of the edges ``a long, b long``."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("node"), F.col("c").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        # a root takes the lowest label that any of its members has met; then every node follows its root's root
        roots = lower.groupBy("component").agg(F.min("low").alias("root_low"))
        hooked = lower.join(roots, "component").select("node", F.least("low", "root_low").alias("component"), (F.least("low", "root_low") < F.col("component")).alias("changed"))
        step = materialize(hooked, "labels")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = materialize(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        if step.where("changed").isEmpty():
            return labels
