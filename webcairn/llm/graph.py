"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge.

    Each round a node takes the least label around it and then the label of that label,
    so labels travel twice as far per round; rounds end when none changes.  Labels are
    tables in the shared folder, aggregates combine before the shuffle.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialize(both.union(both.select("other", "node")).distinct())
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        jumped = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select(
            "node", F.least("label", F.coalesce("up", "label")).alias("label")
        )
        around = (
            both.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        after = materialize(jumped.unionByName(around).groupBy("node").agg(F.min("label").alias("label")))
        changed = after.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty()
        labels = after
        if changed:
            return labels.select("node", F.col("label").alias("component"))
