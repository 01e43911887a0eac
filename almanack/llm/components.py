"""Connected components by distributed label passing; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanack.llm.session import drop, write


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node reachable.

    Each round every node takes the least label among its own, its neighbours' and its label's
    label; sums are made before each shuffle, and each round is written to the shared folder, from
    where drop() can delete the last one. The
    number of rounds grows with the logarithm of a component's diameter.
    """
    both = write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        up = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.label").alias("label"))
        new = near.unionByName(up).groupBy("node").agg(F.min("label").alias("new"))
        step = write(labels.join(new, "node").select("node", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        drop(labels)
        labels = step.select("node", "label")
        labels.almanack_path = step.almanack_path
        if not step.where("moved").limit(1).count():
            drop(both)
            return labels
