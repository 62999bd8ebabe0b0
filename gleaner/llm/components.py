"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, root): root is the smallest node reachable; only nodes that have an edge appear.

    Each round takes the least label among the neighbours and then the label of that label, so chains halve and a round
    costs two joins on the edges.  Labels are written to the shared folder after each round; a hub's neighbours are
    combined before the shuffle, and its edges and the nodes of a large component's label are dealt over tasks.  No edge
    or label reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = staged(both, "cc-edges")
    degrees = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")), "cc-degrees")
    hubs = hot_keys(degrees, ["node"]).withColumnRenamed("node", "b")
    labels = degrees.select("node", F.least("node", "least").alias("root"))
    for _ in range(most_rounds):
        near = spread_join(both, labels.withColumnRenamed("node", "b"), ["b"], hubs, F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        step = staged(step, "cc-step")
        # The label of the label: labels are nodes, so every one has a row.
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        large = hot_keys(step.groupBy("root").agg(F.count(F.lit(1)).alias("n")), ["root"])
        new = staged(spread_join(step, jump, ["root"], large, F.col("node")).select("node", "old", F.least("root", "further").alias("root")), "cc-labels")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
