"""Connected components of a graph of any size: least labels travel along edges and jump along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemask.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (each link once). One row per vertex that has a link: v, component (the least vertex it reaches).

    A round takes the least label of a vertex and its neighbours, then that label's own label, so long chains halve. Labels are a written
    table after each round. A hub's rows fold before they are shuffled, and the adaptive plan splits its joins."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("component").alias("_near"))
        least = labels.join(near, labels["v"] == near["a"]).select("v", F.least("component", "_near").alias("_least"), F.col("component").alias("_was"))
        jump = labels.select(F.col("v").alias("_least"), F.col("component").alias("_jump"))
        now = least.join(jump, "_least").select("v", F.least("_least", "_jump").alias("component"), (F.least("_least", "_jump") != F.col("_was")).alias("_moved"))
        found = written(now, "labels")
        labels = found.select("v", "component")
        if found.where("_moved").isEmpty():
            return labels
