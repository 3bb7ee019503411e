"""Connected components by DataFrame joins, with no task that holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle


def components(edges: DataFrame) -> DataFrame:
    """a, b -> v, component (its smallest vertex), for every vertex with an edge.

    Each round takes the smallest label around a vertex and then the label of that label, so labels cross
    long chains in few rounds. Every round is written, which cuts the lineage.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"), "edges")
    labels = settle(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        met = labels.join(near, "v").select("v", "component", F.least("component", "near").alias("met"))
        up = labels.toDF("met", "up")
        after = settle(
            met.join(up, "met").select("v", F.least("met", "up").alias("component"), (F.least("met", "up") < F.col("component")).alias("moved")),
            "labels")
        moved = after.where("moved").limit(1).count()
        labels = after.select("v", "component")
        if not moved:
            return labels
