"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import cut


def components(edges: DataFrame) -> DataFrame:
    """a, b (longs) -> node, component: the smallest node that can be reached. Only nodes with edges.

    Each round gives a node the smallest among its own label, its neighbours' and its label's label, so
    that long chains halve. Rounds end when no label changes; only a count of changes reaches the
    driver. A round is one plan and one checkpoint, which keeps the driver's record of plans short.
    Minima are taken map-side first, so a node with many edges is no single task's load.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        own = labels.select("node", F.col("component").alias("old"), "component")
        known = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        none = F.lit(None).cast("long")
        near = both.join(known, both["b"] == known["_n"]).select(F.col("a").alias("node"), none.alias("old"), "_c")
        jump = labels.join(known, labels["component"] == known["_n"]).select("node", none.alias("old"), "_c")
        moved = cut(own.union(near).union(jump).groupBy("node").agg(F.max("old").alias("old"), F.min("component").alias("component")))
        labels = moved.select("node", "component")
        if not moved.where("old <> component").limit(1).count():
            return labels
