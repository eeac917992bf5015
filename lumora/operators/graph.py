"""Connected components by min-label passing with pointer jumping, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.sources.shared import kept


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for nodes (id) under edges (a, b). Each round is written, then read; rounds grow with the logarithm of the longest path. Nodes and edges are merged, never broadcast."""
    both = kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    now = kept(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("id", "b").hint("merge"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = now.join(near.hint("merge"), now.id == near.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = hooked.select(F.col("id").alias("p"), F.col("component").alias("pc"))
        jumped = kept(hooked.join(up.hint("merge"), hooked.component == up.p, "left").select("id", F.least("component", F.coalesce("pc", "component")).alias("component")), "labels")
        changed = jumped.withColumnRenamed("component", "c2").join(now.hint("merge"), "id").where("c2 != component")
        if changed.isEmpty():
            return jumped
        now = jumped
