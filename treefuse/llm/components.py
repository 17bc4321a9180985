"""Connected components by alternating star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.llm.shared import cut


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """edges(a, b) -> node, component: each node that has an edge to another, with the smallest node that it
    reaches. Edges become stars within about log(nodes) rounds; each round is cut from its lineage. A hub
    only ever stands on one side of a join whose other side has one row for it."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(now)
    for _ in range(most):
        # Large star: larger neighbours go to the smallest node of the neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours, and the node itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.where("u != v").distinct())
        if (after := print_of(now)) == before:
            return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"components are not settled after {most} rounds")
