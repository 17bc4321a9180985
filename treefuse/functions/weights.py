"""From tree edges to weights (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.functions.quantiles import exact_quantiles


def normalise(edges: DataFrame) -> DataFrame:
    """Lengths divided by the root of their mean square. A group whose lengths are all 0 keeps them."""
    mean = edges.groupBy("g").agg(F.avg(F.col("dist") * F.col("dist")).alias("__m"))
    return edges.join(mean, "g").withColumn("dist", F.coalesce(F.sqrt(F.col("dist") * F.col("dist") / F.nullif("__m", F.lit(0.0))), F.lit(0.0))).drop("__m")


def bandwidth(edges: DataFrame) -> DataFrame:
    """g, bandwidth: the median of squared lengths (exact)."""
    return exact_quantiles(edges.select("g", (F.col("dist") * F.col("dist")).alias("d2")), "d2", [0.5]).select("g", F.col("q").alias("bandwidth"))


def gaussian(edges: DataFrame, width: DataFrame | float) -> DataFrame:
    """edges with weight = exp(-dist^2 / bandwidth). A bandwidth of 0 gives 1 for length 0, else 0."""
    if isinstance(width, DataFrame):
        edges = edges.join(width, "g")
    else:
        edges = edges.withColumn("bandwidth", F.lit(float(width)))
    d2 = F.col("dist") * F.col("dist")
    flat = F.when(d2 == 0, 1.0).otherwise(0.0)
    return edges.withColumn("weight", F.when(F.col("bandwidth") == 0, flat).otherwise(F.exp(-d2 / F.col("bandwidth")))).drop("bandwidth")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: g, node, nbr, dist and whatever else an edge carries."""
    rest = [c for c in edges.columns if c not in ("g", "u", "v")]
    return edges.select("g", F.col("u").alias("node"), F.col("v").alias("nbr"), *rest).unionByName(edges.select("g", F.col("v").alias("node"), F.col("u").alias("nbr"), *rest))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """g, node, neighbours: array of (dist, nbr), nearest first."""
    return adjacency(edges).groupBy("g", "node").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr"))).alias("neighbours"))


def outlier_floor(tree: DataFrame, depth_thresh: int = 10, prob_thresh: float = 0.1) -> DataFrame:
    """Nodes that cut off fewer than ``depth_thresh`` others get at least the ``prob_thresh`` quantile of such
    nodes' edge weights. The root's 0 counts among them where its balance is that small."""
    floor = exact_quantiles(tree.where(F.col("balance") < depth_thresh), "edge_weight", [prob_thresh]).select("g", F.col("q").alias("__floor"))
    lifted = F.when((F.col("balance") < depth_thresh) & F.col("parent_id").isNotNull(), F.greatest("edge_weight", "__floor")).otherwise(F.col("edge_weight"))
    return tree.join(floor, "g", "left").withColumn("edge_weight", lifted).drop("__floor")
