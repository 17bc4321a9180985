"""Rooting a forest at the smallest node of each group.

Each edge becomes two arcs; behind the arc u -> v comes the arc from v to v's next neighbour after u, which
strings all arcs of a tree on one tour. Pointer doubling counts how many arcs each arc has behind it, in
about log(n) self-joins whatever the tree's depth. Of an edge's two arcs the earlier one goes down, and the
distance between them is twice the size of what hangs below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treefuse.functions.weights import adjacency
from treefuse.operators.kernels import root_at_smallest
from treefuse.shared import cut, mark, recut, tidy


def node_type(n_children, is_root):
    """0 leaf, 1 one child, 2 several, 3 root with one child, 4 any other root."""
    return F.when(is_root, F.when(n_children == 1, 3).otherwise(4)).otherwise(F.least(n_children, F.lit(2))).cast("int")


@tidy
def rooted(edges: DataFrame, task_edges: int = 2_000_000) -> DataFrame:
    """g, u, v, dist, weight -> g, node_id, parent_id (null: root), dist, edge_weight (root: 0), subtree_size.

    While no group has more than ``task_edges`` edges, each is rooted in one task; larger trees by the tour.
    """
    most = edges.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    if most <= task_edges:
        kind = edges.schema["g"].dataType.simpleString()

        def run(table: pa.Table) -> pa.Table:
            ids, parent, via, size = root_at_smallest(table.column("u").to_numpy(), table.column("v").to_numpy())
            none = parent < 0
            take = lambda c: np.where(none, 0.0, table.column(c).to_numpy()[np.maximum(via, 0)])
            g = pa.array([table.column("g")[0].as_py()] * len(ids), table.schema.field("g").type)
            return pa.table({"g": g, "node_id": ids, "parent_id": pa.array(ids[np.maximum(parent, 0)], mask=none), "dist": take("dist"), "edge_weight": take("weight"), "subtree_size": size})

        return edges.select("g", "u", "v", "dist", "weight").groupBy("g").applyInArrow(run, f"g {kind}, node_id bigint, parent_id bigint, dist double, edge_weight double, subtree_size bigint")
    arcs = adjacency(edges.select("g", "u", "v", "dist", "weight"))
    around = Window.partitionBy("g", "node").orderBy("nbr")
    ring = arcs.withColumn("next", F.coalesce(F.lead("nbr").over(around), F.first("nbr").over(around)))
    root = arcs.groupBy("g").agg(F.min("node").alias("root"))
    starts = root.join(arcs.groupBy("g", "node").agg(F.min("nbr").alias("low")), "g").where("node = root").select("g", "root", "low")
    # Behind (u -> v) comes (v -> the neighbour after u); the tour ends before it would start again.
    behind = ring.select("g", F.col("nbr").alias("u"), F.col("node").alias("v"), F.col("node").alias("su"), F.col("next").alias("sv"))
    behind = behind.join(starts, "g")
    last = (F.col("su") == F.col("root")) & (F.col("sv") == F.col("low"))
    since = mark()
    tour = cut(behind.select("g", "u", "v", F.when(~last, F.col("su")).alias("su"), F.when(~last, F.col("sv")).alias("sv"), F.when(last, 0).otherwise(1).cast("bigint").alias("left")))
    while not tour.where("su is not null").isEmpty():
        hop = tour.select("g", F.col("u").alias("su"), F.col("v").alias("sv"), F.col("su").alias("tu"), F.col("sv").alias("tv"), F.col("left").alias("more"))
        tour = recut(since, tour.join(hop, ["g", "su", "sv"], "left").select("g", "u", "v", F.col("tu").alias("su"), F.col("tv").alias("sv"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    down = tour.select("g", F.col("u").alias("parent_id"), F.col("v").alias("node_id"), F.col("left").alias("down"))
    up = tour.select("g", F.col("u").alias("node_id"), F.col("v").alias("parent_id"), F.col("left").alias("up"))
    both = down.join(up, ["g", "node_id", "parent_id"]).where("down > up")
    known = adjacency(edges).select("g", F.col("node").alias("node_id"), F.col("nbr").alias("parent_id"), "dist", "weight")
    below = both.join(known, ["g", "node_id", "parent_id"]).select("g", "node_id", "parent_id", "dist", F.col("weight").alias("edge_weight"), F.expr("(down - up + 1) div 2").cast("bigint").alias("subtree_size"))
    tops = root.join(edges.groupBy("g").agg((F.count(F.lit(1)) + 1).alias("subtree_size")), "g").select("g", F.col("root").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0.0).alias("dist"), F.lit(0.0).alias("edge_weight"), "subtree_size")
    return below.unionByName(tops)


def with_shape(tree: DataFrame) -> DataFrame:
    """Adds n_children, node_type and balance: how many nodes the edge above a node cuts off on its smaller
    side. A root's is 1 if it has one child, else 1 + its nearest child's subtree, also on the smaller side."""
    child = F.struct("dist", "node_id", "subtree_size")
    kids = tree.where("parent_id is not null").groupBy("g", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"), F.min(child).alias("nearest"))
    sizes = tree.groupBy("g").agg(F.max("subtree_size").alias("n"))
    all_ = tree.join(kids, ["g", "node_id"], "left").join(sizes, "g").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    is_root = F.col("parent_id").isNull()
    side = F.when(is_root & (F.col("n_children") <= 1), F.lit(1)).when(is_root, 1 + F.col("nearest.subtree_size")).otherwise(F.col("subtree_size"))
    return all_.withColumns({"node_type": node_type(F.col("n_children"), is_root), "balance": F.least(side, F.col("n") - side)}).drop("nearest", "n")


@tidy
def with_depth(tree: DataFrame) -> DataFrame:
    """Adds depth (root: 0) by pointer doubling, about log(depth) self-joins."""
    since = mark()
    now = cut(tree.select("g", "node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth")))
    while not now.where("up is not null").isEmpty():
        hop = now.select("g", F.col("node_id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        now = recut(since, now.join(hop, ["g", "up"], "left").select("g", "node_id", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return tree.join(now.select("g", "node_id", "depth"), ["g", "node_id"])
