"""Solving the fusion problem on a forest, and contracting what fuses.

A tree's shape goes with each block of features to one task, whose helper solves the block's columns. Blocks are
as wide as ``task_cells`` (nodes times features; a cell takes about 85 bytes of a task's memory) allows, and
this holds while no tree has more nodes than that. Larger trees are solved in pieces (``tree_pieces``), and no task
holds a tree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.operators.rooted_tree import node_type
from treefuse.operators.tree_pieces import lists, solve_in_pieces
from treefuse.operators.trees import Tree, up_sums
from treefuse.shared import cut, forget, mark, settle, tidy

TASK_CELLS = 3_000_000  # a quarter of a GB in a task


def tree_of(table: pa.Table) -> tuple[Tree, np.ndarray]:
    """A group's rows (node_id, parent_id, edge_weight, node_weight) as a Tree, in order of node_id."""
    ids = table.column("node_id").to_numpy()
    above = table.column("parent_id")
    has = above.is_valid().to_numpy()
    parent = np.full(len(ids), -1)
    parent[has] = np.searchsorted(ids, above.fill_null(0).to_numpy()[has])
    return Tree(parent, table.column("edge_weight").to_numpy(), table.column("node_weight").to_numpy()), ids


def matrix_of(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(n, -1)


def solve_blocks(cells: DataFrame, lam: float, largest: int, width: int, task_cells: int = TASK_CELLS) -> DataFrame:
    """cells(g, node_id, parent_id, edge_weight, node_weight, fb, x), where x has at most ``width`` features of block fb and
    no tree more than ``largest`` nodes -> g, node_id, parent_id, fb, x (solved), fused (in the block's features)."""
    if largest * width > task_cells:
        return solve_in_pieces(cells, lam, most=max(1, task_cells // width))
    kind = cells.schema["g"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        tree, _ = tree_of(table)
        theta, fused = tree.solve(matrix_of(table.column("x"), table.num_rows), lam)
        return pa.table({"g": table.column("g"), "node_id": table.column("node_id"), "parent_id": table.column("parent_id"), "fb": table.column("fb"), "x": lists(theta), "fused": pa.array(fused.all(1))})

    return cells.groupBy("g", "fb").applyInArrow(run, f"g {kind}, node_id bigint, parent_id bigint, fb int, x array<double>, fused boolean")


@tidy
def solve(nodes: DataFrame, lam: float, feature_block: int = 64, task_cells: int = TASK_CELLS) -> DataFrame:
    """nodes(g, node_id, parent_id, edge_weight, node_weight, x) -> g, node_id, parent_id, theta (array), fused.

    theta minimises, for each feature, sum w (x - theta)^2 / 2 + lam * sum e |theta - theta_parent|; fused says
    that a node's theta is its parent's in all features. A root is not fused.
    """
    if lam < 0:
        raise ValueError("lambda must not be negative")
    largest = nodes.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    feature_block = max(1, min(feature_block, task_cells // max(largest, 1)))
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"cast((greatest(size(x), 1) - 1) div {feature_block} as int)")), lambda b: F.struct(b.alias("fb"), F.slice(F.col("x"), b * feature_block + 1, feature_block).alias("x")))
    cells = nodes.select("g", "node_id", "parent_id", "edge_weight", "node_weight", F.explode(blocks).alias("b")).select("g", "node_id", "parent_id", "edge_weight", "node_weight", "b.fb", "b.x")
    done = solve_blocks(cells, lam, largest, feature_block, task_cells)
    parts = F.array_sort(F.collect_list(F.struct("fb", "x")))
    # Fused is judged over all features: one row a node.
    out = done.groupBy("g", "node_id").agg(F.first("parent_id").alias("parent_id"), parts.alias("p"), F.bool_and("fused").alias("fused"))
    return out.select("g", "node_id", "parent_id", F.flatten("p.x").alias("theta"), (F.col("fused") & F.col("parent_id").isNotNull()).alias("fused"))


@tidy
def solve_each(nodes: DataFrame, lambdas: Sequence[float], **options) -> DataFrame:
    """As ``solve``, for several penalties side by side: g becomes a struct of g and lambda, so each penalty has tasks of
    its own in the same jobs. A penalty scales its copy's edge weights. Equal penalties count once."""
    values = sorted({float(v) for v in lambdas})
    if not values or values[0] < 0:
        raise ValueError("there must be penalties, none of them negative")
    copies = nodes.withColumn("lambda", F.explode(F.array(*map(F.lit, values))))
    copies = cut(copies.select(F.struct("g", "lambda").alias("g"), "node_id", "parent_id", (F.col("edge_weight") * F.col("lambda")).alias("edge_weight"), "node_weight", "x"))
    return solve(copies, 1.0, **options)


def next_fusion(nodes: DataFrame) -> DataFrame:
    """nodes as for ``solve`` -> g, free: a penalty below which no node gets its parent's value in all features. As long as no
    edge of a feature changes its direction, each node moves by the pull of its edges; the feature that lasts longest counts."""
    up = nodes.select("g", F.col("node_id").alias("parent_id"), F.col("x").alias("__up"))
    both = nodes.where("parent_id is not null").join(up, ["g", "parent_id"])
    edges = both.select("g", "node_id", "parent_id", "edge_weight", F.posexplode(F.zip_with("__up", "x", lambda a, b: a - b)).alias("i", "gap"))
    edges = edges.withColumn("pull", F.col("edge_weight") * F.signum("gap"))
    pulls = edges.select("g", "i", "node_id", "pull").unionByName(edges.select("g", "i", F.col("parent_id").alias("node_id"), (-F.col("pull")).alias("pull")))
    speed = pulls.groupBy("g", "i", "node_id").agg(F.sum("pull").alias("pull")).join(nodes.select("g", "node_id", "node_weight"), ["g", "node_id"])
    speed = speed.select("g", "i", "node_id", (F.col("pull") / F.col("node_weight")).alias("speed"))
    above = speed.select("g", "i", F.col("node_id").alias("parent_id"), F.col("speed").alias("up_speed"))
    met = edges.join(speed, ["g", "i", "node_id"]).join(above, ["g", "i", "parent_id"])
    ranges = nodes.select("g", F.posexplode("x").alias("i", "v")).groupBy("g", "i").agg((1e-8 * (1 + F.max("v") - F.min("v"))).alias("near"))
    room, closing = F.abs("gap") - F.col("near"), (F.col("speed") - F.col("up_speed")) * F.signum("gap")
    time = F.when(room <= 0, 0.0).when(closing > 0, room / closing).otherwise(F.lit(float("inf")))
    return met.join(ranges, ["g", "i"]).groupBy("g", "i").agg(F.min(time).alias("t")).groupBy("g").agg(F.max("t").alias("free"))


def subtree_sums(nodes: DataFrame, task_cells: int = TASK_CELLS, most: int = 64) -> DataFrame:
    """nodes(g, node_id, parent_id, x) -> g, node_id, fb (a block's first feature), x: sums over the subtrees of nodes. A task
    holds a tree with a block of features; where no tree with one feature fits, each node's numbers go to all its ancestors,
    found by doubling."""
    largest = nodes.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    width = max(1, min(most, task_cells // max(largest, 1)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("x"), F.lit(1)) - 1, F.lit(width)), lambda b: F.struct(b.alias("fb"), F.slice(F.col("x"), b + 1, width).alias("x")))
    cells = nodes.select("g", "node_id", "parent_id", F.explode(blocks).alias("b")).select("g", "node_id", "parent_id", "b.fb", "b.x")
    if largest * width <= task_cells:
        kind = nodes.schema["g"].dataType.simpleString()

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("node_id")
            ids, above, total = table.column("node_id").to_numpy(), table.column("parent_id"), matrix_of(table.column("x"), table.num_rows).copy()
            has = np.flatnonzero(above.is_valid().to_numpy())
            parent = np.full(len(ids), -1)
            parent[has] = np.searchsorted(ids, above.fill_null(0).to_numpy()[has])
            depth = up_sums(parent, (parent >= 0).astype(np.int64))
            order = np.argsort(-depth, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(depth[order])) + 1, len(order))
            begin = 0
            for end in ends[:-1]:  # the deepest first; the last ones are roots
                level = order[begin:end]
                np.add.at(total, parent[level], total[level])
                begin = end
            return pa.table({"g": table.column("g"), "node_id": ids, "fb": table.column("fb"), "x": lists(total)})

        return cells.groupBy("g", "fb").applyInArrow(run, f"g {kind}, node_id bigint, fb int, x array<double>")
    sums, since = cut(cells.select("g", "node_id", "fb", "x")), mark()
    jump = cut(nodes.select("g", "node_id", F.col("parent_id").alias("to")).where("parent_id is not null"))
    while not jump.isEmpty():
        sent = sums.join(jump, ["g", "node_id"]).select("g", "to", "fb", F.posexplode("x").alias("i", "s")).groupBy("g", "to", "fb", "i").agg(F.sum("s").alias("s"))
        sent = sent.groupBy("g", F.col("to").alias("node_id"), "fb").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("more"))
        added = F.when(F.col("more").isNull(), F.col("x")).otherwise(F.zip_with("x", "more.s", lambda a, b: a + b))
        sums = cut(sums.join(sent, ["g", "node_id", "fb"], "left").select("g", "node_id", "fb", added.alias("x")))
        jump = cut(jump.join(jump.select("g", F.col("node_id").alias("to"), F.col("to").alias("far")), ["g", "to"]).select("g", "node_id", F.col("far").alias("to")))
        forget(since, sums, jump)
    return sums


@tidy
def certificate(solution: DataFrame, nodes: DataFrame, lam: float, tolerance: float = 1e-6, task_cells: int = TASK_CELLS) -> DataFrame:
    """g, feature_idx, violations: how many nodes break the optimality conditions of ``solve``. The problem is
    strictly convex, so none means that the solution is the minimiser."""
    joined = nodes.join(solution.select("g", "node_id", "theta"), ["g", "node_id"])
    flat = joined.select("g", "node_id", "parent_id", "edge_weight", "node_weight", F.posexplode(F.arrays_zip("x", "theta")).alias("feature_idx", "z"))
    flat = flat.select("g", "node_id", "parent_id", "edge_weight", "feature_idx", "z.theta", (F.col("node_weight") * (F.col("z.theta") - F.col("z.x"))).alias("r"), F.abs(F.col("z.x")).alias("size"))
    sums = subtree_sums(joined.select("g", "node_id", "parent_id", F.zip_with(F.zip_with("theta", "x", lambda t, v: t - v), F.array_repeat("node_weight", F.size("x")), lambda r, w: r * w).alias("x")), task_cells)
    above = flat.select("g", F.col("node_id").alias("parent_id"), "feature_idx", F.col("theta").alias("up"))
    scale = flat.groupBy("g", "feature_idx").agg((tolerance * (1 + F.sum("size"))).alias("eps"))
    sums = sums.select("g", "node_id", "fb", F.posexplode("x").alias("i", "s")).select("g", "node_id", (F.col("fb") + F.col("i")).alias("feature_idx"), "s")
    checked = flat.join(sums, ["g", "node_id", "feature_idx"]).join(above, ["g", "parent_id", "feature_idx"], "left").join(scale, ["g", "feature_idx"])
    bound, gap = F.lit(lam) * F.col("edge_weight"), F.col("theta") - F.col("up")
    bad = F.when(F.col("parent_id").isNull(), F.abs("s") > F.col("eps")).otherwise((F.abs("s") > bound + F.col("eps")) | ((F.abs(gap) > 1e-6) & (F.abs(F.col("s") + bound * F.signum(gap)) > F.col("eps"))))
    return checked.groupBy("g", "feature_idx").agg(F.count(F.when(bad, 1)).alias("violations"))


def fused_edges(theta: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """g, node_id, parent_id, theta -> the same with fused: equal to the parent's theta in all features."""
    up = theta.select("g", F.col("node_id").alias("parent_id"), F.col("theta").alias("__up"))
    same = F.forall(F.zip_with("theta", "__up", lambda a, b: F.abs(a - b) <= tolerance), lambda v: v)
    return theta.join(up, ["g", "parent_id"], "left").withColumn("fused", F.coalesce(same, F.lit(False))).drop("__up")


def representatives(fused: DataFrame) -> DataFrame:
    """g, node_id, parent_id, fused -> g, node_id, rep_id: the topmost ancestor that a node is fused with."""
    start = fused.select("g", "node_id", F.when(F.col("fused"), F.col("parent_id")).otherwise(F.col("node_id")).alias("rep_id"))
    return settle(start, ["g"], "node_id", "rep_id")


def contract_nodes(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """g, rep_id, weight, x: each cluster's summed weight and weighted mean (null features stay null)."""
    flat = nodes.join(reps, ["g", "node_id"]).select("g", "rep_id", "node_weight", F.posexplode("x").alias("i", "v"))
    means = flat.groupBy("g", "rep_id", "i").agg((F.sum(F.col("node_weight") * F.col("v")) / F.sum("node_weight")).alias("m"), F.sum("node_weight").alias("w"))
    rows = means.groupBy("g", "rep_id").agg(F.max("w").alias("weight"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("x"))
    return rows.select("g", "rep_id", "weight", F.col("x.m").alias("x"))


def contract_tree(tree: DataFrame, reps: DataFrame) -> DataFrame:
    """g, node_id, parent_id, edge_weight, n_children, node_type: representatives keep their own edge weight
    and get their parent's representative as parent."""
    kept = tree.join(reps, ["g", "node_id"]).where("node_id = rep_id").drop("rep_id")
    up = reps.select("g", F.col("node_id").alias("parent_id"), F.col("rep_id").alias("__p"))
    kept = kept.join(up, ["g", "parent_id"], "left").select("g", "node_id", F.col("__p").alias("parent_id"), "edge_weight")
    kids = kept.where("parent_id is not null").groupBy("g", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    out = kept.join(kids, ["g", "node_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return out.withColumn("node_type", node_type(F.col("n_children"), F.col("parent_id").isNull()))
