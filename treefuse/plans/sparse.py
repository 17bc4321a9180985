"""The fit that drops noise features: columns are shrunk and fused in turn until the objective settles.

Columns do not exchange data within an alternation; only the stop rule joins them. A group of at most ``task_cells``
cells alternates in one task. A larger one alternates in Spark: norms of columns, a solve by blocks of features (in pieces of
the tree where it is too large for a task), and the objective are sums over its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treefuse.operators import fusion
from treefuse.operators.kernels import shrink_factor, sparse_loss, sparse_step
from treefuse.plans.alternation import alternate, by_cells, has_settled, pair_sum, plus
from treefuse.plans.path import TASK_CELLS, checked, start_nodes
from treefuse.shared import Pile, cut, forget, mark, tidy
from treefuse.sources.matrix import Fit


def factor_of(norm: Column, lam: float, most: int) -> Column:
    """What the shrinkage multiplies a column of this norm by. Only the norm decides; the recursion runs on one number."""

    @F.pandas_udf("double")
    def factor(norm: pd.Series) -> pd.Series:
        return norm.map(lambda v: shrink_factor(float(v), lam, most))

    return factor(norm)


def column_shrink(columns: DataFrame, lam: float, most: int = 100) -> DataFrame:
    """g, feature_idx, values -> the same with ``factor``, by which the shrinkage multiplies the column, and
    ``values`` shrunk."""
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v))
    return columns.withColumn("factor", factor_of(norm, lam, most)).withColumn("values", F.transform("values", lambda v: v * F.col("factor")))


def sparse_objective(rows: DataFrame, lam: float, gamma: float) -> DataFrame:
    """rows(g, x: data, u: solution) -> g, loss: half the squared error + lam * pairwise differences within
    rows + gamma * row norms."""
    error = F.aggregate(F.zip_with("x", "u", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, v: s + v * v))
    return rows.groupBy("g").agg(F.sum(0.5 * error + lam * pair_sum(F.col("u")) + gamma * norm).alias("loss"))


@tidy
def settled(nodes: DataFrame, lam: float, gamma: float, most: int = 500, threshold: float = 1e-5, task_cells: int = TASK_CELLS, solve_cells: int = fusion.TASK_CELLS) -> DataFrame:
    """nodes(g, node_id, parent_id, edge_weight, node_weight, x) -> the same rows with u, each group's at which its own
    objective has settled. ``solve_cells`` bounds what an alternation in Spark puts into a task."""
    small, large = by_cells(nodes, task_cells)
    sides = []
    if small is not None:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("node_id")
            tree, _ = fusion.tree_of(table)
            x = fusion.matrix_of(table.column("x"), table.num_rows)
            u, p, q = x, np.zeros_like(x), np.zeros_like(x)
            before = sparse_loss(x, u, lam, gamma)
            for _ in range(most):
                u, p, q = sparse_step(tree, u, p, q, lam, gamma, most)
                loss = sparse_loss(x, u, lam, gamma)
                if has_settled(before, loss, threshold):
                    break
                before = loss
            return table.append_column("u", fusion.lists(u))

        sides.append(small.groupBy("g").applyInArrow(run, f"{fields}, u array<double>"))
    if large is not None:
        zero = F.transform("x", lambda _: F.lit(0.0))
        step = lambda now: next_state(now, lam, gamma, most, solve_cells)
        last = alternate(large.withColumns({"u": F.col("x"), "p": zero, "q": zero}), step, lambda now: sparse_objective(now, lam, gamma), most, threshold)
        sides.append(last.drop("p", "q"))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def next_state(now: DataFrame, lam: float, gamma: float, most: int, solve_cells: int) -> DataFrame:
    """One alternation of whole groups: each column shrunk by its norm, then fused along the tree."""
    z = now.withColumn("z", plus("u", "p"))
    norms = z.select("g", F.posexplode("z").alias("i", "v")).groupBy("g", "i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    factors = norms.withColumn("f", factor_of(F.col("norm"), gamma, most)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "f"))).alias("f"))
    # A row a group, written, so that Spark knows its size and sends it to the rows where it is small.
    met = z.join(cut(factors.select("g", F.col("f.f").alias("f"))), "g").withColumn("y", F.zip_with("z", "f", lambda v, f: v * f))
    half = cut(met.withColumns({"p": plus("z", "y", -1), "w": plus("y", "q")}).drop("u", "q", "y", "z", "f"))
    solved = fusion.solve(half.withColumn("x", F.col("w")), lam, task_cells=solve_cells).select("g", "node_id", F.col("theta").alias("u"))
    return half.join(solved, ["g", "node_id"]).withColumn("q", plus("w", "u", -1))


def nonzero_features(rows: DataFrame, column: str = "u", keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature_idx (from 0) of the columns whose sum is not 0."""
    return rows.select(*keys, F.posexplode(column).alias("feature_idx", "v")).groupBy(*keys, "feature_idx").agg(F.sum("v").alias("s")).where("s != 0").select(*keys, "feature_idx")


@tidy
def fit_sparse(samples: DataFrame, lambdas: Sequence[float], gammas: Sequence[float], most: int = 500, threshold: float = 1e-5, task_cells: int = TASK_CELLS, solve_cells: int = fusion.TASK_CELLS, **options) -> Fit:
    """samples -> Fit with ``features``: the indices that are left after each level. Each group loses features of its own
    and goes on until it is one cluster or the penalties end. A group with one feature or one sample left is not solved."""
    values = checked(lambdas, gammas)
    live = start_nodes(samples, **options)
    none = F.expr("cast(array() as array<int>)")
    wide = live.groupBy("g").agg(F.max(F.size("x")).alias("p"))
    left = cut(wide.select("g", F.when(F.col("p") > 0, F.sequence(F.lit(0), F.col("p") - 1)).otherwise(none).alias("left")))
    levels, pointers, coordinates, kept = (Pile(samples.sparkSession) for _ in range(4))
    since = mark()
    for i, (lam, gamma) in enumerate(zip(values, gammas, strict=True)):
        at = F.lit(i + 1).alias("level")
        sizes = live.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"))
        work = cut(sizes.where("n > 1 AND p > 1").select("g"))
        solved = settled(live.join(work, "g", "left_semi"), lam, float(gamma), most, threshold, task_cells, solve_cells)
        solved = cut(solved.unionByName(live.join(work, "g", "left_anti").withColumn("u", F.col("x"))))
        stay = nonzero_features(solved, keys=["g"]).groupBy("g").agg(F.sort_array(F.collect_list("feature_idx")).alias("stay"))
        left = left.join(stay, "g", "left").withColumn("stay", F.coalesce("stay", none))
        left = cut(left.select("g", "stay", F.transform("stay", lambda j: F.get("left", j)).alias("left")))
        pick = lambda c: F.transform("stay", lambda j: F.get(F.col(c), j))
        solved = cut(solved.join(left.select("g", "stay"), "g").withColumns({"x": pick("x"), "u": pick("u")}).drop("stay"))
        reps = cut(fusion.representatives(fusion.fused_edges(solved.select("g", "node_id", "parent_id", F.col("u").alias("theta")), 1e-9)))
        weight = solved.join(reps, ["g", "node_id"]).groupBy("g", "rep_id").agg(F.sum("node_weight").alias("weight"))
        means = fusion.contract_nodes(solved, reps).select("g", "rep_id", "x")  # no row where no feature is left
        merged = cut(weight.join(means, ["g", "rep_id"], "left").withColumn("x", F.coalesce("x", F.expr("cast(array() as array<double>)"))))
        counts = cut(reps.groupBy("g").agg(F.count(F.lit(1)).alias("n_in"), F.count(F.when(F.col("node_id") == F.col("rep_id"), 1)).alias("n_out")))
        levels.add(counts.select("g", at, F.lit(lam).alias("lambda"), F.lit(float(gamma)).alias("gamma"), "n_in", "n_out"))
        pointers.add(reps.select("g", at, "node_id", "rep_id"))
        coordinates.add(merged.select("g", at, "rep_id", "weight", "x"))
        kept.add(left.select("g", at, F.explode("left").alias("feature_idx")))
        going = counts.where("n_out > 1").select("g")
        tree = fusion.contract_tree(solved.select("g", "node_id", "parent_id", "edge_weight"), reps)
        live = tree.join(merged.withColumnRenamed("rep_id", "node_id"), ["g", "node_id"]).join(going, "g", "left_semi")
        live = cut(live.select("g", "node_id", "parent_id", "edge_weight", F.col("weight").alias("node_weight"), "x"))
        left = cut(left.join(going, "g", "left_semi").select("g", "left"))
        forget(since, live, left)
        if live.isEmpty():
            break
    return Fit(levels.read(), pointers.read(), coordinates.read(), kept.read())


def expand_features(expanded: DataFrame, features: DataFrame, p: int) -> DataFrame:
    """g, level, sample_id, theta over the surviving features -> theta over all p, null where one was dropped."""
    kept = features.groupBy("g", "level").agg(F.sort_array(F.collect_list("feature_idx")).alias("kept"))
    every = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.when(F.array_contains("kept", j), F.get("theta", F.array_position("kept", j).cast("int") - 1)))
    return expanded.join(kept, ["g", "level"], "left").select("g", "level", "sample_id", every.alias("theta"))


