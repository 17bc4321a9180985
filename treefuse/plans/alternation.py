"""What sparse and two-sided fits share: groups alternate side by side, each until its own objective settles.

Groups of at most ``task_cells`` cells (samples times features) do all their alternations in one task each. Larger
ones go on in Spark: each alternation is a few jobs over the states of all groups that have not settled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treefuse.shared import Pile, cut, forget, mark, tidy


def plus(a: str, b: str, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def pair_sum(values: Column) -> Column:
    """The sum of |a - b| over all pairs of an array, by sorting."""
    ordered, m = F.array_sort(values), F.size(values)
    return F.aggregate(F.transform(ordered, lambda v, i: v * (2 * (i + 1) - m - 1)), F.lit(0.0), lambda s, v: s + v)


def has_settled(before: float, loss: float, threshold: float) -> bool:
    return before == 0 or abs(loss - before) / before < threshold


def by_cells(nodes: DataFrame, task_cells: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The nodes of groups with at most ``task_cells`` cells, and those of larger groups; None where there are none."""
    sizes = cut(nodes.groupBy("g").agg((F.count(F.lit(1)) * F.max(F.size("x"))).alias("cells")))
    few, many = (sizes.where(f"cells {sign} {task_cells}").select("g") for sign in ("<=", ">"))
    if many.isEmpty():
        return nodes, None
    if few.isEmpty():
        return None, nodes
    return nodes.join(few, "g", "left_semi"), nodes.join(many, "g", "left_semi")


@tidy
def losses_of(state: DataFrame, objective: Callable[[DataFrame], DataFrame], before: DataFrame | None, threshold: float) -> DataFrame:
    """g, loss, settled: each group's objective, and whether it has changed by less than ``threshold`` since ``before``."""
    now = objective(state)
    if before is None:
        return cut(now.withColumn("settled", F.lit(False)))
    met = now.join(before.select("g", F.col("loss").alias("before")), "g")
    change = F.when(F.col("before") == 0, True).otherwise(F.abs(F.col("loss") - F.col("before")) / F.col("before") < threshold)
    return cut(met.select("g", "loss", change.alias("settled")))


def alternate(state: DataFrame, step: Callable[[DataFrame], DataFrame], objective: Callable[[DataFrame], DataFrame], most: int, threshold: float) -> DataFrame:
    """The states (with g) at which each group's objective changes by less than ``threshold``, or after ``most`` steps.

    ``step`` gives the next state, ``objective`` g and loss. Of the states only the last one is kept; groups that have
    settled are put aside, so the work shrinks with them.
    """
    done, since = Pile(state.sparkSession), mark()
    now = cut(state)
    losses = losses_of(now, objective, None, threshold)
    forget(since, now, losses)
    for i in range(most):
        then = cut(step(now).select(*now.columns))
        after = losses_of(then, objective, losses, threshold)
        sides = {r["settled"] for r in after.select("settled").distinct().collect()} if i < most - 1 else {True}
        if sides == {False}:
            now, losses = then, after
            forget(since, now, losses)
            continue
        if False not in sides:
            done.add(then)
            break
        done.add(then.join(after.where("settled"), "g", "left_semi"))
        now = cut(then.join(after.where("NOT settled"), "g", "left_semi"))
        losses = cut(after.where("NOT settled"))
        forget(since, now, losses)
    return done.read() if done.schema else now
