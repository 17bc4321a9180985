"""Labels and dendrogram tables from a fit's pointers (joins and windows; one small helper for leaf order)."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treefuse.plans.path import compose
from treefuse.operators.tree_pieces import subtree_sizes
from treefuse.shared import cut, mark, recut, running_sums, settle, tidy
from treefuse.sources.matrix import Fit


def force_merge(fit: Fit, factor: float) -> Fit:
    """A fit that ends in several clusters gets one more level, at ``factor`` times its last penalty, in which
    all join the smallest. Labels use 2, dendrograms 1.5."""
    last = fit.levels.groupBy("g").agg(F.max_by(F.struct("level", "lambda", "gamma", "n_out"), "level").alias("l")).where("l.n_out > 1").select("g", "l.*")
    level = last.select("g", (F.col("level") + 1).alias("level"), (F.col("lambda") * factor).alias("lambda"), "gamma", F.col("n_out").alias("n_in"), F.lit(1).cast("bigint").alias("n_out"))
    every = fit.pointers.select("g", F.col("node_id").alias("n")).distinct()
    gone = fit.pointers.where("node_id != rep_id").select("g", F.col("node_id").alias("n")).distinct()
    left = every.join(gone, ["g", "n"], "left_anti").join(last.select("g", (F.col("level") + 1).alias("level")), "g")
    # Where nothing ever fused there are no pointers to tell the nodes from; such a group is left as it is.
    top = left.groupBy("g").agg(F.min("n").alias("rep_id"))
    more = left.join(top, "g").select("g", "level", F.col("n").alias("node_id"), "rep_id")
    # Labels and dendrograms ask for both several times.
    return Fit(cut(fit.levels.unionByName(level)), cut(fit.pointers.unionByName(more)), fit.coordinates, fit.features, fit.pointers_f)


def start_level(levels: DataFrame, show: int = 100) -> DataFrame:
    """g, level: the first level that fewer than ``show`` nodes enter, at most the last but one, at least 1."""
    found = levels.groupBy("g").agg(F.min(F.when(F.col("n_in") < show, F.col("level"))).alias("first"), F.max("level").alias("last"))
    return found.select("g", F.greatest(F.lit(1), F.least(F.coalesce("first", "last"), F.col("last") - 1)).alias("level"))


@tidy
def merge_table(pointers: DataFrame, levels: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """g, step, left, right, height, rep_id: the merges of all levels after ``after`` (g, level; default 0).

    Leaves are the nodes that enter the first of these levels, numbered from 1 by id and written as negative
    numbers; merges are written as their step. A cluster of several members is a chain at the level's
    penalty: without an earlier merge among them, the first with the second and then each next one with the
    chain; else, beginning with the latest earlier merge, each other member with the chain. Clusters go by
    level, then id.
    """
    after = levels.select("g").distinct().withColumn("after", F.lit(0)) if after is None else after.withColumnRenamed("level", "after")
    used = pointers.join(after, "g").where("level > after").drop("after")
    leaves = running_sums(used.select("g", "node_id").distinct(), ["g"], ["node_id"], "leaf")
    sized = used.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("g", "level", "rep_id"))).where("members > 1")
    clusters = sized.groupBy("g", "level", "rep_id").agg(F.count(F.lit(1)).alias("members"))
    clusters = cut(running_sums(clusters, ["g"], ["level", "rep_id"], "last", F.col("members") - 1))
    # What a member is called: the last step of the latest earlier cluster that it stands for, else its leaf.
    earlier = clusters.select("g", F.col("rep_id").alias("node_id"), F.col("level").alias("made"), F.col("last").alias("step"))
    named = sized.join(earlier, ["g", "node_id"], "left").groupBy("g", "level", "rep_id", "node_id").agg(F.max(F.when(F.col("made") < F.col("level"), F.col("step"))).alias("step"))
    named = named.join(leaves, ["g", "node_id"]).select("g", "level", "rep_id", "node_id", F.coalesce("step", -F.col("leaf")).alias("name"))
    of = Window.partitionBy("g", "level", "rep_id")
    named = named.withColumns({"top": F.max("name").over(of), "i": F.row_number().over(of.orderBy("node_id"))})
    base = F.when(F.col("top") > 0, F.col("name") == F.col("top")).otherwise(F.col("i") == 2)
    named = named.withColumn("base", base).withColumn("start", F.max(F.when(F.col("base"), F.col("name"))).over(of))
    others = named.where(~F.col("base")).withColumn("k", F.row_number().over(of.orderBy("node_id")))
    out = others.join(clusters.select("g", "level", "rep_id", "members", "last"), ["g", "level", "rep_id"]).join(levels.select("g", "level", "lambda"), ["g", "level"])
    step = F.col("last") - F.col("members") + 1 + F.col("k")
    return out.select("g", step.cast("bigint").alias("step"), F.col("name").cast("bigint").alias("left"), F.when(F.col("k") == 1, F.col("start")).otherwise(step - 1).cast("bigint").alias("right"), F.col("lambda").alias("height"), "rep_id")


@tidy
def leaf_order(merges: DataFrame, task_merges: int = 100_000) -> DataFrame:
    """g, pos (from 1), leaf: an order in which no branches cross, each merge's left part before its right one. Where a group has
    more than ``task_merges`` merges, all are ordered by joins."""
    kind = merges.schema["g"].dataType.simpleString()
    if (merges.groupBy("g").count().agg(F.max("count")).first()[0] or 0) > task_merges:
        return order_by_joins(merges)

    def run(table: pa.Table) -> pa.Table:
        rows = {s: (a, b) for s, a, b in zip(*(table.column(c).to_pylist() for c in ("step", "left", "right")), strict=True)}
        stack, out = [max(rows)], []
        while stack:
            at = stack.pop()
            if at < 0:
                out.append(-at)
            else:
                stack += rows[at][::-1]
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(out), table.schema.field("g").type), "pos": pa.array(range(1, len(out) + 1), pa.int32()), "leaf": pa.array(out, pa.int64())})

    return merges.select("g", "step", "left", "right").groupBy("g").applyInArrow(run, f"g {kind}, pos int, leaf bigint")


def order_by_joins(merges: DataFrame) -> DataFrame:
    """The same for trees of any size: a leaf stands behind the leaves of all left parts beside its way to the root, which
    are added up by doubling, about log(depth) rounds of joins."""
    sides = [merges.select("g", F.col(c).alias("node_id"), F.col("step").alias("parent_id"), F.when(F.lit(c) == "right", F.col("left")).alias("beside")) for c in ("left", "right")]
    tops = merges.groupBy("g").agg(F.max("step").alias("node_id")).select("g", "node_id", F.lit(None).cast("bigint").alias("parent_id"), F.lit(None).cast("bigint").alias("beside"))
    nodes = cut(sides[0].unionByName(sides[1]).unionByName(tops))
    # Each merge has two parts, so n nodes have (n + 1) / 2 leaves.
    leaves = subtree_sizes(nodes.select("g", "node_id", "parent_id")).select("g", F.col("node_id").alias("beside"), ((F.col("size") + 1) / 2).cast("bigint").alias("more"))
    since = mark()
    now = cut(nodes.join(leaves, ["g", "beside"], "left").select("g", "node_id", F.col("parent_id").alias("far"), F.coalesce("more", F.lit(0)).alias("before")))
    while not now.where("far is not null").isEmpty():
        hop = now.select("g", F.col("node_id").alias("far"), F.col("far").alias("further"), F.col("before").alias("more"))
        now = recut(since, now.join(hop, ["g", "far"], "left").select("g", "node_id", F.col("further").alias("far"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before")))
    return now.where("node_id < 0").select("g", (F.col("before") + 1).cast("int").alias("pos"), (-F.col("node_id")).alias("leaf"))


def leaf_labels(order: DataFrame, labels: DataFrame) -> DataFrame:
    """order(g, pos, leaf), labels(g, leaf, label) -> g, pos, label: the colours under a dendrogram."""
    return order.join(labels, ["g", "leaf"], "left").select("g", "pos", "label")


def numbered(samples_rep: DataFrame) -> DataFrame:
    """g, sample_id, key -> g, sample_id, label: keys numbered from 1 by their smallest sample."""
    first = samples_rep.groupBy("g", "key").agg(F.min("sample_id").alias("first"))
    label = running_sums(first, ["g"], ["first"], "label").withColumn("label", F.col("label").cast("int")).drop("first")
    return samples_rep.join(label, ["g", "key"]).select("g", "sample_id", "label")


@tidy
def few_labels(samples: DataFrame, fit: Fit, k: int = 2, show: int = 100) -> DataFrame:
    """At most 50 labels: the merges above the start level, without the last k - 1 of them.

    A start level that already has fewer than k clusters is stepped back to the last one with k or more.
    """
    whole = force_merge(fit, 2.0)
    begin = start_level(whole.levels, show)
    counts = whole.levels.join(begin.withColumnRenamed("level", "s"), "g")
    enough = cut(counts.groupBy("g").agg(F.coalesce(F.max(F.when((F.col("level") <= F.col("s")) & (F.col("n_out") >= k), F.col("level"))), F.lit(0)).alias("level")))
    return cut_merges(samples, whole, enough, k)


def cut_merges(samples: DataFrame, whole: Fit, after: DataFrame, k: int) -> DataFrame:
    """g, sample_id, label: the clusters that the merges above ``after`` (g, level) leave without the last k - 1."""
    merges = cut(merge_table(whole.pointers, whole.levels, after))
    last = merges.groupBy("g").agg((F.max("step") - k + 1).alias("until"))
    kept = merges.join(last, "g").where(F.col("step") <= F.col("until"))
    parts = kept.select("g", F.col("left").alias("c"), F.col("step").alias("p")).unionByName(kept.select("g", F.col("right").alias("c"), F.col("step").alias("p")))
    tops = kept.select("g", F.col("step").alias("c")).join(parts.select("g", "c"), ["g", "c"], "left_anti").withColumn("p", F.col("c"))
    top = settle(parts.unionByName(tops), ["g"], "c", "p")
    used = whole.pointers.join(after.withColumnRenamed("level", "after"), "g").where("level > after")
    leaves = running_sums(used.select("g", "node_id").distinct(), ["g"], ["node_id"], "n").select("g", "node_id", (-F.col("n")).alias("c"))
    group = leaves.join(top, ["g", "c"], "left").select("g", F.col("node_id").alias("rep_id"), F.coalesce("p", "c").alias("key"))
    return numbered(at_levels(samples, whole.pointers, after).join(group, ["g", "rep_id"], "left").select("g", "sample_id", F.coalesce("key", -F.col("rep_id") - (1 << 40)).alias("key")))


def at_levels(samples: DataFrame, pointers: DataFrame, levels: DataFrame) -> DataFrame:
    """Each sample's cluster after its group's own level."""
    up_to = pointers.join(levels.withColumnRenamed("level", "until"), "g").where("level <= until").drop("until")
    return compose(samples, up_to)


@tidy
def many_labels(samples: DataFrame, fit: Fit, k: int) -> DataFrame:
    """More than 50 labels: the clusters of the coarsest level that still has more than k (every sample its own,
    if none has)."""
    coarse = fit.levels.groupBy("g").agg(F.coalesce(F.max(F.when(F.col("n_out") > k, F.col("level"))), F.lit(0)).alias("level"))
    return numbered(at_levels(samples, fit.pointers, coarse).withColumnRenamed("rep_id", "key"))


def labels(samples: DataFrame, fit: Fit, k: int = 2, show: int = 100) -> DataFrame:
    """g, sample_id, label (from 1, by first appearance)."""
    return few_labels(samples, fit, k, show) if k <= 50 else many_labels(samples, fit, k)


def mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, mode: the most frequent value; of several, the one seen first by ``order``."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias("mode"))


def log_heights(merges: DataFrame, base: float) -> DataFrame:
    return merges.withColumn("height", F.log(base, F.col("height")))


@tidy
def summary(samples: DataFrame, truth: DataFrame, fit: Fit, show: int = 100, log_base: float | None = None, k: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The clusters of the start level: (g, rep_id, pos in leaf order, n, x: mean of the samples' own rows, mode
    of the given labels), their merges, and each sample's label (g, sample_id, label) when these are cut into k.
    truth: g, sample_id, label."""
    whole = force_merge(fit, 1.5)
    begin = cut(start_level(whole.levels, show))
    members = at_levels(samples, whole.pointers, begin)
    flat = members.join(samples, ["g", "sample_id"]).select("g", "rep_id", F.posexplode("x").alias("i", "v")).groupBy("g", "rep_id", "i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    means = flat.groupBy("g", "rep_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("x")).select("g", "rep_id", "n", F.col("x.m").alias("x"))
    merges = cut(merge_table(whole.pointers, whole.levels, begin))
    names = whole.pointers.join(begin.withColumnRenamed("level", "after"), "g").where("level > after").select("g", F.col("node_id").alias("rep_id")).distinct()
    names = names.withColumn("leaf", F.row_number().over(Window.partitionBy("g").orderBy("rep_id")).cast("bigint"))
    order = leaf_order(merges).join(names, ["g", "leaf"]).select("g", "rep_id", "pos")
    modes = mode(members.join(truth, ["g", "sample_id"]), ["g", "rep_id"], "label", "sample_id")
    table = means.join(order, ["g", "rep_id"], "left").join(modes, ["g", "rep_id"], "left")
    return table, merges if log_base is None else log_heights(merges, log_base), cut_merges(samples, whole, begin, k)


