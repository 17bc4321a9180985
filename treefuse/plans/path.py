"""Fits along a sequence of penalties.

While a group's nodes times features exceed ``task_cells``, a level is a handful of Spark jobs: solve, fuse,
contract. A group at or below it, from the start or after some levels, does its remaining levels in one
task; with many groups there are many such tasks. Both ways give the same tables.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.functions.weights import bandwidth as median_bandwidth
from treefuse.functions.weights import gaussian, normalise, outlier_floor
from treefuse.operators import fusion
from treefuse.operators.rooted_tree import rooted, with_shape
from treefuse.operators.spanning_tree import spanning_tree
from treefuse.shared import Pile, cut, forget, mark, running_sums, settle, tidy
from treefuse.sources.matrix import Fit
from treefuse.sources.matrix import samples as matrix

TASK_CELLS = 2_000_000
ROUND = 1024  # penalties that a round of the search has at most


@tidy
def start_nodes(samples: DataFrame, bandwidth: float | None = None, norm: bool = True, depth_thresh: int = 10, prob_thresh: float = 0.1, prune: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """samples(g, sample_id, x) -> g, node_id, parent_id, edge_weight, node_weight, x: the weighted tree that a
    fit starts from. A given bandwidth applies to lengths after normalising. A single sample is a root."""
    edges = cut(spanning_tree(samples, prune=prune)) if edges is None else edges
    if norm:
        edges = normalise(edges)
    weighted = gaussian(edges, median_bandwidth(edges) if bandwidth is None else bandwidth)
    tree = outlier_floor(with_shape(rooted(weighted)), depth_thresh, prob_thresh)
    joined = samples.withColumnRenamed("sample_id", "node_id").join(tree.select("g", "node_id", "parent_id", "edge_weight"), ["g", "node_id"], "left")
    return cut(joined.select("g", "node_id", "parent_id", F.coalesce("edge_weight", F.lit(0.0)).alias("edge_weight"), F.lit(1.0).alias("node_weight"), "x"))


def checked(lambdas: Sequence[float], gammas: Sequence[float] | None = None) -> list[float]:
    values = [float(v) for v in lambdas]
    if not values or values[0] < 0 or sorted(values) != values:
        raise ValueError("penalties must not be negative and must ascend")
    if gammas is not None and len(gammas) != len(values):
        raise ValueError("there must be as many gammas as lambdas")
    return values


@tidy
def fit_path(samples: DataFrame, lambdas: Sequence[float], bandwidth: float | None = None, norm: bool = True, depth_thresh: int = 10, prob_thresh: float = 0.1, prune: bool = True, task_cells: int = TASK_CELLS) -> Fit:
    """samples(g, sample_id, x) -> Fit, each group until it is one cluster or the penalties end."""
    values = checked(lambdas)
    return follow(start_nodes(samples, bandwidth, norm, depth_thresh, prob_thresh, prune), values, task_cells)


@tidy
def follow(nodes: DataFrame, values: list[float], task_cells: int = TASK_CELLS, solve_cells: int = fusion.TASK_CELLS) -> Fit:
    """Nodes as ``start_nodes`` gives them -> Fit. ``solve_cells`` bounds what a level's solving puts into a task."""
    spark = nodes.sparkSession
    levels, pointers, coordinates = (Pile(spark) for _ in range(3))
    live, level, since = nodes, 0, mark()
    while level < len(values):
        sizes = live.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"))
        small = cut(sizes.where(F.col("n") * F.col("p") <= task_cells).select("g"))
        if not small.isEmpty():
            rest = cut(in_tasks(live.join(small, "g", "left_semi"), values, level))
            levels.add(rest.where("kind = 0").select("g", "level", F.col("value").alias("lambda"), F.lit(None).cast("double").alias("gamma"), F.col("node_id").alias("n_in"), F.col("rep_id").alias("n_out")))
            pointers.add(rest.where("kind = 1").select("g", "level", "node_id", "rep_id"))
            coordinates.add(rest.where("kind = 2").select("g", "level", "rep_id", F.col("value").alias("weight"), "x"))
            live = live.join(small, "g", "left_anti")
        if live.isEmpty():
            break
        free = fusion.next_fusion(live).agg(F.min("free")).first()[0]
        rest = bisect_left(values, free, level)
        if rest > level:  # nothing fuses before
            passed = spark.createDataFrame([(i + 1, values[i]) for i in range(level, rest)], "level int, lambda double")
            still = live.groupBy("g").agg(F.count(F.lit(1)).alias("n_in")).join(F.broadcast(passed))
            levels.add(still.select("g", "level", "lambda", F.lit(None).cast("double").alias("gamma"), "n_in", F.col("n_in").alias("n_out")))
            level = rest
            continue
        solved = fusion.solve(live, values[level], task_cells=solve_cells)
        reps = cut(fusion.representatives(solved))
        fewer = cut(fusion.contract_nodes(live, reps))
        tree = fusion.contract_tree(live.select("g", "node_id", "parent_id", "edge_weight"), reps)
        counts = cut(reps.groupBy("g").agg(F.count(F.lit(1)).alias("n_in"), F.count(F.when(F.col("node_id") == F.col("rep_id"), 1)).alias("n_out")))
        levels.add(counts.select("g", F.lit(level + 1).alias("level"), F.lit(values[level]).alias("lambda"), F.lit(None).cast("double").alias("gamma"), "n_in", "n_out"))
        moved = counts.where("n_in > n_out").select("g")
        pointers.add(reps.join(moved, "g", "left_semi").select("g", F.lit(level + 1).alias("level"), "node_id", "rep_id"))
        coordinates.add(fewer.join(moved, "g", "left_semi").select("g", F.lit(level + 1).alias("level"), "rep_id", "weight", "x"))
        going = counts.where("n_out > 1").select("g")
        live = tree.join(fewer.withColumnRenamed("rep_id", "node_id"), ["g", "node_id"]).join(going, "g", "left_semi")
        live = forget(since, cut(live.select("g", "node_id", "parent_id", "edge_weight", F.col("weight").alias("node_weight"), "x")))
        level += 1
    empty = {"pointers": "g {}, level int, node_id bigint, rep_id bigint", "coordinates": "g {}, level int, rep_id bigint, weight double, x array<double>"}
    kind = nodes.schema["g"].dataType.simpleString()
    read = lambda pile, name: pile.read() if pile.schema else spark.createDataFrame([], empty[name].format(kind))
    return Fit(levels.read(), read(pointers, "pointers"), read(coordinates, "coordinates"))


def in_tasks(nodes: DataFrame, values: list[float], done: int) -> DataFrame:
    """Levels from ``done`` on, a group a task: rows of kind 0 (level counts), 1 (pointers), 2 (means)."""
    kind = nodes.schema["g"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        tree, ids = fusion.tree_of(table)
        x = fusion.matrix_of(table.column("x"), table.num_rows)
        out: list[list] = [[], [], [], [], [], []]

        def add(k: int, level: int, node, rep, value, rows) -> None:
            for column, part in zip(out, ([k] * len(node), [level] * len(node), node, rep, value, rows), strict=True):
                column.extend(part)

        i, free = done, tree.next_fusion(x)
        while i < len(values):
            before = len(ids)
            if values[i] < free:  # nothing fuses before the first penalty that reaches it
                rest = bisect_left(values, free, i)
                for j in range(i, rest):
                    add(0, j + 1, [before], [before], [values[j]], [None])
                i = rest
                continue
            joined = tree.solve(x, values[i])[1].all(1) & (tree.parent >= 0)
            if joined.any():
                tree, x, to, stay = tree.contract(x, joined)
                add(1, i + 1, ids.tolist(), ids[stay][to].tolist(), [None] * before, [None] * before)
                ids = ids[stay]
                add(2, i + 1, [None] * len(ids), ids.tolist(), tree.node.tolist(), x.tolist())
                free = tree.next_fusion(x)
            add(0, i + 1, [before], [len(ids)], [values[i]], [None])
            if len(ids) == 1:
                break
            i += 1
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        names = ("kind", "level", "node_id", "rep_id", "value", "x")
        g = pa.array([table.column("g")[0].as_py()] * len(out[0]), table.schema.field("g").type)
        return pa.table({"g": g} | {n: pa.array(c, t) for n, c, t in zip(names, out, types, strict=True)})

    return nodes.groupBy("g").applyInArrow(run, f"g {kind}, kind int, level int, node_id bigint, rep_id bigint, value double, x array<double>")


@tidy
def compose(samples: DataFrame, pointers: DataFrame, level: int | None = None) -> DataFrame:
    """g, sample_id, rep_id: the cluster of each sample after ``level`` (default: the last). A node stops
    standing for itself once at most, so its pointers are one forest, climbed by doubling."""
    gone = pointers.where("node_id != rep_id")
    if level is not None:
        gone = gone.where(F.col("level") <= level)
    all_ = samples.select("g", F.col("sample_id").alias("node_id")).join(gone.select("g", "node_id", "rep_id"), ["g", "node_id"], "left")
    return settle(all_.select("g", "node_id", F.coalesce("rep_id", "node_id").alias("rep_id")), ["g"], "node_id", "rep_id").select("g", F.col("node_id").alias("sample_id"), "rep_id")


def expand(samples: DataFrame, fit: Fit, levels: Sequence[int]) -> DataFrame:
    """g, level, sample_id, theta: the cluster means of the given levels for every sample (n rows a level)."""
    out = None
    for level in levels:
        reps = compose(samples, fit.pointers, level)
        # A level without fusions has no means of its own: the last ones before it hold.
        latest = fit.coordinates.where(F.col("level") <= level).groupBy("g", "rep_id").agg(F.max_by("x", "level").alias("theta"))
        own = samples.select("g", F.col("sample_id").alias("rep_id"), "x")
        rows = reps.join(latest, ["g", "rep_id"], "left").join(own, ["g", "rep_id"], "left").select("g", F.lit(level).alias("level"), "sample_id", F.coalesce("theta", "x").alias("theta"))
        out = rows if out is None else out.unionByName(rows)
    return out


def level_counts(fit: Fit) -> DataFrame:
    """g, level, lambda, n_in, n_out."""
    return fit.levels.select("g", "level", "lambda", "n_in", "n_out")


def distinct_labels(solution: DataFrame) -> DataFrame:
    """g, sample_id, label: equal solution rows (to 1e-9) have one label, numbered by first appearance."""
    rows = solution.select("g", F.col("node_id").alias("sample_id"), F.transform("theta", lambda v: F.round(v, 9) + 0.0).alias("t"))
    groups = rows.groupBy("g", "t").agg(F.min("sample_id").alias("first"))
    # A label is the rank of its first sample among the groups' first samples: one row a distinct solution.
    ranked = running_sums(groups, ["g"], ["first"], "label").withColumn("label", F.col("label").cast("int"))
    return rows.join(ranked, ["g", "t"]).select("g", "sample_id", "label")


@tidy
def fit_one(samples: DataFrame, lam: float, **options) -> DataFrame:
    """One penalty, no path: g, sample_id, label."""
    return distinct_labels(fusion.solve(start_nodes(samples, **options), lam))


@tidy
def fit_each(samples: DataFrame, lambdas: Sequence[float], **options) -> DataFrame:
    """Several penalties, each as in ``fit_one`` and all in the same jobs: g, lambda, sample_id, label."""
    labels = distinct_labels(fusion.solve_each(start_nodes(samples, **options), lambdas))
    return labels.select("g.g", "g.lambda", "sample_id", "label")


def to_nine(v: np.ndarray) -> np.ndarray:
    """Rounded to 9 places as Spark does: half away from zero in the shortest decimals."""
    scaled = np.abs(v) * 1e9
    near = np.rint(scaled)
    out = np.copysign(near / 1e9, v)
    for i in np.flatnonzero((scaled > 2.0**52) | (np.abs(np.abs(scaled - near) - 0.5) < 1e-6 + 1e-15 * scaled)):
        out.flat[i] = float(Decimal(repr(float(v.flat[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP, Context(prec=400)))
    return out + 0.0


def packed(nodes: DataFrame) -> DataFrame:
    """The nodes of one data set in one row, so that a task can solve its tree for some penalties."""
    fields = ("node_id", "parent_id", "edge_weight", "node_weight", "x")
    rows = nodes.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("t"))
    return cut(rows.select(*(F.col(f"t.{f}").alias(f) for f in fields[:4]), F.flatten("t.x").alias("flat")))


def counts_in_tasks(tree_row: DataFrame, lambdas: Sequence[float], at_once: int = 500_000) -> dict[float, int]:
    """As ``cluster_counts``: the tree goes to each task, and only counts come back."""
    spark = tree_row.sparkSession
    values = sorted({float(v) for v in lambdas})
    tasks = min(len(values), 4 * spark.sparkContext.defaultParallelism)
    deals = spark.createDataFrame([(k, values[k::tasks]) for k in range(tasks)], "k int, lambdas array<double>").repartitionByRange(tasks, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in pa.Table.from_batches([batch]).to_batches(max_chunksize=1):
                table = pa.table({c: row.column(c).flatten() for c in ("node_id", "parent_id", "edge_weight", "node_weight")})
                tree, ids = fusion.tree_of(table)
                x = row.column("flat").flatten().to_numpy().reshape(len(ids), -1)
                mine, p, found = row.column("lambdas").flatten().to_numpy(), x.shape[1], []
                several = max(1, at_once // max(x.size, 1))
                for i in range(0, len(mine), several):
                    part = mine[i : i + several]
                    theta = tree.solve(np.tile(x, (1, len(part))), np.repeat(part, p))[0]
                    for k in range(len(part)):
                        apart = np.unique(theta[:, k * p : (k + 1) * p], axis=0)
                        found.append(len(np.unique(to_nine(apart), axis=0)))
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(found, pa.int64())], names=["lambda", "n"])

    rows = deals.join(F.broadcast(tree_row)).mapInArrow(run, "lambda double, n bigint").collect()
    return {r["lambda"]: r["n"] for r in rows}


def cluster_counts(nodes: DataFrame, lambdas: Sequence[float]) -> dict[float, int]:
    """Clusters that each penalty leaves of one data set."""
    solved = fusion.solve_each(nodes, lambdas)
    rows = solved.select("g.lambda", F.transform("theta", lambda v: F.round(v, 9) + 0.0).alias("t")).distinct().groupBy("lambda").count()
    return {r["lambda"]: r["count"] for r in rows.collect()}


def _tried(lam: float, stride: float, collapsed: bool, n: int) -> tuple[float, float, bool]:
    """Where the search goes from a penalty that leaves n clusters."""
    collapsed = collapsed or n == 1
    stride = stride / 2 if collapsed else stride
    return (lam + stride if n > 1 else lam - stride), stride, collapsed


def _ahead(at: tuple[float, float, bool], ceiling: float, finest: float, width: int) -> list[float]:
    """The next ``width`` penalties that the search may ask for: upwards until one has left one cluster, then both ways."""
    found, queue = [], deque([at])
    while queue and len(found) < width:
        at = queue.popleft()
        if at[0] < ceiling and at[1] >= finest:
            found.append(at[0])
            queue.extend(_tried(*at, n) for n in ((2, 1) if at[2] else (2,)))
    return found


@tidy
def search_lambda(samples: DataFrame, step: float = 1000.0, least_step: float = 50.0, stop_below: float = float("-inf"), ceiling: float | None = None, width: int = 8, task_cells: int = TASK_CELLS, **options) -> tuple[float, list[tuple[float, int]]]:
    """The smallest penalty on a halving grid that leaves one cluster, plus the last step, and the (penalty,
    clusters) that were tried. One data set (one g). The default ceiling is half the sum of squares.

    ``width`` penalties that may be asked for next are solved in one round, as copies of the tree; what is tried does not
    depend on it. A tree of at most ``task_cells`` cells goes to tasks as a whole, each with some penalties, and on the way
    up a round has twice as many of them as the one before (with a width of 1 always one). The published search ends at a penalty that leaves one cluster, once its step is below ``least_step``;
    where the first such penalty is the smallest of all, it would go on for ever. Here a millionth of ``least_step``
    ends it, at the smallest penalty tried that leaves one cluster."""
    if step <= 0 or least_step <= 0:
        raise ValueError("steps must be positive")
    nodes = start_nodes(samples, **options)
    if ceiling is None:
        ceiling = samples.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)) / 2).first()[0] or 0.0
    known: dict[float, int] = {}
    tried: list[tuple[float, int]] = []
    at, finest, most = (step, step, False), least_step * 1e-6, width
    size = nodes.agg(F.sum(F.greatest(F.size("x"), F.lit(1)))).first()[0] or 0
    tree = packed(nodes) if 0 < size <= task_cells else None
    while at[0] < ceiling:
        if at[1] < finest:
            return min(lam for lam, n in tried if n == 1), tried
        lam = at[0]
        if lam not in known:
            ahead = _ahead(at, ceiling, finest, most if tree is not None else width)
            known |= cluster_counts(nodes, ahead) if tree is None else counts_in_tasks(tree, ahead)
            most = min(2 * most, ROUND) if 1 < width and not at[2] else width
        n = known[lam]
        tried.append((lam, n))
        if n < stop_below:
            break
        at = _tried(*at, n)
        if n == 1 and at[1] < least_step:
            break
    return at[0] + at[1], tried


def group_fits(df: DataFrame, id_col: str, features: list[str], group_col: str, lambdas: Sequence[float], **options) -> Fit:
    """One fit for each value of ``group_col``: all groups share the same jobs, keyed by g."""
    return fit_path(matrix(df, id_col, features, F.col(group_col)), lambdas, **options)

