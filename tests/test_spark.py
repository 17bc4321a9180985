import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from treefuse.functions import evaluate, matrices, weights
from treefuse.functions.quantiles import exact_quantiles
from treefuse.operators import fusion, hierarchy, rooted_tree
from treefuse.operators.spanning_tree import near_pairs, prim, spanning_tree, spanning_tree_of_features
from treefuse.plans import bicluster, path, sparse
from treefuse.shared import cut, running_sums
from treefuse.sources.matrix import read_fit, samples, write_fit


def matrix(spark, x, g=None):
    rows = [(0 if g is None else int(g[i]), i, [float(v) for v in r]) for i, r in enumerate(x)]
    return samples(spark.createDataFrame(rows, "k int, id long, x array<double>"), "id", F.col("x"), F.col("k"))


def pairs(edges):
    return {(r["u"], r["v"]) for r in edges.collect()}


@pytest.mark.parametrize("shape", ["grid", "same", "line", "cloud"])
def test_spanning_tree_is_unique_whatever_the_blocks(spark, shape):
    rng = np.random.default_rng(0)
    x = {"grid": rng.integers(0, 4, (40, 2)), "same": np.ones((9, 3)), "line": rng.normal(size=(30, 1)), "cloud": rng.normal(size=(50, 5))}[shape].astype(float)
    u, v, _ = prim(np.arange(len(x)), x)
    want = set(zip(u.tolist(), v.tolist(), strict=True))
    points = cut(matrix(spark, x))
    assert pairs(spanning_tree(points, block_rows=7)) == want
    assert pairs(spanning_tree(points, block_rows=1000, prune=False)) == want


def test_far_groups_of_blocks_are_joined(spark):
    """Clouds far apart, an outlier, and a chain between two of them: what no near pair of blocks joins."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.1 + c for c in ((0, 0), (9, 1), (4, 30))] + [np.array([[60.0, -40.0]]), np.stack([np.linspace(0.5, 8.5, 9), np.zeros(9)], 1)])
    u, v, _ = prim(np.arange(len(x)), x)
    assert pairs(spanning_tree(cut(matrix(spark, x)), block_rows=10)) == set(zip(u.tolist(), v.tolist(), strict=True))


def test_near_pairs_grow_with_blocks(spark):
    """Boxes of a grid over a square: each has the same few neighbours, however many there are."""
    found = {}
    for side in (8, 24):
        at = [(i * side + j, i / side, j / side) for i in range(side) for j in range(side)]
        rows = [(0, b, [(0, x, x + 1 / side), (1, y, y + 1 / side)]) for b, x, y in at]
        boxes = spark.createDataFrame(rows, "g int, block long, box array<struct<dim: long, low: double, high: double>>")
        reach = spark.createDataFrame([(0, 0.5 / side)], "g int, far double")
        got = {(r["block"], r["block2"]) for r in near_pairs(boxes, reach).collect()}
        assert got == {(a, b) for a, x, y in at for b, z, w in at if a < b and max(abs(x - z), abs(y - w)) < 1.5 / side}
        found[side] = len(got) / len(at)
    assert found[24] < 1.2 * found[8]


def test_levels_without_fusion_cost_no_jobs(spark):
    """Two far points among many penalties below their fusion: one look passes over all of them."""
    nodes = path.start_nodes(matrix(spark, np.array([[0.0], [1.0], [50.0]])), norm=False, bandwidth=1e9)
    jobs = lambda lambdas: (spark.sparkContext.setJobGroup(f"n{len(lambdas)}", ""), path.follow(nodes, lambdas, task_cells=0), len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"n{len(lambdas)}")))[1:]
    few, n_few = jobs([0.1, 0.2])
    many, n_many = jobs([0.1 + 0.2 * i / 300 for i in range(300)])
    spark.sparkContext.setJobGroup("", "")
    assert n_many == n_few and many.levels.count() == 300 and many.levels.where("n_in != 3 or n_out != 3").count() == 0
    assert many.levels.select("level").distinct().count() == 300


def test_quantiles_by_selection(spark):
    rng = np.random.default_rng(12)
    groups = {0: rng.normal(size=501).tolist(), 1: [3.0] * 400 + [5.0], 2: [7.0], 3: rng.integers(0, 4, 100).astype(float).tolist()}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(0, None), (9, None)], "g int, v double")
    probabilities = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, "v", probabilities).collect()}
    assert got.keys() == {(g, p) for g in groups for p in probabilities}
    assert all(np.isclose(q, np.quantile(groups[g], p), atol=1e-12) for (g, p), q in got.items())


def test_running_sums_and_leaf_order_by_joins(spark):
    df = spark.createDataFrame([(i % 2, i, i % 5) for i in range(50)], "g int, o long, v long")
    got = {(r["g"], r["o"]): r["s"] for r in running_sums(df, ["g"], ["o"], "s", F.col("v")).collect()}
    assert got == {(i % 2, i): sum(j % 5 for j in range(i % 2, i + 1, 2)) for i in range(50)}
    merges = spark.createDataFrame([(0, 1, -3, -1), (0, 2, -5, 1), (0, 3, -2, -4), (0, 4, 3, 2), (1, 1, -2, -1)], "g int, step long, left long, right long")
    a, b = ({tuple(r) for r in hierarchy.leaf_order(merges, n).collect()} for n in (0, 100))
    assert a == b and len(a) == 7


def test_spanning_tree_of_columns_by_tiles(spark):
    x = np.round(np.random.default_rng(13).normal(size=(40, 11)), 1)
    x[:, 4] = x[:, 9]
    u, v, _ = prim(np.arange(11), x.T.copy())
    assert pairs(spanning_tree_of_features(matrix(spark, x), tile=4)) == set(zip(u.tolist(), v.tolist(), strict=True))


def test_spanning_tree_by_joins(spark):
    x = np.random.default_rng(1).integers(0, 5, (30, 2)).astype(float)
    u, v, _ = prim(np.arange(30), x)
    assert pairs(spanning_tree(matrix(spark, x), block_rows=8, task_edges=0)) == set(zip(u.tolist(), v.tolist(), strict=True))


def test_groups_have_their_own_trees(spark):
    x = np.random.default_rng(2).normal(size=(30, 2))
    found = spanning_tree(matrix(spark, x, np.arange(30) % 3), block_rows=4)
    assert found.count() == 27 and found.where("u % 3 != v % 3").count() == 0


def test_rooting_by_tour_equals_rooting_in_tasks(spark):
    edges = [(0, i, i + 1) for i in range(1, 9)] + [(0, 3, 20), (0, 3, 21), (0, 20, 22)] + [(1, 5, 4), (1, 5, 6), (1, 5, 7)]
    table = spark.createDataFrame([(g, min(a, b), max(a, b), float(a + b), 0.5) for g, a, b in edges], "g int, u long, v long, dist double, weight double")
    columns = ["g", "node_id", "parent_id", "dist", "edge_weight", "subtree_size"]
    a, b = ({tuple(r) for r in rooted_tree.rooted(table, n).select(columns).collect()} for n in (0, 1000))
    assert a == b and len(a) == 16
    deep = {(r["g"], r["node_id"]): r["depth"] for r in rooted_tree.with_depth(rooted_tree.rooted(table)).collect()}
    assert deep[0, 9] == 8 and deep[0, 22] == 4 and deep[1, 4] == 0


def test_sweeps_by_depth_equal_task_sweeps(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, None if i == 0 else (i - 1) // 3, float(rng.random()), float(rng.integers(1, 3)), [float(v) for v in np.round(rng.normal(size=2), 1)]) for i in range(13)]
    nodes = cut(spark.createDataFrame(rows, "g int, node_id long, parent_id long, edge_weight double, node_weight double, x array<double>"))
    a, b = ({r["node_id"]: r for r in fusion.solve(nodes, 0.4, task_cells=n).collect()} for n in (0, 1000))
    for i in a:
        assert np.allclose(a[i]["theta"], b[i]["theta"], atol=1e-9) and a[i]["fused"] == b[i]["fused"]
    assert fusion.certificate(fusion.solve(nodes, 0.4), nodes, 0.4).agg(F.sum("violations")).first()[0] == 0


def test_both_ways_along_the_path_agree(spark):
    x = np.round(np.random.default_rng(4).normal(size=(24, 2)), 1)
    nodes = path.start_nodes(matrix(spark, x))
    lambdas = [0.2, 1.0, 20.0]
    a, b = path.follow(nodes, lambdas), path.follow(nodes, lambdas, task_cells=0)
    rows = lambda t, c: {tuple(r) for r in t.select(c).collect()}
    assert rows(a.pointers, ["level", "node_id", "rep_id"]) == rows(b.pointers, ["level", "node_id", "rep_id"])
    assert rows(a.levels, ["level", "n_in", "n_out"]) == rows(b.levels, ["level", "n_in", "n_out"])
    x_of = lambda f: {(r["level"], r["rep_id"]): r["x"] for r in f.coordinates.collect()}
    assert all(np.allclose(v, x_of(b)[k]) for k, v in x_of(a).items())
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    write_fit(a, folder)
    assert rows(read_fit(spark, folder).pointers, ["level", "node_id", "rep_id"]) == rows(a.pointers, ["level", "node_id", "rep_id"])


def test_three_clouds_are_told_apart(spark):
    rng = np.random.default_rng(5)
    centres = np.array([(1, 2.5), (2.5, -1.8), (-2.5, -2)])
    truth = np.arange(400) % 3
    points = cut(matrix(spark, centres[truth] + rng.normal(size=(400, 2))))
    fit = path.fit_path(points, np.geomspace(0.1, 1e5, 100).tolist(), bandwidth=10.0)
    known = spark.createDataFrame([(0, i, int(t)) for i, t in enumerate(truth)], "g int, sample_id long, label int")
    found = cut(hierarchy.labels(points, fit, 3))
    assert found.select("label").distinct().count() == 3
    assert evaluate.accuracy(found, known).first()["accuracy"] >= 0.95
    table, merges, again = hierarchy.summary(points, known, fit, k=3)
    assert evaluate.accuracy(again, known).first()["accuracy"] >= 0.95
    assert table.agg(F.sum("n")).first()[0] == 400 and merges.count() == table.count() - 1


@pytest.mark.parametrize("x", [[[1.0]], [[1.0], [2.0]], [[3.0], [3.0], [3.0]], [[0.0, 1.0]] * 4])
def test_tiny_and_constant_inputs(spark, x):
    fit = path.fit_path(matrix(spark, np.array(x)), [0.0, 1e9])
    assert fit.levels.agg(F.min("n_out")).first()[0] == 1


def test_bad_inputs_are_refused(spark):
    table = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (None, 1.0)], "id long, a double")
    with pytest.raises(Exception, match="not finite"):
        samples(table, "id", ["a"]).collect()
    assert samples(table, "id", ["a"], on_invalid="drop").count() == 1
    with pytest.raises(ValueError, match="ascend"):
        path.checked([2.0, 1.0])
    with pytest.raises(ValueError, match="as many"):
        path.checked([1.0, 2.0], [1.0])
    with pytest.raises(ValueError, match="negative"):
        path.checked([-1.0])


def test_paths_that_stop_early_are_merged(spark):
    x = np.array([[0.0], [0.1], [50.0], [50.1]])
    points = matrix(spark, x)
    fit = path.fit_path(points, [0.5])
    whole = hierarchy.force_merge(fit, 1.5)
    last = whole.levels.orderBy(F.desc("level")).first()
    assert last["n_out"] == 1
    labels = {r["sample_id"]: r["label"] for r in hierarchy.labels(points, fit, 2).collect()}
    assert labels == {0: 1, 1: 1, 2: 2, 3: 2}
    assert hierarchy.many_labels(points, fit, 51).select("label").distinct().count() == 4


def test_sparse_fit_drops_noise(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((np.repeat([[3.0, -3.0], [-3.0, 3.0]], 10, 0) + rng.normal(size=(20, 2)) * 0.1, rng.normal(size=(20, 3)) * 0.05), 1)
    fit = sparse.fit_sparse(matrix(spark, x), [0.1, 5.0], [0.5, 0.6], most=20)
    first = sorted(r["feature_idx"] for r in fit.features.where("level = 1").collect())
    assert first == [0, 1]
    wide = sparse.expand_features(path.expand(matrix(spark, x), fit, [1]), fit.features, 5).first()["theta"]
    assert wide[0] is not None and wide[2:] == [None] * 3
    gone = sparse.fit_sparse(matrix(spark, x), [0.1], [1e6], most=10)
    assert gone.features.count() == 0 and gone.levels.first()["n_out"] == 1


def test_two_sided_fit(spark):
    rng = np.random.default_rng(7)
    x = np.kron(np.array([[4.0, -4.0], [-4.0, 4.0]]), np.ones((4, 3))) + rng.normal(size=(8, 6)) * 0.1
    points = cut(matrix(spark, x))
    fit = bicluster.fit_bi(points, [0.5], [0.5], most=10)
    blocks = bicluster.expand_blocks(points, fit, 1)
    assert blocks.count() == 48
    got = {(r["sample_id"], r["feature_idx"]): r["theta"] for r in blocks.collect()}
    assert np.isclose(np.mean(list(got.values())), x.mean())
    nodes, columns = bicluster.bi_trees(points)
    a, b = ({r["node_id"]: r["u"] for r in bicluster.settled(nodes, columns, 0.5, 0.5, 2, 0.0, c).collect()} for c in (0, 10**6))
    assert all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def test_one_penalty_equals_a_path_of_one(spark):
    x = np.round(np.random.default_rng(8).normal(size=(20, 2)), 1)
    points = cut(matrix(spark, x))
    labels = path.fit_one(points, 0.5)
    fit = path.fit_path(points, [0.5])
    assert labels.select("label").distinct().count() <= fit.levels.first()["n_out"]
    best, tried = path.search_lambda(points, step=8.0, least_step=1.0, ceiling=1000.0)
    assert tried and best > 0


def test_penalties_side_by_side_equal_each_alone(spark):
    x = np.round(np.random.default_rng(9).normal(size=(40, 3)), 1)
    nodes = path.start_nodes(matrix(spark, x, np.arange(40) % 2))
    values = [0.0, 0.3, 2.0]
    both = {(r["g"]["g"], r["g"]["lambda"], r["node_id"]): r for r in fusion.solve_each(nodes, [2.0, 0.3, *values]).collect()}
    pieces = {(r["g"]["g"], r["g"]["lambda"], r["node_id"]): r for r in fusion.solve_each(nodes, values, task_cells=6).collect()}
    assert len(both) == len(pieces) == 40 * len(values)
    for lam in values:
        for r in fusion.solve(nodes, lam).collect():
            for got in (both, pieces):
                found = got[r["g"], lam, r["node_id"]]
                assert np.allclose(found["theta"], r["theta"], atol=1e-9) and found["fused"] == r["fused"] and found["parent_id"] == r["parent_id"]
    labels = path.fit_each(matrix(spark, x), [0.5, 1.0])
    for lam in (0.5, 1.0):
        alone = {tuple(r) for r in path.fit_one(matrix(spark, x), lam).collect()}
        assert {(r["g"], r["sample_id"], r["label"]) for r in labels.where(F.col("lambda") == lam).collect()} == alone
    with pytest.raises(ValueError):
        fusion.solve_each(nodes, [])
    with pytest.raises(ValueError):
        fusion.solve_each(nodes, [-1.0, 2.0])


def chain_search(spark, x, monkeypatch, **options):
    """The search on a chain with weights of 1, and in how many rounds it has solved."""
    points, rounds, solved = cut(matrix(spark, np.array(x)[:, None])), [], path.cluster_counts
    edges = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(len(x) - 1)], "g int, u long, v long, dist double")
    with monkeypatch.context() as m:
        m.setattr(path, "cluster_counts", lambda nodes, lambdas: rounds.append(len(lambdas)) or solved(nodes, lambdas))
        return *path.search_lambda(points, edges=edges, bandwidth=1e15, norm=False, **options), rounds


def test_a_search_tries_the_same_whatever_is_solved_at_once(spark, monkeypatch):
    x = [0.0, 3.0, 9.5, 11.0]
    one, eight = (chain_search(spark, x, monkeypatch, step=1.0, least_step=0.3, ceiling=100.0, width=w) for w in (1, 8))
    assert one[:2] == eight[:2] and one[1][-1][1] == 1
    assert len(one[2]) == len(one[1]) and len(eight[2]) < len(one[2]) and max(eight[2]) <= 8
    # Below the penalty that leaves one cluster there are several, from it on one.
    assert all((n == 1) == (lam >= one[0]) for lam, n in one[1])


def test_a_search_ends_where_its_first_hit_is_the_smallest(spark, monkeypatch):
    """Two values 4 apart meet at a penalty of exactly 2: halving towards it from below never gets there."""
    best, tried, rounds = chain_search(spark, [0.0, 4.0], monkeypatch, step=2.0, least_step=0.5, ceiling=100.0)
    assert best == 2.0 and tried[0] == (2.0, 1) and all(n == 2 for _, n in tried[1:])
    assert len(tried) < 30 and len(rounds) < len(tried) / 2
    with pytest.raises(ValueError):
        path.search_lambda(matrix(spark, np.ones((2, 1))), least_step=0.0)


def test_a_search_may_stop_at_few_clusters_and_has_a_ceiling(spark, monkeypatch):
    x = [0.0, 3.0, 9.5, 11.0]
    best, tried, _ = chain_search(spark, x, monkeypatch, step=1.0, least_step=0.3, ceiling=100.0, stop_below=4)
    assert tried[-1][1] < 4 and all(n >= 4 for _, n in tried[:-1]) and best == tried[-1][0] + 1.0
    best, tried, rounds = chain_search(spark, x, monkeypatch, step=1.0, least_step=0.3, ceiling=1.0)
    assert (best, tried, rounds) == (2.0, [], [])


def test_reshaping(spark):
    points = matrix(spark, np.arange(12.0).reshape(4, 3))
    rows = {r["feature_idx"]: r["values"] for r in matrices.transpose(points).collect()}
    assert rows == {0: [0, 3, 6, 9], 1: [1, 4, 7, 10], 2: [2, 5, 8, 11]}
    assert matrices.sample_rows(points, "sample_id", 2, 1).count() == 2
    assert [r["value"] for r in matrices.breaks(points, 3).orderBy("i").collect()] == [0, 5.5, 11]
    flat = spark.createDataFrame([(0, 1, 2, 0.0), (0, 2, 3, 0.0)], "g int, u long, v long, dist double")
    assert {r["dist"] for r in weights.normalise(flat).collect()} == {0.0}
    assert {r["weight"] for r in weights.gaussian(flat, weights.bandwidth(flat)).collect()} == {1.0}
