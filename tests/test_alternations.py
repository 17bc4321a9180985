"""Sparse and two-sided fits: many groups at once, and the side without tasks that hold a group."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from treefuse.operators.kernels import bi_loss, sparse_loss
from treefuse.plans import bicluster, sparse
from treefuse.plans.path import start_nodes
from treefuse.shared import cut


def table(spark, groups):
    rows = [(g, i, [float(v) for v in row]) for g, x in groups.items() for i, row in enumerate(x)]
    return cut(spark.createDataFrame(rows, "g string, sample_id long, x array<double>"))


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(3)
    blocks = np.kron(np.array([[4.0, -4.0], [-4.0, 4.0]]), np.ones((5, 3))) + rng.normal(size=(10, 6)) * 0.1
    noise = np.concatenate((np.repeat([[3.0], [-3.0]], 6, 0), rng.normal(size=(12, 4)) * 0.05), 1)
    return {"blocks": blocks, "noise": noise, "one": np.array([[1.0, 2.0]])}


def numbers(df, key, value):
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


@pytest.mark.parametrize(("steps", "cells"), [(3, {"task_cells": 55}), (1, {"task_cells": 0, "solve_cells": 4})])
def test_a_sparse_fit_is_the_same_in_tasks_in_spark_and_in_pieces(spark, groups, steps, cells):
    nodes = start_nodes(table(spark, groups))
    here = numbers(sparse.settled(nodes, 0.3, 0.4, steps, 0.0), ("g", "node_id"), "u")
    close(here, numbers(sparse.settled(nodes, 0.3, 0.4, steps, 0.0, **cells), ("g", "node_id"), "u"))


@pytest.mark.parametrize(("steps", "cells"), [(3, {"task_cells": 55}), (1, {"task_cells": 0, "solve_cells": 12})])
def test_a_two_sided_fit_is_the_same_in_tasks_and_in_tiles(spark, groups, steps, cells, monkeypatch):
    monkeypatch.setattr(bicluster, "WIDTH", 4)  # several tiles each way, the last ones narrower
    nodes, columns = bicluster.bi_trees(table(spark, groups))
    here = numbers(bicluster.settled(nodes, columns, 0.3, 0.2, steps, 0.0), ("g", "node_id"), "u")
    close(here, numbers(bicluster.settled(nodes, columns, 0.3, 0.2, steps, 0.0, **cells), ("g", "node_id"), "u"))


@pytest.mark.parametrize("fit", [sparse.fit_sparse, bicluster.fit_bi])
def test_groups_fitted_together_are_as_fitted_alone(spark, groups, fit):
    both = fit(table(spark, groups), [0.05, 1.0], [0.3, 0.8], most=6)
    alone = fit(table(spark, {"noise": groups["noise"]}), [0.05, 1.0], [0.3, 0.8], most=6)
    for name, key, value in [("levels", ("level",), "n_out"), ("pointers", ("level", "node_id"), "rep_id"), ("coordinates", ("level", "rep_id"), "x")]:
        close(numbers(getattr(both, name).where("g = 'noise'"), key, value), numbers(getattr(alone, name), key, value))
    for name in ["features", "pointers_f"]:
        if getattr(alone, name) is not None:
            rows = [sorted(tuple(r) for r in getattr(f, name).where("g = 'noise'").collect()) for f in (both, alone)]
            assert rows[0] == rows[1]
    assert both.levels.where("g = 'one'").first()["n_out"] == 1 and both.levels.select("g").distinct().count() == 3


def test_objectives_equal_the_kernels(spark, groups, monkeypatch):
    monkeypatch.setattr(bicluster, "WIDTH", 4)
    samples = table(spark, groups)
    rows = samples.select("g", F.col("sample_id").alias("node_id"), "x", F.transform("x", lambda v: F.round(v / 2, 1)).alias("u"))
    wide = rows.withColumn("place", F.col("node_id"))
    tiled = bicluster.tiles(wide, "x").join(bicluster.tiles(wide, "u"), ["g", "node_id", "fb"])
    for g, x in groups.items():
        u = np.array([r["u"] for r in rows.where(F.col("g") == g).orderBy("node_id").collect()])
        one = lambda df, g=g: df.where(F.col("g") == g).first()["loss"]
        assert np.isclose(one(sparse.sparse_objective(rows, 2.0, 3.0)), sparse_loss(x, u, 2.0, 3.0))
        assert np.isclose(one(bicluster.bi_objective(rows, 2.0, 3.0)), bi_loss(x, u, 2.0, 3.0))
        assert np.isclose(one(bicluster.tile_objective(tiled, 2.0, 3.0)), bi_loss(x, u, 2.0, 3.0))


def test_tiles_are_turned_without_long_rows(spark, monkeypatch):
    monkeypatch.setattr(bicluster, "WIDTH", 4)
    x = np.arange(77.0).reshape(11, 7)
    rows = table(spark, {"a": x}).withColumnRenamed("sample_id", "place")
    across = bicluster.turned(bicluster.tiles(rows, "x"), "x")
    assert across.agg(F.max(F.size("x"))).first()[0] == 4
    whole = across.groupBy("node_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("fb", "x"))).getField("x")).alias("x")).orderBy("node_id")
    assert np.array_equal([r["x"] for r in whole.collect()], x.T)
    back = bicluster.turned(across, "x").orderBy("node_id", "fb").collect()
    assert sum((r["x"] for r in back), []) == list(range(77))
