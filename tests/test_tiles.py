import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from treefuse.operators.spanning_tree import spanning_tree
from treefuse.operators.tiles import prim, tree_of_points, tree_of_two
from treefuse.shared import cut
from treefuse.sources.matrix import samples


def matrix(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return cut(samples(spark.createDataFrame(rows, "id long, x array<double>"), "id", F.col("x")))


def edges_of(tree):
    return set(zip(tree[0].tolist(), tree[1].tolist(), strict=True))


def shuffled(spark):
    """Bytes of shuffle files that are there."""
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(os.path.getsize(f"{at}/{f}") for top in dirs for at, _, files in os.walk(top) for f in files if f.startswith("shuffle_"))


@pytest.mark.parametrize("seed", range(12))
def test_trees_of_leaves_are_those_of_prim(seed):
    rng = np.random.default_rng(seed)
    n, p = int(rng.integers(2, 200)), int(rng.integers(1, 10))
    shapes = [rng.normal(size=(n, p)), rng.integers(0, 4, (n, p)).astype(float), rng.normal(size=(n, p)) * 0.01 + rng.integers(0, 3, (n, 1)) * 9, np.round(rng.normal(size=(n, p)), 1) + 1e6]
    x = shapes[seed % 4]
    want, columns = edges_of(prim(np.arange(n), x)), np.ascontiguousarray(x.T)
    left = np.arange(n) % 2 == 0
    sides = [prim(np.flatnonzero(m), x[m]) for m in (left, ~left)]
    for most in (5, 16, 500):
        for skip in (True, False):
            assert edges_of(tree_of_points(columns, skip, most)) == want
            assert edges_of(tree_of_two(columns, left, *sides, skip, most)) == want


def test_copies_of_points_cost_no_pairs(spark):
    """6000 samples at 20 places, in blocks of 5: not 719,400 pairs of blocks."""
    x = np.repeat(np.random.default_rng(3).normal(size=(20, 2)), 300, 0)[np.random.default_rng(4).permutation(6000)]
    found = {(r["u"], r["v"]) for r in spanning_tree(matrix(spark, x), block_rows=5, prune=False).collect()}
    first = {tuple(p): i for i, p in reversed(list(enumerate(x.tolist())))}
    ids = np.array(sorted(first.values()))
    u, v, _ = prim(ids, x[ids])
    stars = {(first[tuple(p)], i) for i, p in enumerate(x.tolist()) if first[tuple(p)] != i}
    assert found == stars | set(zip(u.tolist(), v.tolist(), strict=True))


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Many features, so all pairs of blocks are near: what is shuffled grows with the samples, not with the pairs."""
    x = np.random.default_rng(5).normal(size=(1200, 40))
    points, before = matrix(spark, x), shuffled(spark)
    found = {(r["u"], r["v"]) for r in spanning_tree(points, block_rows=40, sent=100_000).collect()}
    assert found == edges_of(prim(np.arange(1200), x))
    assert shuffled(spark) - before < 8 * x.nbytes
