import numpy as np
import pytest
from pyspark.sql import functions as F

from treefuse.operators import fusion
from treefuse.operators.kernels import pairwise
from treefuse.plans import bicluster
from treefuse.shared import cut
from treefuse.sources.matrix import samples


class Called(Exception):
    pass


def matrix(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return cut(samples(spark.createDataFrame(rows, "id long, x array<double>"), "id", F.col("x")))


def test_features_are_dealt_over_the_cores(spark, monkeypatch):
    """Eight features on four cores: four tasks solve the samples' tree, not one."""
    nodes, columns = bicluster.bi_trees(matrix(spark, np.random.default_rng(2).normal(size=(12, 8))))

    def solve_blocks(cells, *_):
        raise Called(cells.select("fb").distinct().count())

    monkeypatch.setattr(fusion, "solve_blocks", solve_blocks)
    with pytest.raises(Called) as found:
        bicluster.settled(nodes, columns, 0.3, 0.2, 2, 0.0, task_cells=0)
    assert found.value.args[0] == spark.sparkContext.defaultParallelism


def test_pairs_of_a_block_of_columns(spark):
    x = np.random.default_rng(3).integers(0, 5, (40, 7)).astype(float)
    rows = matrix(spark, x).withColumnRenamed("sample_id", "place")
    now = bicluster.tiles(rows.withColumn("u", F.col("x")), "u", 3)
    assert np.isclose(bicluster.block_pairs(now).first()["total"], pairwise(x.T))
