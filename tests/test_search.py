import numpy as np
from pyspark.sql import functions as F

from treefuse.plans import path
from treefuse.shared import cut
from treefuse.sources.matrix import samples


def test_a_search_that_never_ends_in_one_cluster(spark):
    """Clumps whose tree has edges without weight: every penalty up to the ceiling is tried, in few jobs."""
    x = np.repeat(np.random.default_rng(8).normal(size=(6, 2)) * 3, 8, 0) + np.arange(48)[:, None] * 1e-4
    points = cut(samples(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>"), "id", F.col("x")))
    edges = points.select("g", F.col("sample_id").alias("u"), (F.col("sample_id") + 1).alias("v"), F.when((F.col("sample_id") + 1) % 8 == 0, 1e9).otherwise(1e-3).cast("double").alias("dist")).where("u < 47")
    search = lambda ceiling, **more: path.search_lambda(points, step=1 / 128, ceiling=ceiling, edges=edges, bandwidth=1.0, norm=False, depth_thresh=0, **more)
    want = search(0.25, task_cells=0)
    assert search(0.25) == want == search(0.25, width=2) and len(want[1]) == 31 and want[1][-1][1] == 6
    spark.sparkContext.setJobGroup("far", "")
    _, tried = search(6.0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("far"))
    spark.sparkContext.setJobGroup("", "")
    assert len(tried) == 767 and jobs < 200


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-12, 12, 300), np.round(rng.normal(size=300), 9) + 5e-10 * rng.integers(-1, 2, 300), [0.0, -1e-12, 1e20, 0.5e-9, -2.5e-9, 12345678.1234567895]])
    want = [r[0] for r in spark.createDataFrame([(float(a),) for a in v], "a double").select(F.round("a", 9) + 0.0).collect()]
    assert path.to_nine(v).tolist() == want
