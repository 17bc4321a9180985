import pyarrow.fs as pafs
import pytest

from tests.test_spark import matrix
from treefuse.plans import path
from treefuse.queries import QUERIES
from treefuse.shared import cut, cut_dir, mark, recut, scratch, tidy


def folders(spark):
    fs, at = pafs.FileSystem.from_uri(cut_dir(spark)) if "://" in cut_dir(spark) else (pafs.LocalFileSystem(), cut_dir(spark))
    return {f.base_name for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(("cut-", "pile-"))}


def test_a_call_leaves_its_results_alone(spark):
    points = cut(matrix(spark, [[float(i % 7), float(i % 3)] for i in range(30)]))
    before = folders(spark)
    fit = path.fit_path(points, [0.1, 1.0, 100.0], task_cells=0)
    assert len(folders(spark) - before) == 3  # levels, pointers, coordinates
    assert fit.levels.count() > 0


def test_a_query_leaves_its_result_alone_and_nothing_once_it_is_written(spark, sf_dir):
    before = folders(spark)
    out = QUERIES["labels_small_k"](spark, sf_dir)
    assert len(folders(spark) - before) == 1 and out.count() > 0
    now = folders(spark)
    with scratch():
        assert QUERIES["labels_small_k"](spark, sf_dir).count() > 0
    assert folders(spark) == now


def test_nothing_is_left_on_failure(spark):
    @tidy
    def fails():
        cut(spark.range(3))
        raise ZeroDivisionError

    before = folders(spark)
    with pytest.raises(ZeroDivisionError):
        fails()
    assert folders(spark) == before


def test_a_loop_keeps_its_last_state(spark):
    before = folders(spark)
    with scratch():
        since, now = mark(), cut(spark.range(3))
        for _ in range(4):
            now = recut(since, now.selectExpr("id + 1 AS id"))
        assert len(folders(spark) - before) == 1 and sorted(r["id"] for r in now.collect()) == [4, 5, 6]
    assert folders(spark) == before
