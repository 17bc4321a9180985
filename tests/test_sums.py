import numpy as np
import pytest

from treefuse.operators import fusion
from treefuse.shared import cut


def nodes_of(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(g, i, None if i == 0 else int(rng.integers(max(0, i - 3), i)), float(rng.random() + 0.1), 1.0 + i % 3, rng.normal(size=5).tolist()) for g in (0, 1) for i in range(n)]
    return rows, cut(spark.createDataFrame(rows, "g int, node_id long, parent_id long, edge_weight double, node_weight double, x array<double>"))


@pytest.mark.parametrize("cells", [0, 130, 3_000_000])
def test_sums_of_subtrees(spark, cells):
    """By doubling, two features a task, and all features a task."""
    rows, nodes = nodes_of(spark)
    want = {(g, i): np.array(x) for g, i, _, _, _, x in rows}
    for g, i, up, *_ in reversed(rows):
        if up is not None:
            want[g, up] = want[g, up] + want[g, i]
    got = {}
    for r in fusion.subtree_sums(nodes, cells).collect():
        got.setdefault((r["g"], r["node_id"]), {})[r["fb"]] = r["x"]
    assert got.keys() == want.keys()
    assert all(np.allclose(np.concatenate([v[b] for b in sorted(v)]), want[k]) for k, v in got.items())


@pytest.mark.parametrize("cells", [0, 3_000_000])
def test_a_certificate_finds_what_is_not_solved(spark, cells):
    _, nodes = nodes_of(spark)
    good = cut(fusion.solve(nodes, 0.7))
    assert all(r["violations"] == 0 for r in fusion.certificate(good, nodes, 0.7, task_cells=cells).collect())
    assert all(r["violations"] > 0 for r in fusion.certificate(good, nodes, 0.2, task_cells=cells).collect())
