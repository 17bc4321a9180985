import numpy as np
import pytest

from treefuse.operators import fusion, tree_pieces
from treefuse.shared import cut


def parents(kind, n, rng):
    return {
        "chain": np.arange(n) - 1,
        "star": np.where(np.arange(n) > 0, 0, -1),
        "bushy": np.array([-1, *(int(rng.integers(0, i)) for i in range(1, n))]),
        "broom": np.array([-1, *(i - 1 if i < n // 2 else n // 2 - 1 for i in range(1, n))]),
    }[kind]


def forest(spark, rng, kinds, n):
    rows = []
    for g, kind in enumerate(kinds):
        for i, p in enumerate(parents(kind, n, rng).tolist()):
            rows.append((g, 7 * i + 3, None if p < 0 else 7 * p + 3, float(rng.random()) if p >= 0 else 0.0, float(rng.integers(1, 4)), np.round(rng.normal(size=3), 1 if g % 2 else 8).tolist()))
    return cut(spark.createDataFrame(rows, "g int, node_id long, parent_id long, edge_weight double, node_weight double, x array<double>"))


@pytest.mark.parametrize("most", [1, 5, 12])
def test_pieces_are_connected_and_have_one_bottom(spark, most):
    rng, n = np.random.default_rng(most), 60
    kinds = ["chain", "star", "bushy", "broom"]
    nodes = forest(spark, rng, kinds, n)
    placed, pieces = tree_pieces.cut_tree(nodes.select("g", "node_id", "parent_id"), most)
    piece = {(r["g"], r["node_id"]): r["piece"] for r in placed.collect()}
    told = {(r["g"], r["piece"]): r for r in pieces.collect()}
    up = {(r["g"], r["node_id"]): r["parent_id"] for r in nodes.collect()}
    assert piece.keys() == up.keys() and told.keys() == {(g, p) for (g, _), p in piece.items()}
    sizes, tops = {}, {}
    for (g, v), p in piece.items():
        sizes[g, p] = sizes.get((g, p), 0) + 1
        above = up[g, v]
        if above is None:
            assert told[g, p]["up_piece"] is None
            tops.setdefault((g, p), []).append(v)
        elif piece[g, above] != p:
            assert told[g, p]["up_piece"] == piece[g, above] and told[g, piece[g, above]]["bottom"] == above
            tops.setdefault((g, p), []).append(v)
    assert all(len(v) == 1 or told[k]["bottom"] is None for k, v in tops.items())
    # Bins are dealt by hash, so one may hold more than its share.
    assert max(sizes.values()) <= 4 * most + 2
    for g in range(len(kinds)):
        assert sum(k[0] == g for k in sizes) <= 3 * n / most + 2


@pytest.mark.parametrize(("most", "lam"), [(1, 0.4), (9, 3.0)])
def test_pieces_give_the_solution_of_whole_trees(spark, most, lam):
    rng = np.random.default_rng(most)
    nodes = forest(spark, rng, ["chain", "star", "bushy", "broom"], 50)
    cells = nodes.selectExpr("g", "node_id", "parent_id", "edge_weight", "node_weight", "0 as fb", "x")
    got = {(r["g"], r["node_id"]): r for r in tree_pieces.solve_in_pieces(cells, lam, most).collect()}
    want = {(r["g"], r["node_id"]): r for r in fusion.solve(nodes, lam).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert np.allclose(r["x"], want[k]["theta"], atol=1e-9) and (r["fused"] and r["parent_id"] is not None) == want[k]["fused"]
