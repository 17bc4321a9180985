import numpy as np
import pytest

from treefuse.operators import trees
from treefuse.operators.kernels import bi_step
from treefuse.operators.trees import Tree


def random_tree(rng, n):
    parent = np.array([-1] + [int(rng.integers(max(0, i - 4), i)) for i in range(1, n)])
    edge = rng.random(n) * (rng.random(n) > 0.1)
    edge[0] = 0
    return Tree(parent, edge, rng.integers(1, 4, n).astype(float))


@pytest.mark.parametrize("seed", range(20))
def test_a_solve_from_other_cuts_ends_at_the_same_minimum(seed):
    rng = np.random.default_rng(seed)
    tree = random_tree(rng, int(rng.integers(1, 60)))
    x = np.round(rng.normal(size=(len(tree.parent), 9)) * 3, seed % 4)
    lams = rng.random(9) * 4
    want, fused = tree.solve(x, lams)
    for j, lam in enumerate(lams):
        assert np.allclose(tree.solve(x[:, [j]], lam)[0], want[:, [j]], atol=1e-9)
    for patience in (1, 3, 16):
        for shape in (x + rng.normal(size=x.shape) * 0.05, rng.normal(size=x.shape) * 5):
            cuts = tree.solve_from(shape, lams * 0.7, None)[2]
            got, joined, kept = tree.solve_from(x, lams, cuts, patience)
            assert np.allclose(got, want, atol=1e-9) and (joined == fused).all()
            again = tree.solve_from(x, lams, kept, patience)
            assert np.allclose(again[0], want, atol=1e-9) and (again[1] == fused).all()


def test_alternations_go_on_from_the_last_cuts(monkeypatch):
    """Late alternations hardly move a cut: they take fewer sweeps than a solve from nothing, and give the same states."""
    rng = np.random.default_rng(5)
    rows, columns = random_tree(rng, 300), random_tree(rng, 12)
    x = rng.normal(size=(300, 12))
    rise, sweeps = trees.Layout.rise, []
    monkeypatch.setattr(trees.Layout, "rise", lambda self, own, *a: (sweeps.append(own.size), rise(self, own, *a))[1])
    found, work = [], []
    for cuts in (None, [None, None]):
        state, sweeps[:] = (x.copy(), np.zeros_like(x), np.zeros_like(x)), []
        for _ in range(40):
            state = bi_step(rows, columns, *state, 1.0, 1.0, cuts)
        found.append(state)
        work.append(sum(sweeps))
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(*found, strict=True))
    assert work[1] < 0.6 * work[0]
