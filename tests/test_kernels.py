import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treefuse.operators.kernels import Tree, bi_loss, bi_step, forest_edges, matching, pairwise, root_at_smallest, shrink_factor, sparse_loss


def random_tree(rng, n, kind):
    parent = np.array([-1] + [int(rng.integers(0, i)) if kind == 0 else i - 1 if kind == 1 else 0 for i in range(1, n)])
    order = rng.permutation(n)
    place = np.argsort(order)
    out = np.full(n, -1)
    for i in range(n):
        out[place[i]] = place[parent[i]] if parent[i] >= 0 else -1
    return out


def subtree_sums(parent, s):
    out = s.copy()
    for v in range(len(parent)):
        at = parent[v]
        while at >= 0:
            out[at] += s[v]
            at = parent[at]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 50), st.integers(0, 2), st.integers(0, 10**6), st.sampled_from([0.0, 0.05, 0.5, 3.0, 1e6]), st.booleans())
def test_solution_meets_the_optimality_conditions(n, kind, seed, lam, ties):
    rng = np.random.default_rng(seed)
    parent, edge, weight = random_tree(rng, n, kind), rng.random(n), rng.integers(1, 4, n).astype(float)
    x = np.round(rng.normal(size=(n, 2)), 1 if ties else 8)
    tree = Tree(parent, edge, weight)
    theta, fused = tree.solve(x, lam)
    s = weight[:, None] * (theta - x)
    s = subtree_sums(parent, s)
    for v in range(n):
        if parent[v] < 0:
            assert np.abs(s[v]).max() < 1e-9
            continue
        gap = theta[v] - theta[parent[v]]
        assert (np.abs(s[v]) <= lam * edge[v] + 1e-8).all()
        apart = np.abs(gap) > 1e-8
        assert np.allclose(s[v][apart], (-lam * edge[v] * np.sign(gap))[apart], atol=1e-7)
        assert not fused[v][apart].any()


def test_extreme_penalties():
    rng = np.random.default_rng(0)
    x, parent = rng.normal(size=(30, 3)), random_tree(rng, 30, 0)
    tree = Tree(parent, np.ones(30), np.ones(30))
    assert np.allclose(tree.solve(x, 0.0)[0], x)
    theta, fused = tree.solve(x, 1e9)
    assert np.allclose(theta, x.mean(0)) and fused[parent >= 0].all()


def test_contraction_keeps_means():
    rng = np.random.default_rng(1)
    parent = random_tree(rng, 40, 0)
    tree = Tree(parent, rng.random(40), rng.integers(1, 5, 40).astype(float))
    x = rng.normal(size=(40, 2))
    fused = (rng.random(40) < 0.5) & (parent >= 0)
    small, mean, to, stay = tree.contract(x, fused)
    assert np.isclose(small.node.sum(), tree.node.sum())
    assert np.allclose((small.node[:, None] * mean).sum(0), (tree.node[:, None] * x).sum(0))
    assert (to[stay] == np.arange(len(stay))).all()


def vector_shrink(y, lam, most):
    x = v = np.zeros_like(y)
    low, idle = np.inf, 0
    for i in range(most):
        t = 2 / (i + 2)
        step = ((1 - t) * x + t * v + y) / 2
        u = step * max(0, 1 - lam / np.linalg.norm(step))
        loss = ((y - u) ** 2).sum() / 2 + lam * np.linalg.norm(u)
        new = u if loss < low else x
        idle = 0 if loss < low else idle + 1
        low, v = min(low, loss), x + (u - x) / t
        if idle >= 10:
            break
        x = new
    return x


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.floats(0.01, 3), st.integers(0, 10**6))
def test_scalar_shrinkage_equals_the_vector_recursion(n, lam, seed):
    y = np.random.default_rng(seed).normal(size=n)
    assert np.allclose(vector_shrink(y, lam, 100), shrink_factor(float(np.linalg.norm(y)), lam, 100) * y, atol=1e-9)


def test_shrinkage_of_nothing():
    assert shrink_factor(0.0, 1.0, 100) == 0.0


def test_pair_sums_and_losses():
    rng = np.random.default_rng(2)
    x, u = rng.normal(size=(7, 5)), rng.normal(size=(7, 5))
    rows = sum(abs(r[i] - r[j]) for r in u for i, j in itertools.combinations(range(5), 2))
    columns = sum(abs(c[i] - c[j]) for c in u.T for i, j in itertools.combinations(range(7), 2))
    assert np.isclose(pairwise(u), rows)
    assert np.isclose(sparse_loss(x, u, 2, 3), ((x - u) ** 2).sum() / 2 + 2 * rows + 3 * np.linalg.norm(u, axis=1).sum())
    assert np.isclose(bi_loss(x, u, 2, 3), ((x - u) ** 2).sum() / 2 + 2 * rows + 3 * columns)


def test_two_sided_step_is_symmetric():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 8))
    tree = Tree(random_tree(rng, 8, 0), np.ones(8), np.ones(8))
    z = np.zeros_like(x)
    a = bi_step(tree, tree, x, z, z, 0.1, 0.1)[0]
    assert a.shape == x.shape and not np.allclose(a, x)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 25), st.integers(0, 10**6))
def test_forest_and_root(n, seed):
    rng = np.random.default_rng(seed)
    u, v = np.triu_indices(n, 1)
    ids = np.sort(rng.choice(1000, n, replace=False))
    d2 = np.round(rng.random(len(u)), 1)
    got = forest_edges(ids[u], ids[v], d2)
    parent, want = list(range(n)), []

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k in np.lexsort((v, u, d2)):
        a, b = top(u[k]), top(v[k])
        if a != b:
            parent[a] = b
            want.append(k)
    assert sorted(got) == sorted(want)
    names, up, via, size = root_at_smallest(ids[u[got]], ids[v[got]])
    assert (names == ids).all() and up[0] == -1 and size[0] == n
    for i in range(1, n):
        assert {names[i], names[up[i]]} == {ids[u[got[via[i]]]], ids[v[got[via[i]]]]}
    assert all(size[i] == 1 + size[up == i].sum() for i in range(n))


@pytest.mark.parametrize("seed", range(20))
def test_matching_is_the_best_one(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 20, (int(rng.integers(1, 5)), int(rng.integers(1, 5))))
    k = max(a.shape)
    b = np.zeros((k, k), int)
    b[: a.shape[0], : a.shape[1]] = a
    assert matching(a) == max(sum(b[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))


def test_nothing_fuses_before_the_next_fusion():
    rng = np.random.default_rng(9)
    seen = {True: 0, False: 0}
    for _ in range(200):
        n = int(rng.integers(2, 12))
        tree = Tree(np.array([-1, *(int(rng.integers(0, i)) for i in range(1, n))]), rng.random(n), rng.random(n) + 0.5)
        x, lam = rng.normal(size=(n, 2)), float(rng.random() * 0.3)
        apart = lam < tree.next_fusion(x)
        fused = tree.solve(x, lam)[1][1:]
        assert not (apart and fused.all(1).any())
        seen[apart] += 1
        if n > 2 and 0 < tree.next_fusion(x[:, :1]) < np.inf:  # of a single column it is the exact penalty
            assert tree.solve(x[:, :1], tree.next_fusion(x[:, :1]) * (1 + 1e-6) + 1e-6)[1].any()
    assert min(seen.values()) > 20


@pytest.mark.parametrize("kind", ["chain", "star", "bushy"])
def test_large_trees_of_any_depth(kind):
    """The optimality conditions on 100,000 nodes, and seconds that depth does not decide."""
    rng, n = np.random.default_rng(4), 100_000
    parent = {"chain": np.arange(n) - 1, "star": np.where(np.arange(n) > 0, 0, -1), "bushy": np.array([-1, *(int(v) for v in rng.integers(0, np.arange(1, n)))])}[kind]
    edge, weight, x, lam = rng.random(n), rng.integers(1, 4, n).astype(float), rng.normal(size=(n, 1)), 2.0
    tree = Tree(parent, edge, weight)
    began = time.process_time()
    theta, fused = tree.solve(x, lam)
    assert time.process_time() - began < 20
    s = weight * (theta - x)[:, 0]
    for v in range(n - 1, 0, -1):  # parents come first
        s[parent[v]] += s[v]
    gap, bound = (theta[1:] - theta[parent[1:]])[:, 0], lam * edge[1:]
    assert abs(s[0]) < 1e-6 and (np.abs(s[1:]) <= bound + 1e-6).all()
    apart = np.abs(gap) > 1e-7
    assert np.allclose(s[1:][apart], (-bound * np.sign(gap))[apart], atol=1e-6)
    assert 0.2 < fused.mean() < 1
