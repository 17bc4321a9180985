"""Small numeric helpers that run inside tasks, on one tree and one block of features."""

from __future__ import annotations

import numpy as np

from treefuse.operators.trees import Tree


def forest_edges(u: np.ndarray, v: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Positions of the minimum forest's edges, by (d2, u, v): rounds in which each component takes its smallest."""
    ids, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    order = np.lexsort((v, u, d2))
    a, b = ends[: len(u)][order], ends[len(u) :][order]
    label, taken = np.arange(len(ids)), np.zeros(len(u), bool)
    live = np.arange(len(u))
    while True:
        x, y = label[a[live]], label[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            return order[taken]
        best = np.full(len(ids), len(u))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        own = np.flatnonzero(best < len(u))
        edge = best[own]
        taken[edge] = True
        hook = np.arange(len(ids))
        hook[own] = label[a[edge]] + label[b[edge]] - own
        mutual = (hook[hook] == np.arange(len(ids))) & (np.arange(len(ids)) < hook)
        hook[mutual] = np.flatnonzero(mutual)
        while (hook != hook[hook]).any():
            hook = hook[hook]
        label = hook[label]


def root_at_smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree's edges -> its nodes, each one's parent (-1: root) and edge (-1: root) by position, and subtree sizes."""
    ids, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    n, m = len(ids), len(u)
    a, b = ends[:m], ends[m:]
    source, to, edge = np.concatenate((a, b)), np.concatenate((b, a)), np.tile(np.arange(m), 2)
    order = np.argsort(source, kind="stable")
    to, edge, begin = to[order], edge[order], np.searchsorted(source[order], np.arange(n + 1))
    parent, via, level, levels = np.full(n, -1), np.full(n, -1), np.array([0]), []
    while len(level):
        levels.append(level)
        count = begin[level + 1] - begin[level]
        at = np.repeat(begin[level] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        above = np.repeat(level, count)
        down = to[at] != parent[above]
        level = to[at][down]
        parent[level], via[level] = above[down], edge[at][down]
    size = np.ones(n, np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    return ids, parent, via, size


def shrink_factor(norm: float, lam: float, most: int) -> float:
    """The shrinkage of a column of this norm by accelerated proximal steps. Every iterate is a multiple of the
    column, so the recursion runs on the multiples; it ends after ten steps without descent."""
    if norm == 0:
        return 0.0
    x = v = 0.0
    lowest, idle = np.inf, 0
    for i in range(most):
        t = 2 / (i + 2)
        look = (1 - t) * x + t * v
        step = look - (look - 1) / 2
        u = step * max(0.0, 1 - lam / (abs(step) * norm)) if step else 0.0
        loss = ((1 - u) * norm) ** 2 / 2 + lam * abs(u) * norm
        new, idle = (u, 0) if loss < lowest else (x, idle + 1)
        lowest = min(lowest, loss)
        v = x + (u - x) / t
        if idle >= 10:
            break
        x = new
    return x


def pairwise(x: np.ndarray) -> float:
    """The sum of |a - b| over all pairs in each row, by sorting."""
    m = x.shape[1]
    return float((np.sort(x, 1) * (2 * np.arange(m) - m + 1)).sum())


def sparse_loss(data: np.ndarray, u: np.ndarray, lam: float, gamma: float) -> float:
    return 0.5 * ((data - u) ** 2).sum() + lam * pairwise(u) + gamma * np.sqrt((u**2).sum(1)).sum()


def bi_loss(data: np.ndarray, u: np.ndarray, lam: float, gamma: float) -> float:
    return 0.5 * ((data - u) ** 2).sum() + lam * pairwise(u) + gamma * pairwise(u.T)


def sparse_step(tree: Tree, u: np.ndarray, p: np.ndarray, q: np.ndarray, lam: float, gamma: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One alternation: shrink each column, then fuse it along the tree."""
    z = u + p
    y = z * [shrink_factor(float(np.linalg.norm(z[:, j])), gamma, most) for j in range(z.shape[1])]
    new, _ = tree.solve(y + q, lam)
    return new, z - y, y + q - new


def bi_step(rows: Tree, columns: Tree, u: np.ndarray, p: np.ndarray, q: np.ndarray, lam: float, gamma: float, cuts: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One alternation: fuse each column along the samples' tree, then each row along the features' tree. ``cuts``, a list of two,
    keeps where both trees were cut for the next alternation, which begins there."""
    cuts = [None, None] if cuts is None else cuts
    y, _, cuts[0] = rows.solve_from(u + p, lam, cuts[0])
    new, _, cuts[1] = columns.solve_from((y + q).T, gamma, cuts[1])
    return new.T, u + p - y, y + q - new.T


def matching(counts: np.ndarray) -> int:
    """The largest sum of a one-to-one matching of rows and columns (Hungarian method on the negated table)."""
    n = max(counts.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : counts.shape[0] + 1, 1 : counts.shape[1] + 1] = -counts
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            now = cost[i0] - u[i0] - v
            better = ~used & (now < slack)
            better[0] = False
            slack[better], way[better] = now[better], j0
            free = np.where(used, np.inf, slack)
            free[0] = np.inf
            j1 = int(free.argmin())
            step = free[j1]
            u[owner[used]] += step
            v[used] -= step
            slack[~used] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return int(-sum(cost[owner[j], j] for j in range(1, n + 1)))
