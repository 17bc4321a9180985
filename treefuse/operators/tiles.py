"""Exact minimum trees of some ten thousand points, and of two such sets together: numpy helpers that run inside tasks.

Points are sorted by id, so positions stand for ids; edges are ordered by (squared length, smaller position, larger). A
set is split at medians into compact leaves. With any spanning tree at hand, an edge between two points can only be in the
minimum tree if it is not longer than the longest edge on the way between them. Bounds of that come from the
components at some lengths; distances of two leaves are measured roughly as one product, and what may lie within the bound is
measured again, feature after feature, as everywhere else.
"""

from __future__ import annotations

import numpy as np

from treefuse.operators.kernels import forest_edges

LEAF = 512

Edges = tuple[np.ndarray, np.ndarray, np.ndarray]  # smaller positions, larger positions, squared lengths


def prim(ids: np.ndarray, x: np.ndarray) -> Edges:
    """The minimum tree of a few thousand points: smaller ids, larger ids, squared lengths."""
    n = len(ids)
    u, v, d = np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0))
    x = np.ascontiguousarray(x.T)
    live = np.arange(1, n)  # outside the tree; those that went in stay in the arrays until half have, at infinite distance
    mine, own, best, source = x[:, 1:], ids[1:], np.full(max(n - 1, 0), np.inf), np.zeros(max(n - 1, 0), np.int64)
    at, dead, inside = 0, np.zeros(max(n - 1, 0), bool), 0
    for step in range(n - 1):
        d2 = (mine[0] - x[0, at]) ** 2
        for j in range(1, len(x)):
            d2 += (mine[j] - x[j, at]) ** 2
        d2[dead] = np.inf
        closer = d2 < best
        ties = np.flatnonzero((d2 == best) & ~dead)
        if len(ties):  # the smaller of the two edges' ends decides
            new, old, self_ = ids[at], ids[source[ties]], own[ties]
            low, high, old_low, old_high = np.minimum(self_, new), np.maximum(self_, new), np.minimum(self_, old), np.maximum(self_, old)
            closer[ties] = (low < old_low) | ((low == old_low) & (high < old_high))
        best[closer], source[closer] = d2[closer], at
        i = int(best.argmin())
        tied = np.flatnonzero(best == best[i])
        if len(tied) > 1:
            a, b = np.minimum(own[tied], ids[source[tied]]), np.maximum(own[tied], ids[source[tied]])
            i = int(tied[np.lexsort((b, a))[0]])
        a, b = own[i], ids[source[i]]
        u[step], v[step], d[step] = min(a, b), max(a, b), best[i]
        at = int(live[i])
        best[i], dead[i], inside = np.inf, True, inside + 1
        if 2 * inside > len(live):
            keep = ~dead
            live, mine, own, best, source, dead, inside = live[keep], np.ascontiguousarray(mine[:, keep]), own[keep], best[keep], source[keep], dead[keep], 0
            dead = np.zeros(len(live), bool)
    return u, v, d


def halves(x: np.ndarray, at: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """The positions ``at`` in leaves of at most ``most``: cut at the median of the widest feature until small enough."""
    done, open_ = [], [at]
    while open_:
        part = open_.pop()
        if len(part) <= most:
            done.append(np.sort(part))
            continue
        widest = int(np.argmax([np.ptp(column[part]) for column in x])) if len(x) else 0
        order = np.argpartition(x[widest][part], len(part) // 2) if len(x) else np.arange(len(part))
        open_ += [part[order[len(part) // 2 :]], part[order[: len(part) // 2]]]
    return done


def measured(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, added up as in ``prim``."""
    total = np.zeros(len(i))
    for k, column in enumerate(x):
        step = (column[i] - column[j]) ** 2
        total = total + step if k else step
    return total


def rough(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances between two leaves, and by how much they may be wrong."""
    if len(x) <= 6:
        total = np.zeros((len(a), len(b)))
        for column in x:
            total += (column[a][:, None] - column[b]) ** 2
        return total, 0.0
    left, right = x[:, a].T, x[:, b].T
    middle = left.mean(0)
    left, right = left - middle, right - middle
    p, q = (left**2).sum(1), (right**2).sum(1)
    total = left @ right.T
    total *= -2
    total += p[:, None]
    total += q
    return total, float(1e-15 * (len(x) + 8) * (p.max() + q.max()))


class Levels:
    """Components of a spanning tree's points by its edges up to some lengths, short ones first; the last one joins all."""

    def __init__(self, n: int, tree: Edges, leaves: list[np.ndarray]):
        order = np.argsort(tree[2], kind="stable")
        u, v, d = (t[order] for t in tree)
        back = np.unique(np.append(0, 2.0 ** np.arange(0, np.log2(max(len(d), 1)), 0.75)).astype(np.int64))  # counted from the longest edge
        self.lengths = np.unique(d[len(d) - 1 - back]) if len(d) else np.zeros(1)
        ends, label, begin, found = np.searchsorted(d, self.lengths, "right"), np.arange(n), 0, []
        for end in ends:
            a, b = u[begin:end], v[begin:end]
            begin = end
            while len(a):
                a, b = label[a], label[b]
                go = a != b
                a, b = np.minimum(a[go], b[go]), np.maximum(a[go], b[go])
                np.minimum.at(label, b, a)
                while (label != label[label]).any():
                    label = label[label]
            found.append(label.copy())
        self.labels = found
        starts = np.cumsum([0] + [len(leaf) for leaf in leaves])[:-1]
        flat = np.concatenate(leaves)
        low, high = (np.stack([f.reduceat(label[flat], starts) for label in found]) for f in (np.minimum, np.maximum))
        self.one = np.where(low == high, low, -1)  # a leaf's component at each length, -1: several

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of leaves, a length up to which all their points are joined."""
        out = np.full(len(a), self.lengths[-1])
        for length, one in zip(self.lengths[::-1], self.one[::-1], strict=True):
            out[(one[a] == one[b]) & (one[a] >= 0)] = length
        return out

    def useful(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which edges are not longer than a way between their ends."""
        left = np.flatnonzero(d <= self.lengths[-1])
        for length, label in zip(self.lengths[-2::-1], self.labels[-2::-1], strict=True):
            long = d[left] > length
            if long.any():
                long[long] = label[i[left[long]]] == label[j[left[long]]]
                left = left[~long]
        return left


def lightest(edges: list[Edges]) -> Edges:
    u, v, d = (np.concatenate(c) for c in zip(*edges, strict=True))
    keep = forest_edges(u, v, d)
    return u[keep], v[keep], d[keep]


def gaps(x: np.ndarray, leaves: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the boxes around leaves, by pairs."""
    out = np.zeros(len(a))
    for column in x:
        low, high = (np.array([f(column[leaf]) for leaf in leaves]) for f in (np.min, np.max))
        out += np.maximum(np.maximum(low[a] - high[b], low[b] - high[a]), 0) ** 2
    return out


def shortest(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> Edges:
    """A short edge between two leaves (the shortest but for rounding)."""
    i, j = np.unravel_index(int(np.argmin(rough(x, a, b)[0])), (len(a), len(b)))
    u, v = np.minimum(a[[i]], b[[j]]), np.maximum(a[[i]], b[[j]])
    return u, v, measured(x, u, v)


def improved(x: np.ndarray, tree: Edges, leaves: list[np.ndarray], a: np.ndarray, b: np.ndarray, skip: bool = True) -> Edges:
    """x: features x points. The minimum tree among a spanning tree's edges and all edges between the pairs (a, b) of leaves.
    Without ``skip``, leaves whose boxes are too far apart are measured as well."""
    n, gap = x.shape[1], gaps(x, leaves, a, b)
    order = np.argsort(gap, kind="stable")
    a, b, gap = a[order], b[order], gap[order]
    levels = Levels(n, tree, leaves)
    bound = levels.bounds(a, b)
    more, held = [], 0
    for k in range(len(a)):
        if skip and gap[k] > bound[k] * (1 + 1e-12):
            continue
        p, q = leaves[a[k]], leaves[b[k]]
        d2, error = rough(x, p, q)
        i, j = np.nonzero(~(d2 > bound[k] * (1 + 1e-12) + error))  # what is not a number is measured again
        if not len(i):
            continue
        u, v = np.minimum(p[i], q[j]), np.maximum(p[i], q[j])
        d = measured(x, u, v)
        keep = levels.useful(u, v, d)
        if not len(keep):
            continue
        more.append((u[keep], v[keep], d[keep]))
        held += len(keep)
        if held > max(2 * n, 300_000):
            tree, more, held = lightest([tree, *more]), [], 0
            levels = Levels(n, tree, leaves)
            bound = levels.bounds(a, b)
    return lightest([tree, *more]) if more else tree


def tree_of_points(x: np.ndarray, skip: bool = True, most: int = LEAF) -> Edges:
    """x: features x points -> the minimum tree."""
    n = x.shape[1]
    leaves = halves(x, np.arange(n), most)
    edges = [prim(leaf, x[:, leaf].T) for leaf in leaves] + [shortest(x, p, q) for p, q in zip(leaves, leaves[1:], strict=False)]
    tree = tuple(np.concatenate(c) for c in zip(*edges, strict=True))
    a, b = np.triu_indices(len(leaves), 1)
    return improved(x, tree, leaves, a, b, skip) if len(leaves) > 1 else tree


def tree_of_two(x: np.ndarray, left: np.ndarray, first: Edges, second: Edges, skip: bool = True, most: int = LEAF) -> Edges:
    """The minimum tree of two sets of points with known trees; ``left`` says which points are the first's."""
    mine, other = halves(x, np.flatnonzero(left), most), halves(x, np.flatnonzero(~left), most)
    leaves, m = mine + other, len(mine)
    a, b = np.repeat(np.arange(m), len(other)), m + np.tile(np.arange(len(other)), m)
    near = int(np.argmin(gaps(x, leaves, a, b)))
    bridge = shortest(x, leaves[a[near]], leaves[b[near]])
    tree = tuple(np.concatenate(c) for c in zip(first, second, bridge, strict=True))
    return improved(x, tree, leaves, a, b, skip)


def shortest_between(x: np.ndarray, left: np.ndarray) -> Edges:
    """A short edge between the points in ``left`` and the others: the shortest of their two nearest leaves."""
    mine, other = halves(x, np.flatnonzero(left)), halves(x, np.flatnonzero(~left))
    a, b = np.repeat(np.arange(len(mine)), len(other)), len(mine) + np.tile(np.arange(len(other)), len(mine))
    near = int(np.argmin(gaps(x, mine + other, a, b)))
    return shortest(x, mine[a[near]], other[b[near] - len(mine)])
