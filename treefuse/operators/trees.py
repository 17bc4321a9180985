"""Rooted trees as arrays, laid out so that sweeps over them take few steps whatever their depth.

Each node's largest subtree continues its path; the others begin paths of their own. On the way to the root there
are at most log2(n) changes of path, so paths are handled level by level of these changes, all paths of a level
at once. Along a path, what a node hands to its parent is a clipped sum, and clipped sums can be composed, so
a whole path takes about log2(length) steps of doubling.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np


def up_sums(up: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of value over each node and all its ancestors (up: parents' positions, -1: none), by doubling."""
    value, far = value.copy(), up.copy()
    while (go := np.flatnonzero(far >= 0)).size:
        value[go] += value[far[go]]
        far[go] = far[far[go]]
    return value


def down_counts(up: np.ndarray) -> np.ndarray:
    """The size of each node's subtree, by doubling."""
    size, far = np.ones(len(up), np.int64), up.copy()
    while (go := np.flatnonzero(far >= 0)).size:
        size += np.bincount(far[go], size[go], len(up)).astype(np.int64)
        far[go] = far[far[go]]
    return size


class Layout:
    """Nodes by level of path, path, and place on it: the next node of a path is the next position.

    ``bottom``: a node whose path, from the root, ends there, so that something from outside can come in."""

    def __init__(self, parent: np.ndarray, bottom: int = -1):
        n, size = len(parent), down_counts(parent)
        if bottom >= 0:  # the way from the root to it is one path
            size[bottom], at = 2 * n + 1, parent[bottom]
            while at >= 0:
                size[at] += 2 * n + 1
                at = parent[at]
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.lexsort((size[kids], parent[kids]))]
        above = parent[kids]
        heavy = kids[np.concatenate((above[1:] != above[:-1], [True]))] if len(kids) else kids
        head = np.ones(n, bool)
        head[heavy] = False
        if bottom >= 0:
            head[parent == bottom] = True
        depth = up_sums(parent, (parent >= 0).astype(np.int64))
        level = up_sums(parent, (head & (parent >= 0)).astype(np.int64))
        top = np.where(head, np.arange(n), parent)
        while not (top == top[top]).all():
            top = top[top]
        self.nodes = np.lexsort((depth, top, level))
        self.place = np.empty(n, np.int64)
        self.place[self.nodes] = np.arange(n)
        self.up = np.where(parent >= 0, self.place[parent], -1)[self.nodes]
        self.head, self.bottom = head[self.nodes], self.place[bottom] if bottom >= 0 else -1
        heads = np.append(np.flatnonzero(self.head), n)
        self.room = np.repeat(heads[1:], np.diff(heads)) - 1 - np.arange(n)  # how many nodes follow on the path
        level = level[self.nodes]
        self.levels = []
        bounds = np.searchsorted(level, np.arange(level.max(initial=-1) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            steps, d, room = [], 1, self.room[a:b]
            while (at := np.flatnonzero(room >= d)).size:
                steps.append((at, at + d))
                d *= 2
            first = a + np.flatnonzero(self.head[a:b])
            hung = first[np.argsort(self.up[first], kind="stable")]
            tops, where = np.unique(self.up[hung], return_index=True)
            self.levels.append((a, b, steps, first, hung, tops, where))

    def rise(self, own: np.ndarray, low: np.ndarray, high: np.ndarray, inflow: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each node's own value plus what its children hand up, where a node hands up its sum clipped to low and
        high. ``inflow`` comes in at the bottom. Also, at the bottom's path, the maps m -> clip(m + s, lo, hi) from
        the inflow to what each node hands up, as (3, path, columns)."""
        own, out = own.copy(), np.empty_like(own)
        maps = np.zeros((3, 0, own.shape[1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            a, b, steps, _, hung, tops, where = self.levels[depth]
            s, lo, hi = own[a:b].copy(), low[a:b].copy(), high[a:b].copy()
            for i, j in steps:
                s1, lo1, hi1 = s[i], lo[i], hi[i]
                lo2, hi2 = np.clip(lo[j] + s1, lo1, hi1), np.clip(hi[j] + s1, lo1, hi1)
                s[i] = s1 + s[j]
                lo[i], hi[i] = lo2, hi2
            message = np.clip(s, lo, hi)
            below = np.zeros_like(message)
            if self.bottom >= 0 and depth == 0:
                path = slice(0, self.bottom + 1)
                maps = np.stack((s[path], lo[path], hi[path]))
                if inflow is not None:
                    message[path] = np.clip(s[path] + inflow, lo[path], hi[path])
                    below[self.bottom] = inflow
            more = np.flatnonzero(self.room[a:b] > 0)
            below[more] = message[more + 1]
            out[a:b] = own[a:b] + below
            if depth:
                own[tops] += np.add.reduceat(message[hung - a], where, axis=0)
        return out, maps

    def source(self, fixed: np.ndarray) -> np.ndarray:
        """For each node and column, the nearest fixed node at or above it; roots count as fixed."""
        out = np.empty(fixed.shape, np.int64)
        for depth, (a, b, _, first, *_) in enumerate(self.levels):
            at = np.where(fixed[a:b], np.arange(b - a)[:, None], 0)
            at[first - a] = (first - a)[:, None]
            at = np.maximum.accumulate(at, 0)
            begin = np.broadcast_to(np.arange(a, b)[:, None], at.shape)
            if depth:
                begin = begin.copy()
                begin[first - a] = np.where(fixed[first], first[:, None], out[self.up[first]])
            out[a:b] = np.take_along_axis(begin, at, 0)
        return out


def sums_of(source: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values' sums by source and column, as an array of the same shape."""
    n, p = source.shape
    key = (source * p + np.arange(p)).ravel()
    return [np.bincount(key, v.ravel(), n * p).reshape(n, p) for v in values]


class Tree:
    """A rooted tree by parents' positions (-1: root), with its edges' and nodes' weights."""

    def __init__(self, parent: np.ndarray, edge: np.ndarray, node: np.ndarray):
        self.parent, self.edge, self.node = parent, edge, node

    @cached_property
    def shape(self) -> Layout:
        return Layout(self.parent)

    def solve(self, x: np.ndarray, lam: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes x features: the minimiser of sum w (x - t)^2 / 2 + lam * sum e |t - t_parent| in each column, and
        where a node has its parent's value. ``lam`` may have a value for each column.

        All pieces of the tree are held at their best constants; where the tree would rather lie above its
        piece's constant, and where below, is read off the clipped derivatives, and pieces are cut between
        such parts until none is left (threshold sweeps; see Hochbaum 2001, Chambolle & Darbon 2009).
        """
        return self.solve_from(x, lam, None)[:2]

    def solve_from(self, x: np.ndarray, lam: float | np.ndarray, side_of: np.ndarray | None, patience: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``solve``, from the cuts of a similar problem: for each edge 0 (not cut), 1 (the node lies above its parent) or -1,
        as the third result gives them; None: nothing is cut. A cut whose sides have changed places is taken back. The
        conditions at the end are the same, so the result is; a column that has not come to it after ``patience`` rounds
        begins anew without cuts."""
        shape = self.shape
        order, up = shape.nodes, shape.up
        has = up >= 0
        column, bound = x[order], np.broadcast_to(self.edge[order][:, None] * lam, x.shape)
        weight = np.broadcast_to(self.node[order][:, None], column.shape)
        wx = weight * column
        noise, near = 1e-13 * (1 + np.abs(wx).sum(0)), 1e-9 * (1 + np.ptp(column, 0)) if len(x) else np.zeros(x.shape[1])
        theta, fused = np.empty_like(column), np.zeros(column.shape, bool)
        left = np.arange(x.shape[1])  # the columns that are not done
        live = has[:, None] & (bound > 0)  # an edge without weight pulls at nothing
        sign = np.zeros(column.shape, np.int8) if side_of is None else np.where(live, side_of, 0)  # of the cut edges
        signs, warm, turn = np.zeros(column.shape, np.int8), side_of is not None, 0
        pull, whole = np.zeros(column.shape), live & (sign == 0)  # whole: the edge above is not cut
        if warm:
            pull = self._pulls(sign * bound)
        while len(left):
            source = shape.source(~whole)
            total, mass = sums_of(source, wx - pull, weight)
            best = np.take_along_axis(total / np.where(mass == 0, 1, mass), source, 0)
            if warm:
                turn += 1
                back = sign * (best - best[up]) < 0
                crossed = back.any(0)
                if turn == patience:
                    sign[:], warm = 0, False
                    whole, pull = live.copy(), np.zeros(pull.shape)
                    continue
                if crossed.any():
                    sign[back] = 0
                    whole |= back
                    pull[:, crossed] = self._pulls(sign[:, crossed] * bound[:, crossed])
                    if crossed.mean() > 0.2:
                        continue
            else:
                crossed = np.zeros(len(left), bool)
            limit = np.where(whole, bound, 0)
            slope, _ = shape.rise(weight * best - wx + pull, -limit, limit)
            limit = limit + noise
            own = (slope < -limit).astype(np.int8) - (slope > limit).astype(np.int8)
            side = np.take_along_axis(own, shape.source((own != 0) | ~whole), 0)
            cut = whole & (side != side[up])
            cut[:, crossed] = False
            going = cut.any(0) | crossed
            if not going.all():
                done = left[~going]
                theta[:, done] = best[:, ~going]
                same = np.abs(theta[:, done] - theta[up][:, done]) <= near[~going]
                fused[:, done] = (whole[:, ~going] | same) & has[:, None]
                signs[:, done] = sign[:, ~going]
                left, cut, side = left[going], cut[:, going], side[:, going]
                pull, whole, wx, weight, bound, noise, near, sign, live = pull[:, going], whole[:, going], wx[:, going], weight[:, going], bound[:, going], noise[going], near[going], sign[:, going], live[:, going]
            i, j = np.nonzero(cut)
            above = side[i, j] > side[up[i], j]
            push = np.where(above, bound[i, j], -bound[i, j])
            pull[i, j] += push
            np.subtract.at(pull, (up[i], j), push)
            whole[i, j], sign[i, j] = False, np.where(above, 1, -1)
        return theta[shape.place], fused[shape.place], signs

    def _pulls(self, push: np.ndarray) -> np.ndarray:
        """What cut edges pull at their nodes and, the other way, at the parents (in the layout's order)."""
        up, p = self.shape.up, push.shape[1]
        i, j = np.nonzero(push)
        return push - np.bincount(up[i] * p + j, push[i, j], push.size).reshape(push.shape)

    def next_fusion(self, x: np.ndarray) -> float:
        """A penalty below which no node gets its parent's value everywhere. As long as no edge of a column changes
        its direction, each node moves by the pull of its edges; the column that lasts longest counts."""
        has = np.flatnonzero(self.parent >= 0)
        if not len(has):
            return np.inf
        above, edge, longest = self.parent[has], self.edge[has], 0.0
        for column in x.T:
            gap = column[above] - column[has]
            way = np.sign(gap)
            speed = (np.bincount(has, edge * way, len(column)) - np.bincount(above, edge * way, len(column))) / self.node
            closing = (speed[has] - speed[above]) * way
            room = np.abs(gap) - 1e-8 * (1 + np.ptp(column))
            if (room <= 0).any():
                continue
            meets = closing > 0
            longest = max(longest, float((room[meets] / closing[meets]).min(initial=np.inf)))
        return longest

    def contract(self, x: np.ndarray, fused: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray]:
        """Fused nodes join their topmost fused ancestor: the new tree, weighted means, each node's new
        position, and which nodes stay."""
        top = np.where(fused, self.parent, np.arange(len(fused)))
        while not (top == top[top]).all():
            top = top[top]
        stay = np.flatnonzero(~fused)
        place = np.full(len(fused), -1)
        place[stay] = np.arange(len(stay))
        to = place[top]
        weight = np.bincount(to, self.node, len(stay))
        mean = np.stack([np.bincount(to, self.node * x[:, j], len(stay)) for j in range(x.shape[1])], 1) / weight[:, None] if x.shape[1] else np.zeros((len(stay), 0))
        above = np.where(self.parent[stay] >= 0, to[self.parent[stay]], -1)
        return Tree(above, self.edge[stay], weight), mean, to, stay
