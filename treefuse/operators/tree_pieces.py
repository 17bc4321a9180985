"""Solving the fusion problem on trees that no task holds.

A tree is cut by the sizes of its subtrees into connected pieces of about ``most`` nodes. A piece has one top and at
most one bottom, the node that other pieces hang from; or it is a bin of whole subtrees that hang from one node. So all
that a piece tells the others are a few numbers a feature: the sums of the parts at its top and bottom, the clipped sum
that turns what comes in at its bottom into what goes out at its top, and which side its bottom takes. Pieces form a
tree themselves, at most three for each ``most`` nodes, whose numbers one task a block of features puts together.

A sweep of ``Tree.solve`` is three passes over the pieces, whatever the depth of the tree; the number of sweeps
does not depend on the pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.operators.trees import Layout, sums_of
from treefuse.shared import cut, forget, mark, recut, settle, tidy

# What a piece and the tree of pieces tell each other, one number a feature each.
# extra: what its children have pulled at the bottom. link: the edge above the top is not cut. through: top and bottom are in one
# part. t_, m_: weighted values and weights of the parts at linked tops, and at the bottom. best_: parts' constants at the
# bottom and at the node above. s, low, high: the map from inflow to outflow. fixed, takes: the bottom's side, or that it takes
# the side above. back: what the tops' cut edges pull at the node above.
NUMBERS = "noise near extra link through t_top m_top t_bottom m_bottom best_up best_bottom s low high inflow fixed takes side_up back".split()


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """g, node_id, parent_id, size: by doubling, about log(depth) rounds of joins."""
    since = mark()
    now = cut(tree.select("g", "node_id", "parent_id", F.col("parent_id").alias("far"), F.lit(1).cast("bigint").alias("size")))
    while not now.where("far is not null").isEmpty():
        sent = now.where("far is not null").groupBy("g", F.col("far").alias("node_id")).agg(F.sum("size").alias("more"))
        hop = now.select("g", F.col("node_id").alias("far"), F.col("far").alias("further"))
        moved = now.join(sent, ["g", "node_id"], "left").join(hop, ["g", "far"], "left")
        now = recut(since, moved.select("g", "node_id", "parent_id", F.col("further").alias("far"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return now.select("g", "node_id", "parent_id", "size")


@tidy
def cut_tree(tree: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """tree(g, node_id, parent_id) -> g, node_id, piece; and g, piece, up_piece, bottom, a row a piece.

    Nodes with ``most`` nodes or more below them are upper. An upper node goes on with its only upper child while both
    sizes are in one step of ``most``; lower subtrees go with their upper node if they fit, else into bins."""
    sized = subtree_sizes(tree).withColumn("upper", (F.col("size") >= most) | F.col("parent_id").isNull())
    sized = cut(sized.withColumn("step", F.floor(F.col("size") / most)))
    upper = sized.where("upper")
    kids = sized.where("parent_id is not null").groupBy("g", F.col("parent_id").alias("node_id")).agg(F.count(F.when(F.col("upper"), 1)).alias("uppers"), F.sum(F.when(~F.col("upper"), F.col("size")).otherwise(0)).alias("mass"))
    kids = cut(upper.join(kids, ["g", "node_id"], "left").select("g", "node_id", "step", F.coalesce("uppers", F.lit(0)).alias("uppers"), F.coalesce("mass", F.lit(0)).alias("mass")))
    above = kids.select("g", F.col("node_id").alias("parent_id"), F.col("step").alias("up_step"), "uppers")
    joined = upper.join(above, ["g", "parent_id"], "left").select("g", "node_id", F.when((F.col("uppers") == 1) & (F.col("step") == F.col("up_step")), F.col("parent_id")).otherwise(F.col("node_id")).alias("rep"))
    runs = settle(joined, ["g"], "node_id", "rep").select("g", "node_id", F.col("rep").cast("string").alias("piece"))
    up = sized.select("g", F.col("node_id").alias("parent_id"), F.col("upper").alias("under"))
    lower = sized.where("not upper").join(up, ["g", "parent_id"])
    tops = settle(lower.select("g", "node_id", F.when(F.col("under"), F.col("node_id")).otherwise(F.col("parent_id")).alias("top")), ["g"], "node_id", "top")
    hung = lower.where("under").join(kids.select("g", F.col("node_id").alias("parent_id"), "mass"), ["g", "parent_id"]).join(runs.select("g", F.col("node_id").alias("parent_id"), F.col("piece").alias("run")), ["g", "parent_id"])
    own_bin = F.concat_ws(":", F.col("parent_id").cast("string"), F.pmod(F.xxhash64("node_id"), F.ceil(F.col("mass") / most)).cast("string"))
    hung = hung.select("g", F.col("node_id").alias("top"), F.when(F.col("mass") <= most, F.col("run")).otherwise(own_bin).alias("piece"))
    placed = cut(runs.unionByName(tops.join(hung, ["g", "top"]).select("g", "node_id", "piece")))
    mine = placed.join(sized.select("g", "node_id", "parent_id"), ["g", "node_id"]).join(placed.select("g", F.col("node_id").alias("parent_id"), F.col("piece").alias("up_piece")), ["g", "parent_id"], "left")
    pieces = cut(mine.groupBy("g", "piece").agg(F.max(F.when(F.col("piece") != F.col("up_piece"), F.struct("up_piece", "parent_id"))).alias("u")))
    bottoms = pieces.where("u is not null").select("g", F.col("u.up_piece").alias("piece"), F.col("u.parent_id").alias("bottom")).distinct()
    return placed, pieces.select("g", "piece", "u.up_piece").join(bottoms, ["g", "piece"], "left")


def matrix(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def plain(table: pa.Table) -> pa.Table:
    """Lists with elements that may be null, as results declare them, whatever Spark knows about these."""
    return table.cast(pa.schema([pa.field(f.name, pa.list_(pa.float64())) if pa.types.is_list(f.type) else f for f in table.schema]))


def replaced(table: pa.Table, **columns: np.ndarray) -> pa.Table:
    for name, x in columns.items():
        table = table.set_column(table.schema.get_field_index(name), name, lists(x))
    return table


class Piece:
    """One piece's nodes in a task, all arrays in the order of its layout."""

    def __init__(self, state: pa.Table, border: pa.Table):
        self.state = state = state.sort_by("node_id")
        ids, above = state.column("node_id").to_numpy(), state.column("parent_id")
        up = np.where(above.is_valid().to_numpy(), above.fill_null(0).to_numpy(), -1)
        at = np.minimum(np.searchsorted(ids, up), len(ids) - 1)
        parent = np.where(above.is_valid().to_numpy() & (ids[at] == up), at, -1)
        bottom = border.column("bottom")[0].as_py()
        self.shape = shape = Layout(parent, -1 if bottom is None else int(np.searchsorted(ids, bottom)))
        take = lambda name: matrix(state, name)[shape.nodes]
        self.weight = state.column("node_weight").to_numpy()[shape.nodes][:, None]
        self.wx, self.pull, self.whole = self.weight * take("x"), take("pull"), take("whole") > 0
        self.weight = np.broadcast_to(self.weight, self.wx.shape)
        # An edge that is cut hands nothing on; a root has no edge, so its whole is 0 from the start.
        self.bound = state.column("bound").to_numpy()[shape.nodes][:, None]
        self.tops, self.bottom = np.flatnonzero(shape.up < 0), shape.bottom
        self.told = {name: matrix(border, name)[0] for name in NUMBERS}
        self.border = border

    def sums(self) -> dict[str, np.ndarray]:
        source = self.shape.source(~self.whole)
        total, mass = sums_of(source, self.wx - self.pull, self.weight)
        linked, b, none = self.whole[self.tops], self.bottom, np.zeros(self.wx.shape[1])
        through = (source[b] == self.tops[0]).astype(float) if b >= 0 else none
        apart = linked & (through == 0)
        at_bottom = lambda v: np.take_along_axis(v, source[b : b + 1], 0)[0] if b >= 0 else none
        return {"link": linked.all(0), "through": through, "t_top": (total[self.tops] * apart).sum(0), "m_top": (mass[self.tops] * apart).sum(0), "t_bottom": at_bottom(total), "m_bottom": at_bottom(mass)}

    def settle_best(self) -> None:
        """The constants of all parts, with what is known about those that reach out of the piece."""
        if self.bottom >= 0:
            self.pull[self.bottom] += self.told["extra"]
        source = self.shape.source(~self.whole)
        total, mass = sums_of(source, self.wx - self.pull, self.weight)
        part = total / np.where(mass == 0, 1, mass)
        if self.bottom >= 0:
            np.put_along_axis(part, source[self.bottom : self.bottom + 1], self.told["best_bottom"][None], 0)
        part[self.tops] = np.where(self.whole[self.tops], self.told["best_up"], part[self.tops])
        self.best = np.take_along_axis(part, source, 0)
        self.limit = np.where(self.whole, self.bound, 0)

    def outflow(self) -> dict[str, np.ndarray]:
        value, maps = self.shape.rise(self.weight * self.best - self.wx + self.pull, -self.limit, self.limit)
        if self.bottom >= 0:
            return dict(zip(("s", "low", "high"), maps[:, 0], strict=True))
        sent = np.clip(value[self.tops], -self.limit[self.tops], self.limit[self.tops]).sum(0)
        return {"s": np.zeros_like(sent), "low": sent, "high": sent}

    def sides(self) -> np.ndarray:
        slope, _ = self.shape.rise(self.weight * self.best - self.wx + self.pull, -self.limit, self.limit, self.told["inflow"])
        limit = self.limit + self.told["noise"]
        return (slope < -limit).astype(np.int8) - (slope > limit).astype(np.int8)

    def bottom_side(self) -> dict[str, np.ndarray]:
        if self.bottom < 0:
            none = np.zeros(self.wx.shape[1])
            return {"fixed": none, "takes": none}
        own = self.sides()
        source = self.shape.source((own != 0) | ~self.whole)[self.bottom]
        top = self.tops[0]
        return {"fixed": np.take_along_axis(own, source[None], 0)[0], "takes": (source == top) & (own[top] == 0) & self.whole[top]}

    def divide(self) -> tuple[np.ndarray, np.ndarray]:
        """Cuts parts in two where they want to; also what the tops' cut edges pull above, and how many are cut."""
        own, tops, up = self.sides(), self.tops, self.shape.up
        own[tops] = np.where((own[tops] == 0) & self.whole[tops], self.told["side_up"].astype(np.int8), own[tops])
        side = np.take_along_axis(own, self.shape.source((own != 0) | ~self.whole), 0)
        other = np.where(up[:, None] >= 0, side[up], self.told["side_up"])
        cut_here = self.whole & (side != other)
        push = np.where(cut_here, np.where(side > other, self.bound, -self.bound), 0)
        if self.bottom >= 0:
            self.pull[self.bottom] -= self.told["extra"]  # stays with the border
        self.pull += push
        inner = np.flatnonzero(up >= 0)
        np.subtract.at(self.pull, up[inner], push[inner])
        self.whole &= ~cut_here
        return -push[tops].sum(0), cut_here.sum(0)

    def rows(self, **columns: np.ndarray) -> pa.Table:
        return replaced(self.state, **{k: v[self.shape.place] for k, v in columns.items()})


def skeleton(border: pa.Table) -> tuple[Layout, dict[str, np.ndarray]]:
    """The tree of pieces and their numbers, in the order of its layout."""
    names, up = border.column("piece").to_pylist(), border.column("up_piece").to_pylist()
    at = {name: i for i, name in enumerate(names)}
    shape = Layout(np.array([-1 if u is None else at[u] for u in up]))
    return shape, {name: matrix(border, name)[shape.nodes] for name in NUMBERS}


def join_sums(border: pa.Table) -> pa.Table:
    shape, v = skeleton(border)
    v["extra"] = v["extra"] + add_up(shape, v["back"])
    source = shape.source((v["through"] == 0) | (v["link"] == 0))
    up = np.maximum(shape.up, 0)
    total, mass = sums_of(source, v["t_bottom"] - np.where(v["m_bottom"] > 0, v["extra"], 0), v["m_bottom"])
    hung = shape.up >= 0
    for whole, part in ((total, "t_top"), (mass, "m_top")):
        whole += sums_of(source[up], np.where(hung[:, None], v[part], 0))[0]
    bottom = np.take_along_axis(total / np.where(mass == 0, 1, mass), source, 0)
    return replaced(border, **{k: x[shape.place] for k, x in (("extra", v["extra"]), ("best_bottom", bottom), ("best_up", bottom[up]))})


def add_up(shape: Layout, sent: np.ndarray) -> np.ndarray:
    """What each piece gets from its children."""
    out, hung = np.zeros_like(sent), np.flatnonzero(shape.up >= 0)
    np.add.at(out, shape.up[hung], sent[hung])
    return out


def join_flows(border: pa.Table) -> pa.Table:
    shape, v = skeleton(border)
    value, _ = shape.rise(v["s"], v["low"], v["high"])
    return replaced(border, inflow=(value - v["s"])[shape.place])


def join_sides(border: pa.Table) -> pa.Table:
    shape, v = skeleton(border)
    side = np.take_along_axis(v["fixed"], shape.source(v["takes"] == 0), 0)
    above = np.where(shape.up[:, None] >= 0, side[np.maximum(shape.up, 0)], 0)
    return replaced(border, side_up=above[shape.place])


def solve_in_pieces(cells: DataFrame, lam: float, most: int) -> DataFrame:
    """cells(g, node_id, parent_id, edge_weight, node_weight, fb, x) -> g, node_id, parent_id, fb, x (the minimiser), fused."""
    kind = cells.schema["g"].dataType.simpleString()
    tree = cut(cells.select("g", "node_id", "parent_id").distinct())
    placed, pieces = cut_tree(tree, most)
    like = lambda value: F.transform("x", lambda _: F.lit(value).cast("double"))
    has = F.col("parent_id").isNotNull()
    state = cells.join(placed, ["g", "node_id"]).select("g", "piece", "fb", "node_id", "parent_id", (F.lit(lam) * F.col("edge_weight")).alias("bound"), "node_weight", "x", like(0.0).alias("pull"), F.transform("x", lambda _: has.cast("double")).alias("whole"))
    state = cut(state)
    flat = cells.select("g", "fb", F.posexplode("x").alias("i", "v"), "node_weight").groupBy("g", "fb", "i").agg((1e-13 * (1 + F.sum(F.abs(F.col("v") * F.col("node_weight"))))).alias("noise"), (1e-9 * (1 + F.max("v") - F.min("v"))).alias("near"))
    scale = flat.groupBy("g", "fb").agg(F.array_sort(F.collect_list(F.struct("i", "noise", "near"))).alias("z")).select("g", "fb", "z.noise", "z.near")
    border = pieces.join(scale, "g").select("g", "piece", "fb", "up_piece", "bottom", *("noise", "near"), *(F.transform("noise", lambda _: F.lit(0.0)).alias(c) for c in NUMBERS[2:]), F.lit(0).cast("bigint").alias("cuts"))
    about = f"g {kind}, piece string, fb int, up_piece string, bottom bigint, " + "".join(f"{c} array<double>, " for c in NUMBERS) + "cuts bigint"
    nodes = f"g {kind}, piece string, fb int, node_id bigint, parent_id bigint, bound double, node_weight double, x array<double>, pull array<double>, whole array<double>"
    names = [f.split()[0] for f in about.split(", ")]

    def in_pieces(run, border: DataFrame, out: str) -> DataFrame:
        return state.groupBy("g", "piece", "fb").cogroup(border.groupBy("g", "piece", "fb")).applyInArrow(lambda a, b: run(plain(a), plain(b)), out)

    def together(run, border: DataFrame) -> DataFrame:
        return border.groupBy("g", "fb").applyInArrow(lambda table: run(plain(table).select(names)), about)

    def first(state: pa.Table, border: pa.Table) -> pa.Table:
        return replaced(border.select(names), **{k: np.asarray(v, float)[None] for k, v in Piece(state, border).sums().items()})

    def flows(state: pa.Table, border: pa.Table) -> pa.Table:
        piece = Piece(state, border)
        piece.settle_best()
        return replaced(border.select(names), **{k: v[None] for k, v in piece.outflow().items()})

    def bottoms(state: pa.Table, border: pa.Table) -> pa.Table:
        piece = Piece(state, border)
        piece.settle_best()
        return replaced(border.select(names), **{k: v[None] for k, v in piece.bottom_side().items()})

    def divide(state: pa.Table, border: pa.Table) -> pa.Table:
        piece = Piece(state, border)
        piece.settle_best()
        back, cuts = piece.divide()
        told = replaced(border.select(names), back=back[None], **{k: np.asarray(v, float)[None] for k, v in piece.sums().items()})
        told = told.set_column(names.index("cuts"), "cuts", pa.array([int(cuts.sum())], pa.int64()))
        rows = piece.rows(pull=piece.pull, whole=piece.whole).append_column("told", pa.nulls(len(piece.wx), pa.struct(list(told.drop_columns(["g", "piece", "fb"]).schema))))
        one = pa.table({c: told.column(c) if c in told.column_names else pa.nulls(1, rows.schema.field(c).type) for c in rows.column_names if c != "told"})
        one = one.append_column("told", told.drop_columns(["g", "piece", "fb"]).to_struct_array())
        return pa.concat_tables([rows, one.cast(rows.schema)])

    def finish(state: pa.Table, border: pa.Table) -> pa.Table:
        piece = Piece(state, border)
        piece.settle_best()
        up = piece.shape.up
        above = np.where(up[:, None] >= 0, piece.best[up], piece.told["best_up"])
        has = piece.state.column("parent_id").is_valid().to_numpy()[piece.shape.nodes]
        fused = ((piece.whole | (np.abs(piece.best - above) <= piece.told["near"])) & has[:, None]).all(1)
        rows = piece.rows(x=piece.best).select(["g", "node_id", "parent_id", "fb", "x"])
        return rows.append_column("fused", pa.array(fused[piece.shape.place]))

    told = ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in about.split(", ")[3:])
    border, since = in_pieces(first, border, about), mark()
    while True:
        summed = cut(together(join_sums, border))
        flown = cut(in_pieces(flows, summed, about))
        sided = cut(in_pieces(bottoms, together(join_flows, flown), about))
        last = in_pieces(finish, summed, f"g {kind}, node_id bigint, parent_id bigint, fb int, x array<double>, fused boolean")
        divided = cut(in_pieces(divide, together(join_sides, sided), f"{nodes}, told struct<{told}>"))
        border = divided.where("told is not null").select("g", "piece", "fb", "told.*")
        if not border.agg(F.sum("cuts")).first()[0]:
            return last
        divided = forget(since, divided)
        state = divided.where("told is null").drop("told")
