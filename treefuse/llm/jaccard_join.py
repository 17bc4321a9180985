"""Exact Jaccard self-join of word n-gram sets, by set relations.

Texts with equal sets are one class and go on as one row. Where two sets of sizes m <= n are similar enough, they
differ in at most ``allowed(m)`` shingles. The hash range is cut into one part more than that, so at least one part
holds the same shingles in both, and a key of (size band, part, what it holds) brings them together: no pair that
links is missed, and a passage that many texts share brings none together, since a part's other shingles differ. Texts with an empty
part add the keys of another cut, and of a third, where empty parts have keys as well.

A sketch of as many bits as a set has shingles, each the parity of the shingles that hash to it, differs in no more
bits than the sets do in shingles; this rules out most pairs without their sets and loses none. Two rounds link each class to
the class of another component that it shares most keys with. Keys that still hold several components are then
compared in full, in cells: first by sketches, and what has a partner left goes on with its set. A key's largest component
needs no comparison with itself, so its blocks only meet the blocks of the others.

In a cell each set is looked up in the index lists of its rarest shingles. A list's entries are blocks by the
shingle's position in the set; a block is skipped by position and sizes alone, or where all it holds is already
known to be in the set's component: what a linked set has been joined to needs no second answer. Overlaps of what is left
follow from a similar set's: sets near an anchor are kept as their differences from it, and two of them overlap in
what the anchor has less both differences, plus the differences they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from treefuse.llm.components import components
from treefuse.llm.near_dedup import full_sets, shingle_hashes
from treefuse.llm.textarrays import mix, parts, release
from treefuse.shared import cut

CUTS = 3  # how many times a set with an empty part is cut anew
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def size_bands(percent: int, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    """Where size bands start, and into how many parts sets are cut whose smaller one is of the band: a set's
    larger partners are of its own or the next band."""
    starts = [1]
    while starts[-1] < most:
        starts.append(100 * starts[-1] // percent + 1)
    largest = np.array(starts[1:]) - 1
    return np.array(starts[:-1]), (largest + 100 * largest // percent) * (100 - percent) // (100 + percent) + 1


def part_keys(sets: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' keys, and where each row's begin. Sets that are cut into one part only meet their equals and get none."""
    starts, cut_into = size_bands(percent)
    n = np.diff(begin)
    own = np.searchsorted(starts, n, "right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for back in (0, 1):
        band = own - back
        # Of the band before, only if a partner can be so small.
        go = (n > 0) & (band >= 0) & ((back == 0) | (-(-percent * n // 100) < starts[own]))
        go[go] &= cut_into[band[go]] > 1
        row = np.flatnonzero(go)
        token = sets[np.repeat(go, n)]
        for time in range(CUTS):
            if not len(row):
                break
            size, k = n[row], cut_into[band[row]].astype(np.int64)
            at, base = np.repeat(np.arange(len(row)), size), np.concatenate(([0], np.cumsum(k)))
            if time:
                token = mix(token + _C)
                token = token[np.lexsort((token, at))]
            part = base[at] + ((token >> np.uint64(32)) * k[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            held = np.zeros(int(base[-1]), np.uint64)
            held[part[first]] = np.add.reduceat(mix(token ^ _A), first)
            full = np.zeros(len(held), bool)
            full[part[first]] = True
            of = np.repeat(np.arange(len(row)), k)
            empty = np.add.reduceat(~full, base[:-1]) > 0
            emit = full | (time == CUTS - 1)
            place = (np.arange(len(held)) - base[of]).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = mix(held + mix(place * _B + band[row][of].astype(np.uint64) * _C + np.uint64(time)))
            out.append((row[of[emit]], key[emit]))
            token, row = token[np.repeat(empty, size)], row[empty]
    rows = np.concatenate([r for r, _ in out]) if out else np.zeros(0, np.int64)
    keys = np.concatenate([k for _, k in out]) if out else np.zeros(0, np.uint64)
    order = np.argsort(rows, kind="stable")
    return keys[order], np.searchsorted(rows[order], np.arange(len(n) + 1))


def sketches(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each row's set as 64-bit words, and where each row's begin: a power of two of bits, as many as
    shingles or more, 64 at least. The halves of a longer sketch, one XOR the other, are the shorter one."""
    n = np.diff(begin)
    bits = np.where(n > 0, np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)), 0)
    base = np.concatenate(([0], np.cumsum(bits)))
    at = np.repeat(base[:-1], n) + (mix(sets ^ _C) & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").view(np.int64), base // 64


def keyed_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, d1, d2 (two digests of the set), keys and sketch (arrays of bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in parts(batches, "__text", 1 << 18):
            sets, begin = shingle_hashes(data, at, k)
            keys, where = part_keys(sets, begin, percent)
            total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (mix(sets), mix(sets ^ _B))]
            d1, d2 = (pa.array((t[begin[1:]] - t[begin[:-1]]).view(np.int64)) for t in total)
            lists = [pa.ListArray.from_arrays(pa.array(w, pa.int32()), pa.array(v.view(np.int64))) for v, w in ((keys, where), sketches(sets, begin))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(begin), pa.int64()), d1, d2, *lists], names=["doc_id", "n", "d1", "d2", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(run, f"doc_id {kind}, n bigint, d1 bigint, d2 bigint, keys array<bigint>, sketch array<bigint>")


class Cell:
    """Sets of one cell in order of size: what joins different labels. Two sides are only compared with each other."""

    def __init__(self, side: np.ndarray, label: np.ndarray, begin: np.ndarray, tokens: np.ndarray, percent: int):
        self.percent, self.n, self.begin = percent, np.diff(begin), begin
        self.side, self.two = side, len(np.unique(side)) > 1
        _, self.label = np.unique(label, return_inverse=True)
        self.root = np.arange(int(self.label.max(initial=-1)) + 1)
        n, owner = self.n, np.repeat(np.arange(len(self.n)), self.n)
        _, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        token = rank[token]
        self.token = token[np.lexsort((token, owner))]
        place = np.arange(len(token)) - begin[owner]
        rare = place < (n - (percent * n + 99) // 100 + 1)[owner]
        self.of, by, place = self.token[rare], owner[rare], place[rare]
        self.first = np.searchsorted(by, np.arange(len(n) + 1))
        order = np.lexsort((by, place, self.of))
        of, self.posted, place = self.of[order], by[order], place[order]
        head = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (place[1:] != place[:-1])))) if len(of) else np.zeros(0, np.int64)
        self.head, self.place = np.append(head, len(of)), place[head]
        self.lists = np.searchsorted(of[head], np.arange(len(times) + 1))
        # Rows are in order of size, so a block's first and last entry are its smallest and largest set.
        self.least, self.most = n[self.posted[head]], n[self.posted[self.head[1:] - 1]]
        low, high = (f.reduceat(self.label[self.posted], head) if len(head) else head for f in (np.minimum, np.maximum))
        self.alone = np.where(low == high, low, -1)  # the one label in a block
        self.anchor, self.delta, self.missing = np.arange(len(n)), [np.zeros(0, np.int64)] * len(n), np.zeros(len(n), np.int64)
        self.marked, self.differs, self.shown = np.zeros(len(times), bool), np.zeros(len(times), bool), -1

    def set_of(self, row: int) -> np.ndarray:
        return self.token[self.begin[row] : self.begin[row + 1]]

    def needed(self, m, n):
        """How many shingles sets of these sizes must share."""
        return -(-self.percent * (m + n) // (100 + self.percent))

    def met(self, x: int) -> np.ndarray:
        """The entries in the lists of x's rarest shingles, whole blocks skipped."""
        mine = self.of[self.first[x] : self.first[x + 1]]
        count = self.lists[mine + 1] - self.lists[mine]
        b = np.repeat(self.lists[mine + 1] - np.cumsum(count), count) + np.arange(int(count.sum()))
        i, j, n = np.repeat(np.arange(len(mine)), count), self.place[b], self.n[x]
        reach = np.minimum(i, j) + np.minimum(n - i, self.most[b] - j)
        go = (reach >= self.needed(n, self.least[b])) & (self.posted[self.head[b]] < x) & (100 * n >= self.percent * self.least[b]) & (100 * self.most[b] >= self.percent * n)
        go &= (self.alone[b] < 0) | (self.root[self.alone[b]] != self.root[self.label[x]])
        b = b[go]
        count = self.head[b + 1] - self.head[b]
        return self.posted[np.repeat(self.head[b + 1] - np.cumsum(count), count) + np.arange(int(count.sum()))]

    def show(self, row: int) -> None:
        if self.shown != row:
            if self.shown >= 0:
                self.marked[self.set_of(self.shown)] = False
            self.marked[self.set_of(row)] = True
            self.shown = row

    def lean(self, x: int, on: int) -> None:
        """Keeps x as its differences from the anchor, if they are few."""
        mine = self.set_of(x)
        self.show(on)
        there = self.marked[mine]
        common = int(there.sum())
        if 4 * (len(mine) + self.n[on] - 2 * common) <= len(mine):
            self.differs[mine] = True
            theirs = self.set_of(on)
            gone = theirs[~self.differs[theirs]]
            self.differs[mine] = False
            self.anchor[x], self.missing[x], self.delta[x] = on, len(gone), np.concatenate((gone, mine[~there]))

    def overlaps(self, x: int, y: np.ndarray) -> np.ndarray:
        """How many shingles x shares with each of y."""
        near = self.anchor[y] == self.anchor[x]
        out = np.zeros(len(y), np.int64)
        if near.any():
            z, on = y[near], self.anchor[x]
            lens = np.array([len(self.delta[r]) for r in z])
            self.differs[self.delta[x]] = True
            shared = np.concatenate(([0], np.cumsum(self.differs[np.concatenate([self.delta[r] for r in z])])))
            self.differs[self.delta[x]] = False
            ends = np.cumsum(lens)
            out[near] = self.n[on] - self.missing[x] - self.missing[z] + shared[ends] - shared[ends - lens]
        if not near.all():
            z = y[~near]
            lens = self.n[z]
            ends = np.cumsum(lens)
            at = np.arange(int(ends[-1])) + np.repeat(self.begin[z] - ends + lens, lens)
            self.differs[self.set_of(x)] = True
            out[~near] = np.add.reduceat(self.differs[self.token[at]].astype(np.int64), ends - lens)
            self.differs[self.set_of(x)] = False
        return out

    def links(self) -> list[tuple[int, int]]:
        out = []
        for x in range(1, len(self.n)):
            y = self.met(x)
            y = y[y < x]
            if not len(y):
                continue
            y, times = np.unique(y, return_counts=True)
            on = int(self.anchor[y[times.argmax()]])
            self.lean(x, on)
            y = y[(self.root[self.label[y]] != self.root[self.label[x]]) & (100 * self.n[y] >= self.percent * self.n[x])]
            y = y[self.side[y] != self.side[x]] if self.two else y
            if not len(y):
                continue
            for z in y[self.overlaps(x, y) >= self.needed(self.n[x], self.n[y])].tolist():
                a, b = self.root[self.label[z]], self.root[self.label[x]]
                if a != b:  # else x has z's component already
                    out.append((z, x))
                    self.root[self.root == a] = b
        return out


def closest(now: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """now(key, rep, n, component), sketch(rep, sketch) -> a, b: for each class, that of another component it shares
    most keys with, out of each key's first and last, unless sizes or sketches rule it out."""
    who = F.struct("component", "rep", "n")
    ends = now.groupBy("key").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low.component != high.component")
    other = F.when(F.col("component") != F.col("low.component"), F.col("low")).otherwise(F.col("high"))
    met = now.join(ends, "key").select("rep", "n", other.alias("o")).groupBy("rep", "o.rep").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("o.n").alias("m"))
    met = met.toDF("a", "b", "c", "na", "nb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    best = met.groupBy("a").agg(F.max(F.struct("c", (-F.xxhash64("b")).alias("h"), "b", "na", "nb")).alias("x")).select("a", "x.b", "x.na", "x.nb")
    both = best.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    size = F.least(F.size("sa"), F.size("sb"))
    fold = lambda s: F.when(F.size(s) > size, F.zip_with(F.slice(s, F.lit(1), size), F.slice(s, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(s))
    apart = F.aggregate(F.zip_with(fold("sa"), fold("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def hub_cells(pairs: DataFrame, now: DataFrame, block: int) -> DataFrame:
    """a, b -> rep, cell: each b and the a that chose it, as many to a cell as a block holds, b in each cell."""
    sized = pairs.join(now.groupBy("rep").agg(F.first("n").alias("n")), F.col("a") == F.col("rep"))
    salts = sized.groupBy("b").agg(F.ceil(F.sum("n") / block).alias("salts"))
    sized = cut(pairs.join(salts, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("salts"))).alias("cell")))
    return sized.select(F.col("a").alias("rep"), "cell").unionByName(sized.select(F.col("b").alias("rep"), "cell")).distinct()


def mixed_cells(now: DataFrame, block: int, least: int = 500) -> DataFrame:
    """now(key, rep, n, component) -> rep, n, component, s, cell: each key's classes in cells of two blocks, without
    those where all are of one component. A class counts as ``least`` shingles at least."""
    weight = F.greatest("n", F.lit(least))
    one = [F.sum(weight).alias("t"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("rep")).alias("d1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("d2")]
    groups = now.groupBy("key", "component").agg(*one).groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("t", "component")).alias("main"), F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    # Keys of the same classes are compared once.
    mixed = groups.where("k > 1").groupBy("d1", "d2", "c", "t").agg(F.min(F.struct("key", "main")).alias("x"))
    whole, parts_of = F.col("t") <= block, lambda size: F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    mixed = cut(mixed.select("x.key", F.col("x.main.component").alias("main"), F.when(whole, 0).otherwise(parts_of(F.col("x.main.t"))).alias("mains"), F.when(whole, 1).otherwise(parts_of(F.col("t") - F.col("x.main.t"))).alias("others")))
    rows = now.join(mixed, "key").withColumn("is_main", (F.col("component") == F.col("main")) & (F.col("mains") > 0))
    other = F.col("mains") + F.pmod(F.xxhash64("rep"), F.col("others")).cast("int")
    rows = rows.withColumn("s", F.when(F.col("is_main"), F.pmod(F.xxhash64("rep"), F.col("mains")).cast("int")).otherwise(other))
    meets = F.when(F.col("is_main"), F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1))
    rows = rows.withColumn("o", F.explode(meets))
    return rows.select("rep", "n", "component", "s", F.xxhash64("key", F.least("s", "o"), F.greatest("s", "o")).alias("cell"))


def runs_of(cell: np.ndarray) -> list[tuple[int, int]]:
    bounds = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def by_bin(rows: DataFrame, bins: int) -> GroupedData:
    return rows.withColumn("bin", F.pmod("cell", F.lit(bins))).groupBy("bin")


def possible(n: np.ndarray, label: np.ndarray, side: np.ndarray, words: np.ndarray, begin: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a cell have another of a different label (and side, if there are two) that sizes and sketches
    leave possible."""
    size = int(np.diff(begin).min())
    rows = np.zeros((len(n), size), np.int64)
    for length in np.unique(np.diff(begin)).tolist():  # longer sketches are folded
        at = np.flatnonzero(np.diff(begin) == length)
        w = words[begin[at][:, None] + np.arange(length)]
        rows[at] = np.bitwise_xor.reduce(w.reshape(len(at), -1, size), axis=1)
    out, two = np.zeros(len(n), bool), len(np.unique(side)) > 1
    for x in range(1, len(n)):
        y = np.flatnonzero((label[:x] != label[x]) & (100 * n[:x] >= percent * n[x]) & (side[:x] != side[x] if two else True))
        if len(y):
            apart = np.bitwise_count((rows[y] ^ rows[x]).view(np.uint64)).sum(1, dtype=np.int64)
            y = y[(100 + percent) * apart <= (100 - percent) * (n[y] + n[x])]
            out[y] = True
            out[x] |= len(y) > 0
    return out


def sketch_cells(cells: DataFrame, sketch: DataFrame, percent: int, block: int) -> DataFrame:
    """The rows of mixed cells that sketches leave a partner of another component."""
    bins = max(1, -(-(cells.agg(F.sum(F.col("n") + 500)).first()[0] or 0) // (8 * block)))
    kind = cells.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("n", "ascending"), ("rep", "ascending")]).combine_chunks()
        label = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        cell, side, n = (table.column(c).to_numpy() for c in ("cell", "s", "n"))
        lists = table.column("sketch").combine_chunks()
        begin, words = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        keep = np.concatenate([possible(n[a:b], label[a:b], side[a:b], words, begin[a : b + 1], percent) for a, b in runs_of(cell)])
        out = table.select(["rep", "n", "component", "s", "cell"]).filter(pa.array(keep))
        release()
        return out

    return by_bin(cells.join(sketch, "rep"), bins).applyInArrow(run, f"rep {kind}, n bigint, component {kind}, s int, cell bigint")


def cell_links(docs: DataFrame, rows: DataFrame, k: int, percent: int, block: int, broadcast_rows: int) -> DataFrame:
    """docs(doc_id, text), rows(rep, n, component, s, cell) -> a, b: links between components, enough to join all that
    any pair of a cell joins. Sets are taken from the texts and move once, to their cells."""
    bins = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // block))
    kind = rows.schema["rep"].dataType.simpleString()
    wanted = rows.groupBy("rep").agg(F.collect_list(F.struct("cell", "component", "s")).alias("cells"))  # as many as the class has keys
    wanted = F.broadcast(wanted) if rows.count() <= broadcast_rows else wanted
    sets = full_sets(docs.join(wanted, F.col("doc_id") == F.col("rep")).drop("rep"), k, "cells")
    placed = sets.select(F.col("doc_id").alias("rep"), "shingles", F.explode("cells").alias("c")).select("rep", F.size("shingles").alias("n"), "shingles", "c.cell", "c.component", "c.s")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("n", "ascending"), ("rep", "ascending")]).combine_chunks()
        label = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        cell, side = table.column("cell").to_numpy(), table.column("s").to_numpy()
        lists = table.column("shingles").combine_chunks()
        begin, tokens = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        found: list[tuple[int, int]] = []
        for a, b in runs_of(cell):
            at = begin[a : b + 1]
            found += [(a + x, a + y) for x, y in Cell(side[a:b], label[a:b], at - at[0], tokens[at[0] : at[-1]], percent).links()]
        reps = table.column("rep").combine_chunks()
        links = pa.table({c: reps.take(pa.array([f[j] for f in found], pa.int64())) for j, c in enumerate("ab")})
        release()
        return links

    return by_bin(placed, bins).applyInArrow(run, f"a {kind}, b {kind}").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2, block: int = 2_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id.

    Documents link if 100 * |intersection| >= percent * |union| of their distinct k-word shingles (A-Z lower-cased,
    words between ASCII white space; with fewer words the whole sequence is one); component_id is the smallest doc_id
    reachable. Every link counts, whatever the size of a group. Null, empty and blank texts have no shingles and stay
    alone. Repeated rows of one doc_id count once, with the first of their texts in order; rows without doc_id are
    left out; an empty table gives no rows; other columns are ignored. Sets are compared as 64-bit hashes.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = cut(docs.groupBy("doc_id").agg(F.min("text").alias("text")))
    found = cut(keyed_sets(docs, k, percent))
    named = cut(found.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    keys = found.join(named.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high").select("key"))
    now = hits = cut(keys.join(shared, "key").withColumn("component", F.col("rep")))
    sketch = found.select(F.col("doc_id").alias("rep"), "sketch")
    edges = None

    def labelled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        label = cut(components(edges))
        return label, hits.drop("component").join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))

    def join_all(edges: DataFrame | None, rows: DataFrame) -> DataFrame:
        more = cut(cell_links(docs, cut(rows), k, percent, block, broadcast_rows))
        return more if edges is None else edges.unionByName(more)

    for _ in range(rounds):
        cells = hub_cells(cut(closest(now, sketch, percent)), now, block)
        known = now.groupBy("rep").agg(F.first("n").alias("n"), F.first("component").alias("component"))
        edges = join_all(edges, cells.join(known, "rep").withColumn("s", F.lit(0)))
        label, now = labelled(edges)
    left = sketch_cells(cut(mixed_cells(now, block)), sketch, percent, block)
    label, _ = labelled(join_all(edges, left))
    named = named.join(label, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


# All pairs that share a shingle: right, but quadratic in how many documents share one.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, s.b FROM reach r JOIN side s ON s.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
