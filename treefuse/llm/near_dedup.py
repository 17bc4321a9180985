"""Near-duplicates by an LSH forest over MinHash signatures.

A text is the set of its distinct word shingles. Texts with equal sets are one class and go on as one row.
Each of ``TREES`` trees sorts the classes by its own ``DEPTH`` minima; classes with a common prefix of
``BASE`` minima are a region, and any two classes of one region are candidates.

Candidates are confirmed on the full sets in two rounds. The first takes neighbours in a tree's order and the
region's smallest class, and of each class only its most frequent partner; these links make components. Where
more than ``crowd`` classes share a region, its neighbours are taken within branches of full depth, and what
still shares everything is spread over salts, other ones in each tree, so no task sorts more than a crowd. This
only moves links from the first round to the second, which takes the regions that still hold more than one
component, whatever their size, and compares all pairs of classes from different components; a region with
more than ``block`` shingles is cut into blocks, and each pair of blocks is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treefuse.llm.components import components
from treefuse.llm.shared import cut
from treefuse.llm.textarrays import LOWER, NOT_SPACE, gram_hashes, parts, release, word_hashes, words

TREES, DEPTH, BASE = 16, 6, 3
_ODD = np.random.default_rng(5).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct k-word shingles, sorted within a row, and where rows begin (one more than rows).
    A row of fewer words has its whole sequence as its one shingle; a row without words has none."""
    data = LOWER[data]
    starts, ends, first = words(data, at, NOT_SPACE)
    h = word_hashes(data, starts, ends)
    counts = np.diff(first)
    by_size = {m: gram_hashes(h, m) for m in {*range(1, k + 1)}}
    sets = []
    for a, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        m = min(n, k)
        sets.append(np.unique(by_size[m][a : a + n - m + 1]) if n else by_size[k][:0])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def minima(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """rows x (TREES * DEPTH): upper halves of the smallest permuted values, big-endian; zeros for empty sets."""
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, len(_ODD)), ">u4")
    if len(full):
        for j, a in enumerate(_ODD):
            out[full, j] = np.minimum.reduceat(sets * a, begin[full]) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, d1, d2 (two digests of the set), sig (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in parts(batches, "__text", 1 << 18):
            sets, begin = shingle_hashes(data, at, k)
            n, sig = np.diff(begin), minima(sets, begin)
            total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (sets, (sets ^ (sets >> np.uint64(31))) * _ODD[0])]
            d1, d2 = (pa.array((t[begin[1:]] - t[begin[:-1]]).view(np.int64)) for t in total)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), d1, d2, pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "n", "d1", "d2", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(run, f"doc_id {kind}, n bigint, d1 bigint, d2 bigint, sig binary")


def full_sets(docs: DataFrame, k: int, *keep: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the kept columns, shingles (array of bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in parts(batches, "__text", 1 << 18):
            sets, begin = shingle_hashes(data, at, k)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", *keep)), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(sets.view(np.int64)))], names=["doc_id", *keep, "shingles"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return docs.select("doc_id", *keep, F.col("text").alias("__text")).mapInArrow(run, f"{fields}, shingles array<bigint>")


def prefix(depth: int) -> Column:
    return F.substring("branch", 1, 4 * depth)


def candidates(classes: DataFrame, crowd: int) -> DataFrame:
    """classes(rep, n, sig) -> a < b, na, nb, trees: pairs of neighbours, their sizes, and in how many trees
    they are neighbours."""
    classes = classes.withColumn("rep", F.struct("rep", "n"))
    branches = F.array(*(F.struct(F.lit(t).alias("t"), F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("branch")) for t in range(TREES)))
    rows = classes.select("rep", F.explode(branches).alias("b")).select("rep", "b.t", "b.branch")
    crowded = cut(rows.groupBy("t", prefix(BASE).alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("leader")).where(F.col("c") > crowd).withColumn("deep", F.lit(True)).drop("c"))
    rows = rows.withColumn("p", prefix(BASE))
    n_crowded = crowded.count()
    if n_crowded:  # else no row has to be looked up, and none moves for it
        rows = rows.join(F.broadcast(crowded) if n_crowded <= 1_000_000 else crowded, ["t", "p"], "left")
        rows = rows.withColumn("region", F.when(F.col("deep"), F.col("branch")).otherwise(F.col("p")))
        same = rows.where("deep").groupBy("t", "region").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd)
        rows = rows.join(same, ["t", "region"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("t", "rep.rep"), F.ceil(F.col("c") / crowd)), F.lit(0)))
    else:
        rows = rows.withColumns({"region": F.col("p"), "salt": F.lit(0), "leader": F.lit(None).cast(rows.schema["rep"].dataType)})
    order = Window.partitionBy("t", "region", "salt").orderBy("branch", "rep")
    partners = [F.lead("rep").over(order), F.first("rep").over(order), F.col("leader")]
    met = rows.select("rep", F.array(*partners).alias("with"))
    other = F.filter(F.array_distinct(F.array_compact("with")), lambda x: x["rep"] != F.col("rep.rep"))
    pairs = met.select("rep", other.alias("with")).where(F.size("with") > 0).select("rep", F.explode("with").alias("other")).select(F.least("rep", "other").alias("x"), F.greatest("rep", "other").alias("y"))
    return pairs.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.max("x.n").alias("na"), F.max("y.n").alias("nb"), F.count(F.lit(1)).alias("trees"))


def joining_links(side: np.ndarray, label: np.ndarray, begin: np.ndarray, tokens: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows (on different sides if there are two) whose sets are similar enough and that join
    different labels; all such pairs are compared, but of several that join the same labels one is named.

    Similar sets share a token among the rarest of each, in as many as may be missing from the other and one
    more, so only rows that do are counted in full."""
    n, rows = np.diff(begin), len(label)
    owner = np.repeat(np.arange(rows), n)
    _, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    rare = np.arange(len(token)) - begin[owner] < (n - (percent * n + 99) // 100 + 1)[owner]
    of, by = token[rare], owner[rare]
    order = np.argsort(of, kind="stable")
    posted, start = by[order], np.searchsorted(of[order], np.arange(len(times) + 1))
    first = np.searchsorted(by, np.arange(rows + 1))
    label, two, marked, out = label.copy(), len(np.unique(side)) > 1, np.zeros(len(times), bool), []
    for x in range(1, rows):
        mine = of[first[x] : first[x + 1]]
        mine = mine[start[mine + 1] - start[mine] > 1]
        if not len(mine):
            continue
        y = np.unique(np.concatenate([posted[start[m] : start[m + 1]] for m in mine]))
        y = y[(y < x) & (label[y] != label[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        y = y[side[y] != side[x]] if two else y
        if not len(y):
            continue
        ends = np.cumsum(n[y])
        at = np.arange(ends[-1]) + np.repeat(begin[y] - ends + n[y], n[y])
        own = token[begin[x] : begin[x + 1]]
        marked[own] = True
        common = np.add.reduceat(marked[token[at]].astype(np.int64), ends - n[y])
        marked[own] = False
        for z in y[100 * common >= percent * (n[x] + n[y] - common)].tolist():
            if label[z] != label[x]:
                out.append((z, x))
                label[label == label[z]] = label[x]
    return out


def region_links(classes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """classes(rep, n, component, sig), sets(rep, shingles) -> a, b: links between different components of a
    region, enough of them to join all that any of its pairs joins."""
    regions = F.array(*(F.struct(F.lit(t).alias("t"), F.substring("sig", 4 * DEPTH * t + 1, 4 * BASE).alias("p")) for t in range(TREES)))
    rows = classes.select("rep", "n", "component", F.explode(regions).alias("r")).select("rep", "n", "component", "r.t", "r.p")
    digests = [F.bit_xor(F.xxhash64("rep")).alias("d1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("d2"), F.count(F.lit(1)).alias("c")]
    mixed = rows.groupBy("t", "p").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("total"), *digests).where("low != high")
    # Regions of several trees with the same classes in them are compared once.
    mixed = mixed.groupBy("d1", "d2", "c", "total").agg(F.min(F.struct("t", "p")).alias("r"))
    mixed = cut(mixed.select("r.t", "r.p", F.ceil(F.col("total") / block).cast("int").alias("blocks")))
    n_mixed = mixed.count()
    rows = rows.join(F.broadcast(mixed) if n_mixed <= 1_000_000 else mixed, ["t", "p"])
    # A region's blocks meet in pairs: a row of block s goes to s's pair with each block, itself included.
    rows = rows.withColumn("s", F.pmod(F.xxhash64("t", "rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = cut(rows.select("rep", "n", "component", "s", F.xxhash64("t", "p", F.least("s", "o"), F.greatest("s", "o")).alias("cell")))
    bins = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // block))
    kind = classes.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("rep", "ascending")]).combine_chunks()
        label = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        cell, side = table.column("cell").to_numpy(), table.column("s").to_numpy()
        lists = table.column("shingles").combine_chunks()
        begin, tokens = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        found: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = begin[a : b + 1]
            found += [(a + x, a + y) for x, y in joining_links(side[a:b], label[a:b], at - at[0], tokens[at[0] : at[-1]], percent)]
        reps = table.column("rep").combine_chunks()
        pick = lambda j: reps.take(pa.array([f[j] for f in found], pa.int64()))
        links = pa.table({"a": pick(0), "b": pick(1)})
        del table, cell, side, label, lists, begin, tokens
        release()
        return links

    met = rows.join(sets, "rep").withColumn("bin", F.pmod("cell", F.lit(bins)))
    return met.groupBy("bin").applyInArrow(run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, crowd: int = 20_000, block: int = 4_000_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * |intersection| >= percent * |union| of their k-word shingle sets (A-Z
    lower-cased, words between ASCII white space); a component is what links join, named by its smallest
    doc_id. Null, empty and blank texts have no shingles and stay alone. Repeated rows of one doc_id count
    once, with the first of its texts in order; rows without doc_id are left out. Other columns are ignored.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = cut(docs.groupBy("doc_id").agg(F.min("text").alias("text")))
    found = cut(signatures(docs, k))
    classes = cut(found.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    # Whoever shares a region has a neighbour in it or meets its smallest class, so these are all whose full
    # sets can be asked for.
    pairs = cut(candidates(classes, crowd))
    some = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    some = F.broadcast(some) if some.count() <= broadcast_rows else some
    sets = cut(full_sets(docs.join(some, "doc_id", "left_semi"), k))
    # Sets of very different sizes can't be similar.
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")

    def confirmed(which: DataFrame) -> DataFrame:
        both = which.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    best = pairs.where(alike).groupBy("b").agg(F.max(F.struct("trees", (-F.col("a")).alias("minus"), "na", "nb")).alias("x"))
    edges = cut(confirmed(best.select((-F.col("x.minus")).alias("a"), "b", "x.na", "x.nb")))
    label = cut(components(edges))
    now = classes.join(some, F.col("rep") == F.col("doc_id"), "left_semi").join(label, F.col("rep") == F.col("node"), "left").select("rep", "n", "sig", F.coalesce("component", "rep").alias("component"))
    more = cut(region_links(now, sets.toDF("rep", "shingles"), percent, block))
    if not more.isEmpty():
        label = components(edges.unionByName(more))
    # Every document takes its class's component.
    named = classes.select("n", "d1", "d2", "rep").join(label, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


# All pairs that share a shingle: right, but quadratic in how many documents share one.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, s.b FROM reach r JOIN side s ON s.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
