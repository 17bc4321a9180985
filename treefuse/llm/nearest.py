"""Approximate nearest neighbours by score-aware product quantisation.

Vectors are cut into pairs of components; each pair is replaced by one of 16 codewords (four bits). The
codewords are fitted, and each vector is encoded, under a loss that weighs the part of the error along the
vector's direction from the sample's centre ``eta`` times as much as the part across it: errors along it are
what changes large inner products (Guo et al. 2020). A query's squared distances from all codewords make small
tables; a scan adds up one entry for each byte of a code. That is the distance from what a code stands for,
and less the squared length of the code's error it ranks a block's vectors; the best ``rerank`` are measured on
the original vectors.

A code alone can't tell vectors apart that are nearer to each other than its error: dense clusters, far
outliers, rows unlike the sample. So each code keeps the length of its error. By the triangle inequality no vector is
nearer than the scanned distance less that length; all whose bound is within the k-th distance measured so far
are measured as well, beside their codes. Nothing is missed, whatever the rows; where codes tell little, more is
measured.

Codebooks are fitted on at most ``sample`` vectors, the first by a hash of their ids; every vector is
encoded and scanned. Codes and vectors stay where they were written; blocks of queries come past them in rounds, each
round a broadcast of at most about ``broadcast_bytes``. Equal vectors are one row with its smallest ids, and
vectors of another length are another search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treefuse.llm.shared import cut

WORDS = 16
ANSWER = "query_id bigint, rank int, vec_id bigint, score double"


@dataclass
class Codebook:
    words: np.ndarray  # pairs x 16 x 2
    eta: float
    centre: np.ndarray

    @property
    def dims(self) -> int:
        return 2 * len(self.words)


def even(x: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of odd length get a zero at the end."""
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def encode_rows(book: Codebook, x: np.ndarray, sweeps: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
    """rows x pairs codes: nearest words first, then each pair in turn takes the word that makes the
    weighted loss smallest with the others held."""
    n, pairs = len(x), len(book.words)
    parts, unit = x.reshape(n, pairs, 2), directions(x - book.centre).reshape(n, pairs, 2)
    if codes is None:
        codes = np.stack([((parts[:, s, None] - book.words[s]) ** 2).sum(2).argmin(1) for s in range(pairs)], 1)
    left = parts - book.words[np.arange(pairs), codes]
    along = (left * unit).sum((1, 2))
    for _ in range(sweeps):
        for s in range(pairs):
            away = parts[:, s, None] - book.words[s]  # rows x 16 x 2
            mine = (away * unit[:, s, None]).sum(2)
            other = along - np.take_along_axis(mine, codes[:, s, None], 1)[:, 0]
            loss = (away**2).sum(2) + (book.eta - 1) * (other[:, None] + mine) ** 2
            codes[:, s] = loss.argmin(1)
            along = other + np.take_along_axis(mine, codes[:, s, None], 1)[:, 0]
    return codes


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 11) -> Codebook:
    """``threshold``: the cosine from which on inner products matter; it sets eta for the dimension."""
    n, dims = x.shape
    x = even(x, dims + dims % 2)
    dims = x.shape[1]
    pairs = dims // 2
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    book = Codebook(np.zeros((pairs, WORDS, 2)), eta, x.mean(0))
    parts, unit = x.reshape(n, pairs, 2), directions(x - book.centre).reshape(n, pairs, 2)
    for s in range(pairs):  # plain k-means to begin with
        words = parts[rng.choice(n, WORDS, replace=n < WORDS), s].copy()
        for _ in range(8):
            code = ((parts[:, s, None] - words) ** 2).sum(2).argmin(1)
            count = np.bincount(code, minlength=WORDS)
            for d in range(2):
                words[:, d] = np.where(count > 0, np.bincount(code, parts[:, s, d], WORDS) / np.maximum(count, 1), words[:, d])
        book.words[s] = words
    codes = None
    for _ in range(rounds):
        codes = encode_rows(book, x, 1, codes)
        along = ((parts - book.words[np.arange(pairs), codes]) * unit).sum((1, 2))
        for s in range(pairs):  # each word: the minimum of a 2 x 2 quadratic over its members
            code, e, u = codes[:, s], parts[:, s], unit[:, s]
            mine = ((e - book.words[s][code]) * u).sum(1)
            other = along - mine
            pull = e + (eta - 1) * u * (other + (e * u).sum(1))[:, None]
            total = lambda w, code=code: np.bincount(code, w, WORDS)
            a, b, d = (total(1.0 * (i == j) + (eta - 1) * u[:, i] * u[:, j]) for i, j in ((0, 0), (0, 1), (1, 1)))
            r0, r1 = total(pull[:, 0]), total(pull[:, 1])
            det = a * d - b * b
            ok = det > 1e-12
            safe = np.where(ok, det, 1)
            book.words[s] = np.where(ok[:, None], np.stack(((d * r0 - b * r1) / safe, (a * r1 - b * r0) / safe), 1), book.words[s])
            along = other + ((e - book.words[s][code]) * u).sum(1)
    return book


def errors(book: Codebook, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """How far each vector is from what its code stands for."""
    left = x.reshape(len(x), -1, 2) - book.words[np.arange(len(book.words)), codes]
    return np.sqrt((left**2).sum((1, 2)))


def byte_tables(book: Codebook, q: np.ndarray) -> np.ndarray:
    """queries x bytes x 256: squared distances of a query from what the two codes of a byte stand for."""
    q = even(q, book.dims).reshape(len(q), -1, 1, 2)
    each = ((q - book.words[None]) ** 2).sum(3)  # queries x pairs x 16
    if each.shape[1] % 2:
        each = np.pad(each, ((0, 0), (0, 1), (0, 0)))
    low, high = each[:, 0::2], each[:, 1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, 256)


def rough_distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of these rows from q, but for rounding."""
    away = rows - q
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of these rows from q, component after component, so that ties fall as in any other plain sum."""
    total = np.zeros(len(rows))
    for x, y in zip(rows.T, q, strict=True):
        total += (x - y) ** 2
    return np.sqrt(total)


def kth(rough: np.ndarray, k: int) -> float:
    """What the (k + 1)-th of these distances surely doesn't exceed."""
    return np.partition(rough, k)[k] * (1 + 1e-9) + 1e-150 if len(rough) > k else np.inf


def within(scanned: np.ndarray, error: np.ndarray, limit: float) -> np.ndarray:
    """Which rows can be as near as ``limit``, by their scanned squared distances: all but those that surely aren't."""
    return np.flatnonzero(~(scanned > (error + limit) ** 2 * (1 + 1e-9) + 1e-300))  # for rounding and underflow


def packed(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: not null, all components finite, not all zero; one row an id."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """vectors(id, vector) and a condition on ``id`` -> query_id, rank (from 1), vec_id, score.

    Each query's k nearest of all other vectors of its length by Euclidean distance, ties to the smaller id;
    fewer if there are fewer. None is missed. Vectors that are null, zero, or hold a null or a non-finite component take no
    part. Repeated ids count once, with their first vector in order. An empty table gives no rows. Other
    columns are ignored. ``options`` are those of ``search``.
    """
    rows = cut(usable(vectors, id_col, vec_col).withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}))
    found = [search(rows.where(F.size("v") == r["d"]), is_query, k, **options) for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], ANSWER)


def search(rows: DataFrame, is_query: Column, k: int, rerank: int = 200, sample: int = 20_000, query_block: int = 256, code_block: int = 16_384, code_bytes: int = 2 << 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """rows(id, v, h1, h2: hashes of v), all of one length. ``code_bytes``: of a block's vectors, one at least."""
    rerank = max(rerank, k + 1)
    # Equal vectors: one row with the k + 1 smallest ids, which is all that any query can return of them.
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = cut(ranked.groupBy("h1", "h2", "v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")))
    taken = distinct.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").collect()
    book = fit(np.array([r["v"] for r in taken]))
    queries = rows.where(is_query).join(distinct.select("h1", "h2", "v", "rep"), ["h1", "h2", "v"]).select(F.col("id").alias("query_id"), "rep")
    asked = cut(distinct.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v"))
    n_asked = asked.count()
    if not n_asked:
        return rows.sparkSession.createDataFrame([], ANSWER)

    def blocks(size: int, encoded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = 0
            for batch in batches:
                for a in range(0, batch.num_rows, size):
                    part = batch.slice(a, size)
                    x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                    codes, error, body = b"", b"", x
                    if encoded:
                        full = even(x, book.dims)
                        found = encode_rows(book, full)
                        codes, error, body = packed(found).T.tobytes(), errors(book, full, found).tobytes(), x
                    name = (TaskContext.get().partitionId() << 32) + made
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([v], pa.binary()) for v in (part.column("rep").to_numpy().tobytes(), codes, error, body.tobytes()))], names=["block", "ids", "codes", "errors", "body"])

        return run

    kind = "block bigint, ids binary, codes binary, errors binary, body binary"
    code_block = max(1, min(code_block, code_bytes // (8 * book.dims)))
    codes = cut(distinct.select("rep", "v").mapInArrow(blocks(code_block, True), kind))
    dealt = asked.repartition(-(-n_asked // query_block), "rep")
    asked_blocks = cut(dealt.mapInArrow(blocks(query_block, False), kind)).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("body").alias("q_body"))
    rounds = -(-asked_blocks.agg(F.sum(F.octet_length("q_ids") + F.octet_length("q_body"))).first()[0] // broadcast_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits: dict[int, np.ndarray] = {}  # of each query block: what a query's (k + 1)-th distance can't exceed
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            q_ids = np.frombuffer(row["q_ids"], np.int64)
            q = np.frombuffer(row["q_body"], np.float64).reshape(len(q_ids), -1)
            limit = limits.setdefault(row["q_block"], np.full(len(q_ids), np.inf))
            ids, error = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["errors"])
            body, x = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(ids)), np.frombuffer(row["body"]).reshape(len(ids), -1)
            gain = error**2
            out = ([], [], [])
            for i in range(len(q)):
                table = byte_tables(book, q[i : i + 1])[0]
                scanned = table[0].take(body[0])
                for t, code in zip(table[1:], body[1:], strict=True):
                    scanned += t.take(code)
                some = within(scanned, error, limit[i])
                if len(some) > rerank:
                    first = some[np.argpartition((scanned - gain)[some], rerank - 1)[:rerank]]
                    limit[i] = min(limit[i], kth(rough_distances(x[first], q[i]), k))
                    some = some[within(scanned[some], error[some], limit[i])]
                rough = rough_distances(x[some], q[i])
                limit[i] = min(limit[i], kth(rough, k))
                some = some[~(rough > limit[i])]
                score = distances(x[some], q[i])
                best = np.lexsort((ids[some], score))[: k + 1]
                for o, v in zip(out, (np.full(len(best), q_ids[i]), ids[some[best]], score[best]), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["q", "rep", "score"])

    def near(part: DataFrame) -> DataFrame:
        """q, score, vec_id of a round's queries: all codes are scanned, so what a query finds is final."""
        exact = codes.crossJoin(F.broadcast(part)).mapInArrow(scan, "q bigint, rep bigint, score double")
        exact = exact.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "rep"))).where(F.col("r") <= k + 1)
        each = exact.join(distinct.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
        return each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")

    each = near(asked_blocks) if rounds == 1 else reduce(DataFrame.unionByName, [cut(near(asked_blocks.where(F.pmod(F.xxhash64("q_block"), F.lit(rounds)) == i))) for i in range(rounds)])
    # A query is itself among its vector's ids only if it is one of the smallest; either way k others are left.
    answers = queries.join(each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near")), F.col("rep") == F.col("q"))
    answers = answers.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


SQL = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda x, y: x + y)) AS score
  FROM e q JOIN e c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d) WHERE rank <= 10
"""
