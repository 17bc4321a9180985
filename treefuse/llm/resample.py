"""Importance resampling towards a target distribution.

Features are runs of one to ``longest`` words, hashed into ``buckets``. A bucket's gain says how much more
frequent it is in the target than in the documents; a document's weight is the sum over its features, and its
score adds Gumbel noise of its own id, so that taking the highest scores draws by weight without replacement.

Both passes over the texts run in tasks on arrays: CRCs of words by byte position, CRCs of runs from those of
their words (a CRC is linear, so a run's follows from its parts' by shifting), counts by bucket, and gains
looked up in one array of ``buckets`` numbers, the only thing that is sent to tasks. A task hands on at most
``buckets`` counts, whatever it read.

The draw needs the k-th highest score, not a sort of all rows. Spark's quantile sketch gives nested brackets
around it; one exact count of what lies outside each proves or refutes them, the widest being all scores.
Only the rows of the narrowest proven bracket are sorted to find the cutoff. What is drawn is then numbered in
ranges side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.llm.textarrays import LOWER, WORD, parts, words
from treefuse.shared import cut, row_numbers

NEAR = 64  # shifts below so many bytes have tables of their own
BYTE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # one byte's register, from 0


def _lookup(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The linear map whose images of each byte of a register are table's four rows."""
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    one = np.arange(256, dtype=np.uint32)
    identity = np.stack([one << np.uint32(8 * i) for i in range(4)])
    near = [identity]
    for _ in range(NEAR):  # one more zero byte
        near.append((near[-1] >> np.uint32(8)) ^ BYTE[near[-1] & 255])
    far = [near[-1]]
    for _ in range(25):
        far.append(np.stack([_lookup(row, far[-1]) for row in far[-1]]))
    return np.stack(near[:NEAR]), np.stack(far)


_NEAR, _FAR = _tables()
_FLAT = _NEAR.ravel()


def shift(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    low = (by % NEAR).astype(np.int64) << 10
    out = _FLAT[low + (c & 255)] ^ _FLAT[low + 256 + ((c >> 8) & 255)] ^ _FLAT[low + 512 + ((c >> 16) & 255)] ^ _FLAT[low + 768 + (c >> 24)]
    rest, i = by // NEAR, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _lookup(out[odd], _FAR[i])
        rest, i = rest >> 1, i + 1
    return out


def word_registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's register from 0: byte by byte for all words at once, in pieces of NEAR bytes."""
    out, lens = np.zeros(len(starts), np.uint32), ends - starts
    alive = np.arange(len(starts))
    for j in range(min(NEAR, int(lens.max(initial=0)))):
        alive = alive[lens[alive] > j]
        out[alive] = (out[alive] >> np.uint32(8)) ^ BYTE[(out[alive] ^ data[starts[alive] + j]) & 255]
    full = np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lens > NEAR).tolist():
        crc = zlib.crc32(data[starts[i] : ends[i]])
        out[i] = np.uint32(crc) ^ full ^ shift(np.array([full]), lens[i : i + 1])[0]
    return out


def run_buckets(data: np.ndarray, at: np.ndarray, longest: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length of run: at which words one begins, and its bucket; and at which word each row begins."""
    data = LOWER[data]
    starts, ends, first = words(data, at, WORD)
    register, lens = word_registers(data, starts, ends), ends - starts
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    full, space = np.uint32(0xFFFFFFFF), np.uint32(BYTE[0x20])
    out, now, total = [], register, lens
    begin = np.arange(len(starts))
    for m in range(1, longest + 1):
        if m > 1:  # one more word behind each run that stays in its row
            go = row[begin[: max(len(begin), 0)]] == row[np.minimum(begin + m - 1, len(row) - 1)] if len(row) else np.zeros(0, bool)
            go &= begin + m - 1 < len(row)
            begin, now, total = begin[go], now[go], total[go]
            last = begin + m - 1
            more = lens[last]
            now = shift(now, more + 1) ^ shift(np.full(len(last), space), more) ^ register[last]
            total = total + 1 + more
        crc = now ^ shift(np.full(len(now), full), total) ^ full
        out.append((begin, (crc % np.uint32(buckets)).astype(np.int64)))
    return out, first


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, at in parts(batches, "__text"):
            for _, bucket in run_buckets(data, at, longest, buckets)[0]:
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(text).alias("__text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 3, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket: ``buckets`` numbers."""
    s, t = (bucket_counts(d, text, longest, buckets).withColumnRenamed("n", c) for d, c in ((docs, "s"), (target, "t")))
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    found = both.toPandas().sort_values("bucket")  # as many rows as buckets
    n, m = found["s"].to_numpy(np.int64), found["t"].to_numpy(np.int64)
    ratio = (m + 1.0) * (float(n.sum()) + buckets) / ((n + 1.0) * (float(m.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", longest: int = 3) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in parts(batches, "__text"):
            runs, first = run_buckets(data, at, longest, len(gains))
            per, count = np.zeros(int(first[-1]) + 1, np.int64), np.zeros(int(first[-1]) + 1, np.int64)
            for begin, bucket in runs:
                per[begin + 1] += gains[bucket]
                count[begin + 1] += 1
            per, count = np.cumsum(per), np.cumsum(count)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(v, pa.int64()) for v in (np.diff(first), np.diff(count[first]), np.diff(per[first])))], names=["doc_id", "n_words", "n_features", "weight"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def cutoff(rows: DataFrame, k: int, accuracy: int = 10_000) -> tuple:
    """rows(low, doc_id, n_features), k of at least 1 and at most all -> the k-th row in this order."""
    n = rows.count()
    widths = [2 / accuracy, 20 / accuracy, 0.05]
    probs = [min(1.0, max(0.0, k / n + w)) for w in widths for w in (-w, w)]
    row = rows.agg(F.percentile_approx("low", probs, accuracy).alias("q"), F.min("low").alias("a"), F.max("low").alias("b")).first()
    brackets = [*zip(row["q"][::2], row["q"][1::2], strict=True), (row["a"], row["b"])]
    outside = rows.agg(*(F.count(F.when(F.col("low") < a, 1)).alias(f"a{i}") for i, (a, _) in enumerate(brackets)), *(F.count(F.when(F.col("low") <= b, 1)).alias(f"b{i}") for i, (_, b) in enumerate(brackets))).first()
    i = next(i for i in range(len(brackets)) if outside[f"a{i}"] < k <= outside[f"b{i}"])
    inside = rows.where(F.col("low").between(*brackets[i]))
    found = row_numbers(inside, "low", "doc_id", "n_features").where(F.col("pos") == k - outside[f"a{i}"]).first()
    return found["low"], found["doc_id"], found["n_features"]


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank.

    Of the N rows with an id and at least ``least_words`` words, floor(percent * N / 100) are drawn: rank 1, 2, 3...
    by falling score, then smaller doc_id, then fewer features; others have no rank. Null and empty texts have no
    features and weight 0. Repeated rows each stand for themselves. A row without doc_id counts as text, but its score
    is null and it isn't drawn. Without target features each gain falls with the bucket's own count alone; an
    empty table gives no rows. Other columns are ignored.
    """
    weighed = weigh(docs, bucket_gains(docs, target, longest=longest, buckets=buckets), longest=longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    scored = cut(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))))
    may = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    live = scored.where(may).withColumn("low", -F.col("score"))
    k = percent * live.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = lambda rows: rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    if not k:
        return unranked(scored)
    low, doc_id, n_features = cutoff(live, k)
    last = F.struct(F.lit(low).cast("bigint"), F.lit(doc_id).cast(docs.schema["doc_id"].dataType), F.lit(n_features).cast("bigint"))
    place = F.struct("low", "doc_id", "n_features")
    # Rows that are alike in all of these may stand on both sides of the cutoff: their number decides.
    drawn = row_numbers(live.where(place <= last), "low", "doc_id", "n_features", name="rank")
    ranked = drawn.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(unranked(live.where(place > last))).unionByName(unranked(scored.where(~may)))


def op11_resample(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# A run's CRC is the XOR of what each of its bytes leaves after the bytes behind it (p: one byte's register, then
# shifted by one zero byte a step), and of what the start value leaves after as many bytes (z).
SQL = r"""
WITH RECURSIVE bits AS (SELECT b, 0 AS i, b::BIGINT AS v FROM range(256) t(b) UNION ALL SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
one AS (SELECT b, v FROM bits WHERE i = 8),
src AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (SELECT row_number() OVER () AS r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
g AS (SELECT r, side, array_to_string(ws[i : i + m - 1], ' ') AS f FROM w, unnest(range(1, len(ws) + 1)) t(i), range(1, 4) u(m) WHERE i + m - 1 <= len(ws)),
d AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
most AS (SELECT max(length(x)) // 2 AS n FROM d),
p AS (SELECT 0 AS d, b, v FROM one UNION ALL SELECT p.d + 1, p.b, xor(p.v >> 8, one.v) FROM p JOIN one ON one.b = p.v & 255 WHERE p.d < (SELECT n FROM most)),
z AS (SELECT 0 AS n, 4294967295::BIGINT AS v UNION ALL SELECT z.n + 1, xor(z.v >> 8, one.v) FROM z JOIN one ON one.b = z.v & 255 WHERE z.n < (SELECT n FROM most)),
flat AS (SELECT f, length(x) // 2 AS n, i, (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS b FROM d, unnest(range(length(x) // 2)) t(i)),
crc AS (SELECT f, xor(xor(bit_xor(p.v), any_value(z.v)), 4294967295) % 10000 AS k FROM flat JOIN p ON p.d = flat.n - 1 - i AND p.b = flat.b JOIN z ON z.n = flat.n GROUP BY f),
h AS (SELECT r, side, k FROM g JOIN crc USING (f)),
c AS (SELECT k, sum((side = 0)::INT)::DOUBLE AS s, sum((side = 1)::INT)::DOUBLE AS t FROM (SELECT side, k FROM h UNION ALL SELECT 2, range FROM range(10000)) y(side, k) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS v FROM c),
sums AS (SELECT r, count(*) AS n_features, sum(v)::BIGINT AS weight FROM h JOIN gain USING (k) GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM w LEFT JOIN sums USING (r) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n >= 20) AS of_all FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 5 * of_all // 100 THEN place END AS rank FROM placed
"""
