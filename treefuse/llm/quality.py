"""A quality classifier: a byte-level convolutional network in numpy.

``filters`` learned filters of ``WIDTH`` bytes slide over the whole text in steps of ``STEP``. A text is
covered by overlapping chunks of ``CHUNK`` blocks (each starts ``CHUNK - 1`` blocks after the last one); a
filter's largest answer in a chunk, through tanh, is the chunk's feature. The mean and the largest of each
feature over all chunks go into one logistic unit.

Training takes a bounded sample of labelled rows to the driver: up to ``per_class`` whole texts of each
label, and ``sample_bytes`` of text in all, the first by a hash of the id. Scoring runs where the rows are;
the model that is sent there has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treefuse.llm.textarrays import parts

WIDTH, STEP, BLOCK, CHUNK = 6, 2, 64, 4


@dataclass
class Model:
    taps: np.ndarray  # WIDTH x 256 x filters: what each byte at each place adds to each filter
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: float


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row from a new block on behind WIDTH zero bytes, so that no filter sees two rows at once, and where
    rows' blocks begin."""
    lens = np.diff(at)
    blocks = (lens + WIDTH + BLOCK - 1) // BLOCK
    begin = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(begin[-1]) * BLOCK + WIDTH, np.uint8)
    out[np.repeat(begin[:-1] * BLOCK + WIDTH - at[:-1], lens) + np.arange(len(data))] = data
    return out, begin


def block_maxima(model: Model, data: np.ndarray, n: int) -> np.ndarray:
    """blocks x filters: the largest answer in each block."""
    out = np.empty((n, len(model.bias)), np.float32)
    run = 2048
    for a in range(0, n, run):
        b = min(a + run, n)
        total = None
        for k in range(WIDTH):
            got = model.taps[k].take(data[a * BLOCK + k : b * BLOCK + k : STEP], axis=0)
            total = got if total is None else np.add(total, got, out=total)
        out[a:b] = total.reshape(b - a, BLOCK // STEP, -1).max(1)
    return out


def chunk_blocks(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chunks x CHUNK: the blocks of each chunk (the row's last block fills up), and where rows' chunks begin."""
    blocks = np.diff(begin)
    chunks = np.maximum(1, -(-(blocks - 1) // (CHUNK - 1)))
    first = np.concatenate(([0], np.cumsum(chunks)))
    row = np.repeat(np.arange(len(blocks)), chunks)
    at = (np.arange(int(first[-1])) - first[row]) * (CHUNK - 1) + begin[row]
    return np.minimum(at[:, None] + np.arange(CHUNK), begin[row + 1][:, None] - 1), first


def pooled(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows x filters: each feature's mean and maximum over the row's chunks."""
    text, begin = padded(data, at)
    which, first = chunk_blocks(begin)
    chunk = np.tanh(block_maxima(model, text, int(begin[-1]))[which].max(1) + model.bias)
    mean = np.add.reduceat(chunk, first[:-1], dtype=np.float64) / np.diff(first)[:, None]
    return mean, np.maximum.reduceat(chunk, first[:-1])


def probabilities(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    mean, top = pooled(model, data, at)
    z = mean @ model.mean_weight + top @ model.max_weight + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: list[int], share: float | None = None, filters: int = 16, epochs: int = 20, batch: int = 32, rate: float = 0.02, seed: int = 7, decay: float = 1e-4) -> Model:
    """Adam on the logistic loss; gradients reach the filters through the places of the maxima. ``share`` is
    label 1's share where the sample was drawn (else the sample's own): rows are weighted back to it.
    Without rows of both classes the score is the share of label 1 (or a half)."""
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    model = Model((rng.normal(size=(WIDTH, 256, filters)) * 0.05).astype(np.float32), np.zeros(filters, np.float32), rng.normal(size=filters) * 0.3, rng.normal(size=filters) * 0.3, 0.0)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        model.taps[:] = 0
        model.mean_weight[:] = model.max_weight[:] = 0
        model.offset = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    share = y.mean() if share is None else min(max(share, 0.02), 0.98)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    names = ("taps", "bias", "mean_weight", "max_weight", "offset")
    m = {k: np.zeros_like(np.asarray(getattr(model, k), np.float64)) for k in names}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            at = np.concatenate(([0], np.cumsum([len(texts[i]) for i in rows])))
            grads = gradients(model, data, at, y[rows], weight[rows])
            step += 1
            pace = rate * (1 - 0.9 * (epoch / epochs))
            for k in names:
                g = grads[k] + decay * np.asarray(getattr(model, k), np.float64)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                move = pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                now = getattr(model, k) - move
                setattr(model, k, float(now) if k == "offset" else now.astype(np.float32) if k in ("taps", "bias") else now)
    return model


def gradients(model: Model, data: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    text, begin = padded(data, at)
    which, first = chunk_blocks(begin)
    n, f = int(begin[-1]), len(model.bias)
    total = sum(model.taps[k].take(text[k : n * BLOCK + k : STEP], axis=0) for k in range(WIDTH))
    total = total.reshape(n, BLOCK // STEP, f)
    peak = total.argmax(1)  # blocks x filters
    top = np.take_along_axis(total, peak[:, None], 1)[:, 0]
    candidates = top[which]  # chunks x CHUNK x filters
    best = candidates.argmax(1)
    chunk = np.tanh(np.take_along_axis(candidates, best[:, None], 1)[:, 0] + model.bias)
    count = np.diff(first)
    mean = np.add.reduceat(chunk, first[:-1], dtype=np.float64) / count[:, None]
    most = np.maximum.reduceat(chunk, first[:-1])
    z = mean @ model.mean_weight + most @ model.max_weight + model.offset
    dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    row = np.repeat(np.arange(len(y)), count)
    is_top = chunk == most[row]
    share = np.add.reduceat(is_top, first[:-1], dtype=np.float64)[row]
    d_chunk = dz[row, None] * (model.mean_weight / count[row, None] + model.max_weight * is_top / share)
    d_pre = d_chunk * (1 - chunk.astype(np.float64) ** 2)
    block = np.take_along_axis(which, best, 1)  # chunks x filters
    place = block * BLOCK + np.take_along_axis(peak[block.ravel()], np.tile(np.arange(f), len(block))[:, None], 1).reshape(block.shape) * STEP
    taps = np.zeros((WIDTH, 256, f))
    for k in range(WIDTH):
        np.add.at(taps[k], (text[place + k], np.broadcast_to(np.arange(f), place.shape)), d_pre)
    return {"taps": taps, "bias": d_pre.sum(0), "mean_weight": dz @ mean, "max_weight": dz @ most, "offset": np.asarray(dz.sum())}


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, sample_bytes: int = 8 << 20, **options) -> Model:
    """docs(doc_id, text), labels(doc_id, quality) -> a model. Ids whose labels differ are left out, as are
    null ids and labels. The sample's bounds are ``per_class`` and ``sample_bytes``."""
    given = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").drop("y2")
    light = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).join(given, "doc_id").withColumn("o", F.xxhash64("doc_id"))
    chosen = []
    for y in (0, 1):
        spent = 0
        for r in light.where(F.col("y") == y).orderBy("o", "doc_id", "n").limit(per_class).collect():
            if spent + r["n"] <= sample_bytes // 2:
                chosen.append((r["doc_id"], y))
                spent += r["n"]
    if not chosen:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame(sorted(set(chosen)), "doc_id bigint, y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return fit([(r["text"] or "").encode() for r in rows], [r["y"] for r in rows], share=given.agg(F.avg("y")).first()[0], **options)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The kept columns and ``out``: the probability of label 1. Null and empty texts are scored as empty;
    repeated rows stay, each with the same score; an empty table gives none."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in parts(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(probabilities(model, data, at), pa.float64())], names=[*keep, out])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model, ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
