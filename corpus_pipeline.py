"""Documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; ``run`` writes it as Parquet to the shared folder and reads it again for the next stage. All but
the last return the columns of documents. Rows without a doc_id end at the second stage, where of several
rows with one doc_id the first by text stays, a null text last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treefuse.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from treefuse.shared import forget, mark, new_folder, scratch

ORACLE_SQL = None  # a trained network and a vocabulary: tested against brute force instead
LEAST_QUALITY = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1; it learns from the labelled rows that op10 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    model = quality.train(docs.where(~quality.held_out()), labels)
    return quality.score(docs, model, docs.columns, out="__quality").where(F.col("__quality") >= LEAST_QUALITY).drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id")
    out = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text")))
        out = out.withColumn("__row", first).where("__row = 1").drop("__row")
    return out


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller doc_id has; characters stay whole."""
    left = suffix_dedup.remove_repeats(docs).select("doc_id", F.col("text").alias("__text"))
    rest = docs.drop("text", "n_chars")
    joined = left.join(rest, "doc_id").withColumns({"text": F.col("__text"), "n_chars": F.length("__text").cast("bigint")})
    return joined.select(docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of ten words."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("n_hit = 0").select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of every remaining text."""
    encoded = bpe.encode(docs, bpe.public_vocabulary, ["doc_id"], decoded=True)
    return bpe.digests(encoded, "ids")


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", clean_of_benchmarks),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES:
        folder = new_folder(spark, "stage")
        with scratch():  # what the stage has cut goes with it
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = forget(since, spark.read.parquet(folder))  # and what it has read
    return docs
