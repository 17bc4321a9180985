"""Benchmark passages in documents by a prefix-filtered set join (DataFrame functions only).

Each benchmark item gives windows of ``size`` consecutive words. A document holds a window only if it
holds all its words, so for exact containment a prefix of one word is enough: the rarest one, by counts
over the whole corpus. Documents' words are joined with those words; a match at a position fixes where
the window would have to start. Length and positional bounds drop what would stick out at either end,
and the rest is compared word for word with the document at that place.

The window table is broadcast only while it measures at most ``broadcast_bytes``. Then exploding, joining
and comparing are one stage in which the document's word array is never copied. A larger table is joined
by a shuffle on the rare word, and matches go back to their documents by a second join; documents' own rows,
which carry their word counts, stay out of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treefuse.llm.shared import ascii_lower, cut

NOT_WORD = r"[\x00-/:-@\[-`{-\x7f]+"
MARK = "\x01"  # no word: stands before a document's words and carries its word count through the broadcast join


def raw_words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, case kept; may start or end with ''."""
    return F.split(F.coalesce(text, F.lit("")), NOT_WORD)


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """items(item_id, text) -> item_id, words (array): all windows, or one for an item of fewer words."""
    words = F.filter(raw_words(ascii_lower(F.col("text"))), lambda w: w != "")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1))), lambda i: F.slice(F.col("all"), i, size))
    return items.select("item_id", words.alias("all")).where("size(all) > 0").select("item_id", F.explode(every).alias("words")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, n_words, n_hit, item_ids (sorted array of strings).

    Null and empty texts have no words, give (0, 0, empty) as documents and no windows as items. Repeated
    document rows give one row; rows of one doc_id with different texts give one each. Repeated items count
    once, and items without an id are not reported but still hit; an id may be of any type. Other columns are ignored.
    """
    windows = item_windows(items, size).withColumn("win", F.array_join("words", " "))
    placed = windows.select("win", "words").distinct().select("win", F.size("words").alias("n"), F.posexplode("words").alias("off", "word"))
    placed = placed.withColumn("key", F.lower("word"))
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), F.concat(F.array(F.lit(MARK)), raw_words(F.col("text"))).alias("words"))
    edge = (F.element_at("words", 2) == "").cast("int") + F.when(F.size("words") > 2, (F.element_at("words", -1) == "").cast("int")).otherwise(0)
    d = d.withColumn("n_words", (F.size("words") - 1 - edge).cast("long"))

    # Rarity over all documents, of the benchmark's own words.
    keys = placed.select("key").distinct()
    bound = keys.agg(F.coalesce(F.sum(F.length("key") + 48), F.lit(0)).alias("b")).first()["b"]
    words = d.select(F.explode("words").alias("word")).select(F.lower("word").alias("key"))
    number = F.count(F.lit(1)).alias("df")
    if bound <= broadcast_bytes:
        counts = words.join(F.broadcast(keys), "key").groupBy("key").agg(number)
    else:  # words are counted where they are read, so a frequent one is a row a task before it moves
        counts = words.groupBy("key").agg(number).join(keys, "key")
    rarest = placed.join(counts, "key", "left").groupBy("win", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "off")).alias("r"))
    probe = cut(rarest.where("r.df > 0").select("win", "n", "r.key", "r.off").join(windows.select("win", "item_id"), "win"))  # the corpus is counted once
    bound = probe.agg(F.coalesce(F.sum(F.length("win") + F.length("key") + 96), F.lit(0)).alias("b")).first()["b"]
    no_item = F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")

    inside = F.when(
        (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("words")),
        ascii_lower(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")) == F.col("win"),
    ).otherwise(False)
    shuffled = bound > broadcast_bytes
    if not shuffled:
        mark = docs.sparkSession.range(1).select(F.lit(MARK).alias("win"), F.lit(1).alias("n"), F.lit(MARK).alias("key"), F.lit(0).alias("off"), no_item)
        probe = probe.unionByName(mark)
        at = d.select("doc_id", "h", "n_words", "words", F.posexplode("words").alias("pos", "word")).withColumn("key", F.lower("word"))
        hits = at.join(F.broadcast(probe), "key").withColumn("start", F.col("pos") - F.col("off")).where(inside)
    else:
        # Only words that some window is looked up by are shuffled: their list is far smaller than the windows'.
        asked = cut(probe.select("key").distinct())
        bound = asked.agg(F.coalesce(F.sum(F.length("key") + 48), F.lit(0)).alias("b")).first()["b"]
        at = d.select("doc_id", "h", F.posexplode("words").alias("pos", "word")).select("doc_id", "h", "pos", F.lower("word").alias("key"))
        at = at.join(F.broadcast(asked), "key", "left_semi") if bound <= broadcast_bytes else at
        may = at.join(probe, "key").select(F.struct("doc_id", "h").alias("k"), (F.col("pos") - F.col("off")).alias("start"), "win", "n", "item_id").distinct()
        hits = may.join(d.withColumn("k", F.struct("doc_id", "h")).dropDuplicates(["k"]), "k").where(inside)
    hits = hits.select("doc_id", "h", "n_words", "start", (F.col("start") + F.col("n")).alias("end"), "item_id", (F.col("win") == MARK).alias("mark"))
    if shuffled:  # all documents' marks would meet on one key of that join
        hits = hits.unionByName(d.select("doc_id", "h", "n_words", F.lit(0).alias("start"), F.lit(1).alias("end"), no_item, F.lit(True).alias("mark")))

    # Words under several windows count once: each window adds what reaches beyond all earlier ones.
    w = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reached, F.col("start"))))
    return (
        hits.withColumn("fresh", F.when(F.col("mark"), 0).otherwise(fresh))
        .groupBy("doc_id", "h")
        .agg(F.max("n_words").alias("n_words"), F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
        .drop("h")
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, i - 1 AS pos, ws[i] AS word FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  ), unnest(range(1, len(ws) + 1)) t(i)
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i : i + 9], ' ') AS g, len(ws[i : i + 9]) AS n
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT d.doc_id, i - 1 AS pos, s.n, array_to_string(ws[i : i + s.n - 1], ' ') AS g
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents) d,
    sizes s, unnest(range(1, len(ws) - s.n + 2)) t(i)
), hit AS (SELECT doc_id, pos, win.n, item_id FROM grams JOIN win USING (g, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(pos, pos + n)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN cnt USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
