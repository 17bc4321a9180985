"""URL rules by a sort-merge range join (DataFrame functions only).

A host is written label by label from its end ("www.example.net" -> "net.example.www."), so that a host
and all its subdomains are one interval of keys, and two rules' intervals are nested or disjoint. Rules
that ask for the same path prefix form one layer; a url enters a layer if its path starts with that
prefix. In each layer, rule starts, urls and rule ends are sorted by key and swept once: the rules that
are active at a url are a stack, of which the url takes the top. Of all layers' tops the longest wins.

Layers are dealt out by (path prefix, last label, salt). A last label with many urls is spread over as
many salts as it needs, and only its own rules are copied to them, so no task sweeps more than about
``rows_per_sweep`` urls, whatever share of the urls has one host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treefuse.llm.shared import ascii_lower

START, URL, END = 0, 1, 2


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from last to first, each with a dot behind it, as bytes: bytes compare as Spark sorts them."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")), "UTF-8")


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", rows_per_sweep: int = 2_000_000) -> DataFrame:
    """pages(page_id, url), rules(host, path, verdict) -> page_id, host, path, rule, verdict.

    One row comes back for each page row, repeated rows included. A rule fits its host and all subdomains
    if the url's path starts with the rule's path; of several, the one with most characters wins, then
    the longer host. Repeated rules count once (a block wins over an allow). A null url, or one without
    "://", has an empty host and path, which no rule fits. Empty tables give empty results or no matches;
    other columns of either table are ignored.
    """
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    wanted = (
        rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("layer"), F.col("verdict").alias("r_verdict"))
        .where("r_host is not null and r_host != ''")
        .groupBy("r_host", "layer")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("key", host_key(F.col("r_host")))
        .withColumn("top", F.element_at(F.split("r_host", r"\."), -1))
    )
    # How deep rules nest, and which prefix lengths there are: both follow from the rules alone.
    nest = Window.partitionBy("layer", "top").orderBy("key", "kind")
    ends = F.concat(F.col("key"), F.lit(b"\xff"))
    edges = wanted.select("*", F.lit(START).alias("kind")).unionByName(wanted.withColumn("key", ends).withColumn("kind", F.lit(END)))
    depth = F.sum(F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0))
    shape = edges.withColumn("depth", depth.over(nest)).agg(F.max("depth").alias("deep"), F.sort_array(F.collect_set(F.length("layer"))).alias("lengths")).first()
    deep, lengths = int(shape["deep"] or 0), list(shape["lengths"] or [])
    none = base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not deep:
        return none

    # A verdict hangs on host and path alone: repeated ones are judged once. Each probes the layers of all
    # prefix lengths that rules have, as far as its path is long enough.
    probes = (
        base.select("host", "path").distinct().select("host", "path", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n"))
        .where("length(path) >= n")
        .select("host", "path", F.expr("substring(path, 1, n)").alias("layer"), F.element_at(F.split("host", r"\."), -1).alias("top"))
    )
    layers = wanted.groupBy("layer", "top").agg(F.count(F.lit(1)).alias("n_rules"))
    sizes = (
        probes.groupBy("layer", "top").agg(F.count(F.lit(1)).alias("n_urls"))
        .join(layers, ["layer", "top"])
        .select("layer", "top", F.ceil(F.col("n_urls") / rows_per_sweep).cast("int").alias("salts"))
    )
    probes = probes.join(sizes, ["layer", "top"]).select(
        "layer", "top", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), host_key(F.col("host")).alias("key"), F.lit(URL).alias("kind"),
        "host", "path", F.lit(None).cast("string").alias("r_host"), F.lit(None).cast("string").alias("r_verdict"),
    )
    copies = edges.join(sizes, ["layer", "top"]).select(
        "layer", "top", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "kind", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "r_host", "r_verdict"
    )
    sweep = Window.partitionBy("layer", "top", "salt").orderBy("key", "kind")
    swept = probes.unionByName(copies).withColumn("depth", depth.over(sweep))
    rule = F.struct((F.length("r_host") + F.length("layer")).alias("chars"), F.length("r_host").alias("host_chars"), F.concat("r_host", "layer").alias("rule"), F.col("r_verdict").alias("verdict"))
    for level in range(1, deep + 1):  # slot k of the stack holds the rule that was last pushed to depth k
        swept = swept.withColumn(f"slot{level}", F.last(F.when((F.col("kind") == START) & (F.col("depth") == level), rule), ignorenulls=True).over(sweep))
    top = F.element_at(F.array(*(F.col(f"slot{k}") for k in range(1, deep + 1))), F.col("depth").cast("int"))
    hits = swept.where((F.col("kind") == URL) & (F.col("depth") > 0)).select("host", "path", top.alias("hit")).groupBy("host", "path").agg(F.max("hit").alias("hit"))
    return base.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(host, path, verdict)")
    return apply_rules(pages, rules)


SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, max(struct_pack(n := length(h || p), rule := h || p, v := v)) AS best
  FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
