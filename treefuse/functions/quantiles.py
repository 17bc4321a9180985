"""Exact quantiles by selection: no task holds a group's values.

Equal values are counted first, so a frequent one is one row. Ranges of the values are dealt side by side; the counts of
the ranges say in which one a wanted position lies, and only there running counts are compared with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treefuse.shared import cut


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """g, p, q: for each group and probability, the quantile of ``value`` (nulls left out), linear between neighbours.
    A group without values has no rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy("g", F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    dealt = cut(counts.repartitionByRange("g", "v").withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("g", "range").agg(F.sum("c").alias("n"))  # a row a group and range
    order = Window.partitionBy("g").orderBy("range")
    ranges = ranges.withColumns({"end": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("g"))}).withColumn("begin", F.col("end") - F.col("n"))
    h = (F.col("all") - 1) * F.col("p")
    asked = ranges.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probabilities))))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h))))).where((F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end")))
    inner = Window.partitionBy("g", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(asked.select("g", "range").distinct(), ["g", "range"], "left_semi").withColumn("last", F.sum("c").over(inner))
    met = placed.join(asked.select("g", "range", "begin", "p", "rank", h.alias("h")), ["g", "range"])
    met = met.where((F.col("rank") - F.col("begin") >= F.col("last") - F.col("c")) & (F.col("rank") - F.col("begin") < F.col("last")))
    both = met.groupBy("g", "p").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("h") - F.floor("h")).alias("way"))
    return both.select("g", "p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("way")).alias("q"))
