"""Reshaping and summaries of matrices (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.functions.quantiles import exact_quantiles


def cells(samples: DataFrame) -> DataFrame:
    """g, sample_id, x -> g, sample_id, feature_idx (from 0), value."""
    return samples.select("g", "sample_id", F.posexplode("x").alias("feature_idx", "value"))


def transpose(samples: DataFrame) -> DataFrame:
    """Features become rows: g, feature_idx, values in the order of sample_id. One full shuffle by feature."""
    ordered = F.array_sort(F.collect_list(F.struct("sample_id", "value")))
    return cells(samples).groupBy("g", "feature_idx").agg(ordered.alias("v")).select("g", "feature_idx", F.col("v.value").alias("values"))


def ordered_by_label(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """All rows, by label, then id."""
    return df.orderBy(label, id_col)


def sample_rows(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, the same for one seed whatever the partitions: a top-k by a hash of the id."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(k)


def quantiles(samples: DataFrame, probabilities: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """g, p, value: exact quantiles of all cells, nulls left out, linear between neighbours."""
    return exact_quantiles(cells(samples), "value", probabilities).withColumnRenamed("q", "value")


def breaks(samples: DataFrame, n: int) -> DataFrame:
    """g, i, value: n evenly spaced values from the smallest cell to the largest."""
    ends = cells(samples).groupBy("g").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.select("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "low", "high").select("g", "i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (n - 1)).alias("value"))
