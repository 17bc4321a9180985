"""Numeric matrices as tables, and fits as folders of Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def samples(df: DataFrame, id_col: str, features: list[str] | Column, group: Column | None = None, on_invalid: str = "raise") -> DataFrame:
    """A table -> g, sample_id, x (array of double). ``features``: numeric columns, or one array column.

    A row with a null id, a null feature, or one that is not finite is an error when the table is read, or
    left out with on_invalid="drop". Without ``group`` all rows are one data set, g = 0.
    """
    if on_invalid not in ("raise", "drop"):
        raise ValueError("on_invalid is raise or drop")
    x = F.array(*(F.col(c).cast("double") for c in features)) if isinstance(features, list) else features.cast("array<double>")
    out = df.select((F.lit(0) if group is None else group).alias("g"), F.col(id_col).cast("bigint").alias("sample_id"), x.alias("x"))
    good = F.col("sample_id").isNotNull() & F.col("g").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    if on_invalid == "drop":
        return out.where(good)
    return out.withColumn("x", F.when(good, F.col("x")).otherwise(F.raise_error(F.lit("a sample has a null id or a feature that is null or not finite"))))


@dataclass
class Fit:
    """What a fit returns. levels(g, level, lambda, n_in, n_out), pointers(g, level, node_id, rep_id): the node
    that enters a level and the one that stands for it afterwards (levels in which nothing fused have no
    rows), coordinates(g, level, rep_id, weight, x): cluster means. features(g, level, feature_idx) for sparse
    fits and pointers_f for biclustering ones."""

    levels: DataFrame
    pointers: DataFrame
    coordinates: DataFrame
    features: DataFrame | None = None
    pointers_f: DataFrame | None = None


def write_fit(fit: Fit, path: str) -> None:
    for f in fields(fit):
        table = getattr(fit, f.name)
        if table is not None:
            table.write.mode("overwrite").partitionBy("level").parquet(f"{path}/{f.name}")


def read_fit(spark: SparkSession, path: str, sparse: bool = False, bicluster: bool = False) -> Fit:
    names = ["levels", "pointers", "coordinates"] + ["features"] * sparse + ["pointers_f"] * bicluster
    return Fit(**{n: spark.read.parquet(f"{path}/{n}") for n in names})
