"""Comparing labels with known ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.operators.kernels import matching


def confusion(found: DataFrame, truth: DataFrame) -> DataFrame:
    """g, label, true_label, n over samples that both tables have."""
    joined = found.join(truth.select("g", "sample_id", F.col("label").alias("true_label")), ["g", "sample_id"])
    return joined.groupBy("g", "label", "true_label").agg(F.count(F.lit(1)).alias("n"))


def accuracy(found: DataFrame, truth: DataFrame, most: int = 1000) -> DataFrame:
    """g, accuracy: the share of samples on the best one-to-one matching of labels. The table of counts, which has
    at most ``most`` labels a side, is all that a task sees."""
    table = confusion(found, truth)
    kind = table.schema["g"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        rows, a = np.unique(t.column("label").to_numpy(), return_inverse=True)
        columns, b = np.unique(t.column("true_label").to_numpy(), return_inverse=True)
        if max(len(rows), len(columns)) > most:
            raise ValueError(f"more than {most} labels to match")
        counts = np.zeros((len(rows), len(columns)))
        np.add.at(counts, (a, b), t.column("n").to_numpy())
        return pa.table({"g": t.column("g").slice(0, 1), "accuracy": pa.array([matching(counts) / counts.sum()])})

    return table.groupBy("g").applyInArrow(run, f"g {kind}, accuracy double")
