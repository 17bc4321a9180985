"""What the text operators share: the cluster's shared folder, cut lineage, word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treefuse.shared import at_end
from treefuse.shared import cut as cut
from treefuse.shared import cut_dir as shared_dir
from treefuse.shared import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def only(df: DataFrame, **columns: Column) -> DataFrame:
    """Just the named columns: whatever else a table carries can't clash with an operator's own names."""
    return df.select(*(c.alias(k) for k, c in columns.items()))


def scratch_table(spark: SparkSession, kind: str) -> tuple[str, str]:
    """A new name for a table and a place for it in the shared folder; both go when the innermost open scope ends."""
    folder, name = new_folder(spark, kind), f"{kind}_{uuid.uuid4().hex}"
    at_end(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    return name, folder
