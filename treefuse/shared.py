"""Cut lineage: tables written once to the shared checkpoint folder, and removed when what came of them is written."""

from __future__ import annotations

import atexit
import dataclasses
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SCOPES: list[list[Callable[[], object]]] = [[]]  # how to remove what each open scope has written; the first ends with the process


def cut_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str = "cut") -> str:
    """A name in the shared folder that the innermost open scope removes."""
    folder = f"{cut_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    settings = spark._jsc.hadoopConfiguration()
    _SCOPES[-1].append(lambda: path.getFileSystem(settings).delete(path, True))
    return folder


def at_end(remove: Callable[[], object]) -> None:
    """Has the innermost open scope remove something else when it ends."""
    _SCOPES[-1].append(remove)


def _clear(scope: list[Callable[[], object]]) -> None:
    while scope:
        try:
            scope.pop()()
        except Exception as e:  # a lost file system must not hide what the work itself has raised
            print(f"not removed: {e}")


atexit.register(lambda: _clear(_SCOPES[0]))


@contextmanager
def scratch() -> Iterator[None]:
    """Whatever is cut inside is removed at its end, on failure as well: write results before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        _clear(_SCOPES.pop())


def tidy(fn: Callable) -> Callable:
    """A function whose result (a DataFrame, or a tuple, list or dataclass with some) is written once, and all
    else that it has cut is removed. Results belong to the scope around the call, or to the process."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        with scratch():
            result = fn(*args, **kwargs)
            mine = _SCOPES[-1]
            if not mine:  # nothing was cut
                return result
            _SCOPES.append([])
            try:
                return _written(result)
            finally:
                kept = _SCOPES.pop()
                _SCOPES[-2].extend(kept)

    return run


def _written(result):
    if isinstance(result, DataFrame):
        return cut(result)
    if isinstance(result, tuple | list):
        return type(result)(_written(v) for v in result)
    if dataclasses.is_dataclass(result):
        return dataclasses.replace(result, **{f.name: _written(getattr(result, f.name)) for f in dataclasses.fields(result)})
    return result


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder. Unlike a checkpoint, which hands on the
    estimates of the plan behind it (and these multiply in every round of joins), the files have a known size, so
    Spark plans the next joins by what is really there."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def mark() -> int:
    """A place in what the innermost scope has written, for ``recut``."""
    return len(_SCOPES[-1])


def recut(since: int, df: DataFrame) -> DataFrame:
    """As ``cut``, and removes what the scope has written after ``since``: a loop's earlier state, whose successor this is."""
    return forget(since, cut(df))


def forget(since: int, *last: DataFrame) -> DataFrame:
    """Removes what the scope has written after ``since`` and before the tables ``last``, which were written last.
    Returns the first of these."""
    old, _SCOPES[-1][since:] = _SCOPES[-1][since : -len(last)], _SCOPES[-1][-len(last) :]
    _clear(old)
    return last[0]


class Pile:
    """Tables of one shape that are written one after the other into one folder, so that a loop's results need no
    plan over all its rounds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.schema = spark, new_folder(spark, "pile"), None

    def add(self, df: DataFrame) -> None:
        self.schema = self.schema or df.schema
        df.write.mode("append").parquet(self.folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)


def settle(parents: DataFrame, keys: list[str], node: str, parent: str, steps: int = 3) -> DataFrame:
    """keys, node, parent -> the same with each node's topmost ancestor as parent, by pointer doubling: about
    log(depth) self-joins, written and looked at after every ``steps`` of them. A top points to itself. Parents
    that go round in a circle raise an error: doubling has come further than there are nodes, and some still move."""
    since = mark()
    now, reach, rows = cut(parents.select(*keys, node, parent)), 1, None
    while True:
        then = now
        for i in range(steps):
            up = then.select(*keys, F.col(node).alias(parent), F.col(parent).alias("__up"))
            then = then.join(up, [*keys, parent]).select(*keys, node, (F.col(parent) != F.col("__up")).alias("__moved"), F.col("__up").alias(parent))
            then = then if i == steps - 1 else then.drop("__moved")
        then = recut(since, then)
        now, reach = then.drop("__moved"), reach << steps
        if then.where("__moved").isEmpty():
            return now
        rows = now.count() if rows is None else rows
        if reach > 2 * rows:
            raise ValueError("parents go round in a circle")


def rounded(col: Column | str, digits: int = 6) -> Column:
    """For comparisons: rounded, and never minus zero."""
    return F.round(col, digits) + F.lit(0.0)


def row_numbers(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """The rows in order with their number from 1: ranges of the order are numbered side by side, and each range
    starts where the counts of those before it end (a row a range)."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + inner).cast("bigint")).drop("__range", "__before")


def running_sums(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column | None = None) -> DataFrame:
    """The rows with the sum of ``value`` (default: 1, so their number) up to each in order within its keys. As
    ``row_numbers``, so a group of any size is dealt over ranges."""
    dealt = df.withColumn("__v", F.lit(1) if value is None else value).repartitionByRange(*keys, *order)
    dealt = cut(dealt.withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("__v").alias("__n"))  # a row a group and range
    before = sums.select(*keys, "__range", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__n")).alias("__before"))
    inner = F.sum("__v").over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(before, [*keys, "__range"]).withColumn(name, (F.col("__before") + inner).cast("bigint")).drop("__range", "__before", "__v")
