"""Tables in the folder that driver and executors share, and sums along an order that no single task computes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs locally (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="spark-tallyloom-")
    atexit.register(shutil.rmtree, root, True)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


_open: list[list[str]] = []  # tables made inside each passing() block that is open


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Inside, tables are written for a result that is written itself or gathered before the block ends; at its end they are removed.

    What the block returns must not read them: write it with materialise(..., keep=True).
    """
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        conf = spark._jsc.hadoopConfiguration()
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Removed with the JVM, or at the end of the passing() block that it is made in, unless it is kept.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/tallyloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, order: list) -> DataFrame:
    """df in a written table, with _range (the number of the row's range of the order), _tie and _at (its number in the range, from 0).

    A row's place in the input is the last key, so equal rows spread over ranges and no task gets all of them.
    """
    kept = materialise(df, "rows").withColumn("_tie", F.monotonically_increasing_id())
    dealt = kept.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_range", F.spark_partition_id())
    return materialise(dealt.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """df with the row's number, from 0, in an order; no task holds more than a range of it. Ties are numbered in any order."""
    placed = ranges(df, order)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_tie", "_at", "_start")


def running_sums(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df, whose values of `order` must be distinct, with sum_<v> (up to and with the row) and total_<v> of each value column.

    Rows are dealt into ranges of the order; sums run inside each range, and over the ranges' totals (one row for each
    partition). Also adds _range, which numbers the ranges in order.
    """
    ranged = materialise(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("_range").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_range", *(F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values), *(F.sum(f"_{v}").over(Window.partitionBy(F.lit(1))).alias(f"total_{v}") for v in values))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # the totals have one row for each partition, which bounds the broadcast
    joined = ranged.join(F.broadcast(per), "_range")
    return joined.withColumns({f"sum_{v}": F.col(f"_b_{v}") + F.sum(v).over(inside) for v in values}).drop(*(f"_b_{v}" for v in values))
