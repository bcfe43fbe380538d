"""Helpers that every training-data operator shares: tables in the shared folder and global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise, passing, shared_root

__all__ = ["materialise", "passing", "scratch_path", "shared_root", "table", "with_row_number"]

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the file system removes it when the driver's JVM ends."""
    path = f"{shared_root(spark).rstrip('/')}/tallyloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def with_row_number(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """Number all rows from 0 in the given order, without one task ever holding more than a range of them.

    Rows are dealt into ranges of the order (with a row's own place in the input as the last key, so equal rows
    spread out), each range is sorted and numbered by itself, and the ranges' sizes (one row per partition) are
    summed up and added. Rows that tie in the order get numbers in no particular order among themselves.
    """
    ranged = (
        materialise(df, "rows")
        .withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
        .drop("_tie")
    )
    placed = materialise(ranged, "ranges")
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row for each partition: a broadcast of that size is bounded by the number of partitions
    return placed.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_idx")).drop("_pid", "_idx", "_start")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
