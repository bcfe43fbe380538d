"""Row-local verbs and running column sums with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import FeatureMatrix

ROW = "feature string, counts array<double>"


def read_rows(spark: SparkSession, path: str, samples: list[str], **more) -> FeatureMatrix:
    """A matrix whose rows arrive as Parquet files (feature, counts) in a folder."""
    return FeatureMatrix(spark.readStream.schema(ROW).parquet(path), samples, **more)


def stream(m: FeatureMatrix, verb: Callable[[FeatureMatrix], FeatureMatrix | DataFrame], path: str, checkpoint: str, **trigger):
    """Run a row-local verb on arriving rows and append its result as Parquet; exactly once per row. Returns the query."""
    out = verb(m)
    df = out.df if isinstance(out, FeatureMatrix) else out
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def column_sums(m: FeatureMatrix) -> DataFrame:
    """sample_idx, total so far: state of one number for each sample (output mode complete or update)."""
    return m.df.select(F.posexplode("counts").alias("sample_idx", "value")).groupBy("sample_idx").agg(F.sum("value").alias("total"))
