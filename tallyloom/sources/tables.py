"""Count tables as text, and matrices stored as Parquet with their metadata."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seq, superkmers
from ..matrix import FeatureMatrix
from . import bgzf


def _placed(lines: DataFrame) -> DataFrame:
    """value, ordinal of lines that Spark reads from text files."""
    # splits of a file by their place in it; 2^33 rows in each
    block = F.rank().over(Window.orderBy("file", "block")) - 1
    blocks = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).distinct().withColumn("n", block)  # a row for each split
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    return lines.join(blocks, ["file", "block"]).select("value", (F.col("n") * F.lit(1 << 33) + F.col("at")).alias("ordinal"))


def read_counts(spark: SparkSession, path: str, partitions: int | None = None) -> FeatureMatrix:
    """A table with a header: feature, then one numeric column for each sample, split by white space; .gz is read as such.

    Block gzip (BGZF) is read by many tasks. Other gzip can't be split, so such a file is dealt out anew after reading; a row
    with another number of cells raises. Rows get their place in the input as column ordinal: distinct and rising
    within a file, not gapless.
    """
    blocks_of_gzip = bgzf.is_block_gzip(path)
    lines = bgzf.read_lines(spark, path) if blocks_of_gzip else spark.read.text(path)
    header = bgzf.first_line(path) if blocks_of_gzip else lines.first()
    if header is None:
        raise ValueError("the count table is empty")
    names = header[0].split()
    if len(names) < 2:
        raise ValueError("the count table has no sample columns")
    if not blocks_of_gzip:
        lines = _placed(lines)
        if path.endswith("gz"):
            lines = lines.repartition(partitions or spark.sparkContext.defaultParallelism)
    cells = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.where((F.col("value") != header[0]) & (F.trim("value") != "")).select("ordinal", cells.alias("c"))
    good = F.when(F.size("c") == len(names), F.transform(F.slice("c", 2, len(names) - 1), lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit("a row has another number of columns than the header")))
    return FeatureMatrix(rows.select(F.get("c", F.lit(0)).alias("feature"), good.alias("counts"), "ordinal"), names[1:], feature_name=names[0])


def _cells(m: FeatureMatrix, counts: str, whole: bool) -> list:
    value = (lambda i: F.floor(F.get(counts, F.lit(i)) + 0.5).cast("long")) if whole else (lambda i: F.get(counts, F.lit(i)))
    return [value(i).alias(s) for i, s in enumerate(m.samples)]


def wide(m: FeatureMatrix, whole: bool = False, *first: Column | str) -> DataFrame:
    """The matrix with a column for each sample, after the feature and further ones; whole: counts rounded half up."""
    if len(set(m.samples)) < len(m.samples):
        raise ValueError("two samples have one name, and a table can't have two columns of it")
    return m.df.select(F.col("feature").alias(m.feature_name), *first, *_cells(m, "counts", whole))


def write_counts(m: FeatureMatrix, path: str, whole: bool = True, compression: str | None = None) -> None:
    writer = wide(m, whole).write.option("sep", "\t").option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


PAGE_ROWS = 200  # rows of a page of an index, which is what a lookup reads at least


def keyed(m: FeatureMatrix) -> DataFrame:
    """The rows of a matrix of k-mers with code (two bits a base) and mini (their minimiser)."""
    return m.df.withColumn("code", seq.encode(F.col("feature"), m.k)).withColumn("mini", superkmers.minimiser_column(F.col("code"), m.k))


def write_index(m: FeatureMatrix, path: str) -> None:
    """Store the matrix: features as Parquet, metadata as one line of JSON.

    K-mers are stored with their codes in ranges of (minimiser, code), in small pages with their bounds: neighbouring k-mers of a
    sequence mostly lie side by side, so a lookup of a sequence reads a few pages. Other matrices keep their order.
    """
    if m.k:
        rows = keyed(m).repartitionByRange("mini", "code").sortWithinPartitions("mini", "code")
        rows.write.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", False).parquet(f"{path}/features")
    else:
        m.df.write.parquet(f"{path}/features")
    meta = json.dumps({"samples": m.samples, "k": m.k, "stranded": m.stranded, "nf": m.nf, "feature_name": m.feature_name})
    m.df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def write_buckets(m: FeatureMatrix, name: str, buckets: int) -> FeatureMatrix:
    """Store a matrix of k-mers as a table in buckets of their codes: joins on the code with it move the other side alone."""
    if not m.k:
        raise ValueError("buckets need a matrix of k-mers")
    keyed(m).write.bucketBy(buckets, "code").sortBy("code").saveAsTable(name)
    return m.with_df(m.df.sparkSession.table(name))


def read_index(spark: SparkSession, path: str) -> FeatureMatrix:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return FeatureMatrix(spark.read.parquet(f"{path}/features"), **meta)
