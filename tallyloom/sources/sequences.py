"""FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise, numbered


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of each record; lines of a sequence are joined and upper-cased, the last line needs no end.

    A record begins with > at a line's start; one inside a header is part of the name. Records of one name stay apart.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    lines = F.split("value", "\r?\n", 2)
    return records.select(F.trim(F.get(lines, F.lit(0))).alias("name"), F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", "")).alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0 within the file), value of text files, which are read in splits.

    A line's number is its place in its split and the sizes of its file's splits before it: a row for each split.
    """
    split = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    kept = materialise(split, "lines")
    sizes = kept.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(starts, ["file", "_block"]).select("file", (F.col("_start") + F.col("_id") - F.col("_first")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of records of four lines: @ and the name, the sequence, + and the quality. Files of any size are read in splits."""
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    at = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(f"l{i}")
    four = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(*(at(i) for i in range(4)))
    whole = four.where(F.col("l0").startswith("@") & F.col("l2").startswith("+") & F.col("l3").isNotNull())
    return whole.select(F.substring(F.col("l0"), F.lit(2), F.length("l0")).alias("name"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def in_input_order(df: DataFrame, name: str = "number") -> DataFrame:
    """df with each row's number in the order of the matrix's input (column ordinal), or without that of the features."""
    return numbered(df, [F.col("ordinal" if "ordinal" in df.columns else "feature").asc()], name)


def write_fasta(df: DataFrame, path: str, prefix: str = "feature", score: str | None = None) -> None:
    """Records >prefix_i of column feature, in files that follow each other in order of i, with ",score=" where a column is named.

    i is column number where there is one, else the row's number, from 0, in_input_order.
    """
    placed = df if "number" in df.columns else in_input_order(df)
    title = F.concat(F.lit(f">{prefix}_"), F.col("number").cast("string"), F.concat(F.lit(",score="), F.col(score).cast("string")) if score else F.lit(""))
    placed.orderBy("number").select(F.concat(title, F.lit("\n"), F.col("feature")).alias("value")).write.text(path)
