"""Feature matrices made from the driver's tables, each with its SQL (dense long form: feature, sample_idx, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq, superkmers
from ..matrix import FeatureMatrix, from_long

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
N = 20
DAYS = 31
LABELS = [0] * 10 + [1] * 10
THREE = [i % 3 for i in range(N)]
STATUS = ["DOWN"] * 10 + ["UP"] * 10


def names(n: int = N) -> list[str]:
    return [f"S{i:02d}" for i in range(n)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small file is one partition, a large table needs no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def parts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of parts by order number modulo 20."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    return line.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature"), (F.col("l_orderkey") % N).cast("int").alias("sample_idx")).agg(F.sum("l_quantity").cast("double").alias("cnt"))


def parts(spark: SparkSession, sf_dir: str) -> FeatureMatrix:
    return from_long(parts_long(spark, sf_dir), names())


PARTS_SQL = f"""g AS (SELECT concat('P', CAST(l_partkey AS varchar)) feature, CAST(l_orderkey % {N} AS int) sample_idx, CAST(sum(l_quantity) AS double) cnt FROM lineitem GROUP BY 1, 2),
d AS (SELECT f.feature, CAST(s.i AS int) sample_idx, coalesce(g.cnt, 0.0) x FROM (SELECT DISTINCT feature FROM g) f CROSS JOIN range({N}) s(i) LEFT JOIN g ON g.feature = f.feature AND g.sample_idx = s.i)"""


def users(spark: SparkSession, sf_dir: str) -> FeatureMatrix:
    """Events of users by day of the month."""
    e = table(spark, sf_dir, "events")
    return from_long(e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("feature"), (F.dayofmonth("ts") - 1).alias("sample_idx")).agg(F.count(F.lit(1)).cast("double").alias("cnt")), names(DAYS))


USERS_SQL = f"""g AS (SELECT concat('U', CAST(user_id AS varchar)) feature, CAST(day(ts) - 1 AS int) sample_idx, CAST(count(*) AS double) cnt FROM events GROUP BY 1, 2),
d AS (SELECT f.feature, CAST(s.i AS int) sample_idx, coalesce(g.cnt, 0.0) x FROM (SELECT DISTINCT feature FROM g) f CROSS JOIN range({DAYS}) s(i) LEFT JOIN g ON g.feature = f.feature AND g.sample_idx = s.i)"""


def dna(text: Column) -> Column:
    """Text as a sequence: letters to bases, the rest dropped."""
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, BASES), "[^ACGT]", "")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, seq of all documents; the source is the sample."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    return docs.select(F.substring("source", 4, 9).cast("int").alias("sample_idx"), dna(F.col("text")).alias("seq"))


def kmers(spark: SparkSession, sf_dir: str, k: int = 13, stranded: bool = False) -> FeatureMatrix:
    """K-mers that occur in three samples or more; sequences are written out at the end."""
    cells = superkmers.vectors(reads(spark, sf_dir), "seq", "sample_idx", k, not stranded, N, 3)
    return FeatureMatrix(cells.select(seq.decode(F.col("code"), k).alias("feature"), "counts"), names(), k, stranded)


def dna_sql(column: str = "text") -> str:
    return f"regexp_replace(translate(lower({column}), '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g')"


def windows_sql(source: str, k: int, keep: str, canonical: bool = True) -> str:
    """SELECT of `keep` and feature over all windows of source's column dna."""
    w = "least(w, translate(reverse(w), 'ACGT', 'TGCA'))" if canonical else "w"
    return f"SELECT {keep}, {w} feature FROM (SELECT {keep}, substr(dna, CAST(i AS int), {k}) w FROM (SELECT {keep}, dna, unnest(range(1, length(dna) - {k} + 2)) i FROM {source} WHERE length(dna) >= {k}))"


def kmers_sql(k: int = 13, stranded: bool = False) -> str:
    return f"""src AS (SELECT CAST(substr(source, 4) AS int) sample_idx, {dna_sql()} dna FROM documents),
w AS ({windows_sql("src", k, "sample_idx", not stranded)}),
l AS (SELECT feature, sample_idx, CAST(count(*) AS double) cnt FROM w GROUP BY 1, 2),
g AS (SELECT feature, sample_idx, cnt FROM (SELECT *, count(*) OVER (PARTITION BY feature) ns FROM l) WHERE ns >= 3),
d AS (SELECT f.feature, CAST(s.i AS int) sample_idx, coalesce(g.cnt, 0.0) x FROM (SELECT DISTINCT feature FROM g) f CROSS JOIN range({N}) s(i) LEFT JOIN g ON g.feature = f.feature AND g.sample_idx = s.i)"""


def sequences(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """name, seq of all texts of a table."""
    return spread(table(spark, sf_dir, name).select(key, "text")).select(F.col(key).cast("string").alias("name"), dna(F.col("text")).alias("seq"))


def query_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items, and one sequence that no matrix holds."""
    return sequences(spark, sf_dir, "benchmark", "item_id").union(spark.createDataFrame([("absent", "ACGT" * 13)], "name string, seq string"))


QUERY_SQL = f"q AS (SELECT CAST(item_id AS varchar) name, {dna_sql()} dna FROM benchmark UNION ALL SELECT 'absent', repeat('ACGT', 13))"


def mask_sql(name: str, source: str, k: int) -> str:
    return f"{name}_src AS (SELECT {dna_sql()} dna, 1 one FROM {source}), {name} AS (SELECT DISTINCT feature FROM ({windows_sql(f'{name}_src', k, 'one')}))"
