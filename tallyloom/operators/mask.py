"""Selecting and suppressing sequence features by the k-mers of sequences, and looking sequences up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import medians, seq, superkmers
from ..matrix import FeatureMatrix
from ..storage import materialise

MAX_MINIMISERS = 500


def kmer_codes(sequences: DataFrame, k: int, stranded: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Codes of all k-mers of column seq (canonical if unstranded), repeats kept, with the columns named in `keep`."""
    return seq.window_codes(sequences.select(*keep, "seq"), "seq", k, not stranded)


def _any_of(column: str, values: list[int]) -> Column:
    """column is one of the values, as a balanced tree of comparisons: a reader prunes by each, where a long list becomes one range."""
    if len(values) == 1:
        return F.col(column) == values[0]
    half = len(values) // 2
    return _any_of(column, values[:half]) | _any_of(column, values[half:])


def near(df: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """The rows of a stored index among whose pages k-mers (column code) can be, where these have MAX_MINIMISERS minimisers at most; else all."""
    if "mini" not in df.columns:
        return df
    found = codes.select(superkmers.minimiser_column(F.col("code"), k).alias("mini")).distinct().limit(MAX_MINIMISERS + 1).collect()
    if len(found) > MAX_MINIMISERS:
        return df
    return df.where(_any_of("mini", sorted(r["mini"] for r in found))) if found else df.limit(0)


def _joined(df: DataFrame, codes: DataFrame, k: int, how: str) -> DataFrame:
    """df joined with rows of k-mer codes (and what else they have): on the code where it is stored, else on the k-mer."""
    if "code" in df.columns:
        return df.join(codes, "code", how)
    return df.join(codes.withColumn("feature", seq.decode(F.col("code"), k)).drop("code"), "feature", how)


def mask(m: FeatureMatrix, select: DataFrame | None = None, suppress: DataFrame | None = None) -> FeatureMatrix:
    """Keep features among the k-mers of `select` (if given) and not among those of `suppress` (if given).

    Both are joins on the k-mer, whose size Spark looks at before it broadcasts. Of a stored index, selecting reads the pages that can hold the k-mers.
    """
    if not m.k:
        raise ValueError("masking needs a matrix of k-mers")
    df = m.df
    for sequences, how in ((select, "left_semi"), (suppress, "left_anti")):
        if sequences is None:
            continue
        wanted = kmer_codes(sequences, m.k, m.stranded).distinct()
        if how == "left_semi" and wanted.isEmpty():
            raise ValueError("no k-mers to select")
        df = _joined(near(df, wanted, m.k) if how == "left_semi" else df, wanted, m.k, how)
    return m.with_df(df)


def query(m: FeatureMatrix, sequences: DataFrame, how: str = "mean", with_absent: bool = False, key: str = "name") -> DataFrame:
    """Counts of sequence records: for each, the mean or median over its k-mers that the matrix has, repeats counted.

    Returns key, n_hits, counts, a row for each record: records of one name are told apart. Those without a hit are left
    out, or have zeros with with_absent. Only the records' k-mers meet the matrix; their vectors are added up before the shuffle for means.
    """
    if how not in ("mean", "median"):
        raise ValueError(f"unknown aggregation {how!r}")
    records = materialise(sequences.select(key, "seq").withColumn("_record", F.monotonically_increasing_id()), "records")
    codes = kmer_codes(records, m.k, m.stranded, ("_record",))
    keys = [c for c in ("code", "mini") if c in m.df.columns] or ["feature"]
    hits = _joined(near(m.df.select(*keys, "counts"), codes, m.k), codes, m.k, "inner")
    each = hits.select("_record", "counts")
    vectors = (medians.group_medians(each, "_record", len(m.samples)) if how == "median" else medians.group_means(each, "_record")).withColumnRenamed("n", "n_hits")
    found = records.select("_record", key).join(vectors, "_record", "left" if with_absent else "inner")
    zeros = F.array_repeat(F.lit(0.0), len(m.samples))
    return found.select(key, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("counts", zeros).alias("counts"))
