"""Indexing: normalisation factors, normalised counts, sequence checks."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..matrix import FeatureMatrix

log = logging.getLogger(__name__)


def column_sums(m: FeatureMatrix) -> DataFrame:
    """sample_idx, total: every task adds up its rows' vectors, and one number for each sample and task crosses the shuffle.

    A matrix without rows has no totals. Missing counts add nothing.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                part = rows.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["sample_idx", "part"])

    return m.df.select("counts").mapInArrow(add, "sample_idx int, part double").groupBy("sample_idx").agg(F.sum("part").alias("total"))


def factors(m: FeatureMatrix, base: float) -> DataFrame:
    """sample_idx, nf = base / column sum (null where the sum is 0)."""
    return column_sums(m).select("sample_idx", F.when(F.col("total") != 0, F.lit(float(base)) / F.col("total")).alias("nf"))


def compute_nf(m: FeatureMatrix, base: float) -> list[float]:
    """The factors in the columns' order; a column without counts raises, odd ones are logged."""
    got = {r["sample_idx"]: r["nf"] for r in factors(m, base).collect()}  # one row for each sample
    out = [got.get(i) for i in range(len(m.samples))]
    if None in out:
        raise ValueError(f"sample {m.samples[out.index(None)]} has no counts")
    if any(not 0.1 <= x <= 1000 for x in out):
        log.warning("some normalisation factors lie outside 0.1 to 1000")
    return out


def normalise(m: FeatureMatrix, nf: list[float], single_precision: bool = False) -> FeatureMatrix:
    """Counts times their sample's factor; single_precision stores what a 32-bit float holds."""
    if len(nf) != len(m.samples):
        raise ValueError("one factor for each sample is needed")
    scaled = F.zip_with("counts", F.array(*(F.lit(float(x)) for x in nf)), lambda c, f: (c * f).cast("float").cast("double") if single_precision else c * f)
    return replace(m, df=m.df.withColumn("counts", scaled), nf=list(nf))


def index_sequences(m: FeatureMatrix, k: int, stranded: bool = True, check_unique: bool = True) -> FeatureMatrix:
    """A matrix of k-mers: every feature must have k letters of ACGT and, canonical if unstranded, occur once."""
    if not 0 < k <= 31:
        raise ValueError("k must lie between 1 and 31")
    s = F.upper("feature")
    sound = F.when(s.rlike(f"^[ACGT]{{{k}}}$"), seq.oriented(s, stranded)).otherwise(F.raise_error(F.concat(F.lit(f"not a {k}-mer: "), F.col("feature"))))
    out = replace(m, df=m.df.withColumn("feature", sound), k=k, stranded=stranded)
    if check_unique and (twice := repeated(out).first()):
        raise ValueError(f"k-mer {twice['feature']} occurs {twice['n']} times")
    return out


def repeated(m: FeatureMatrix) -> DataFrame:
    """Features that occur more than once, with their number."""
    return m.df.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
