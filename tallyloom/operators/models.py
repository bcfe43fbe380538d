"""Penalised models of samples by features: cross-validated paths, stability selection, ridge on the largest coefficients.

The design (samples by the features of a selection) is gathered behind a check of its size and broadcast; folds and resamples are rows of a
DataFrame, fitted in Arrow tasks. Designs beyond MAX_CELLS are for tools.fit_model, which keeps features distributed by sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import penalised
from ..matrix import FeatureMatrix

MAX_CELLS = 1 << 24  # 128 MB
FITS_AT_ONCE = 64
ALPHA = {"lasso": 1.0, "elasticnet": 0.5, "ridge": 0.0}


@dataclass(frozen=True)
class Design:
    features: list[str]
    x: np.ndarray  # samples by features
    y: np.ndarray  # 0 or 1

    def of(self, features: list[str]) -> Design:
        at = {f: i for i, f in enumerate(self.features)}
        return Design(features, self.x[:, [at[f] for f in features]], self.y)


def design(m: FeatureMatrix, labels: list[int]) -> Design:
    """The matrix with samples as rows, features in order of their names; raises beyond MAX_CELLS, and without two classes."""
    if set(labels) != {0, 1}:
        raise ValueError("a model needs samples of the classes 0 and 1")
    n = m.df.count()
    if n * len(labels) > MAX_CELLS:
        raise ValueError(f"{n} features of {len(labels)} samples are too many for one design: select features first")
    rows = m.df.select("feature", "counts").orderBy("feature").toArrow()
    x = rows["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(labels)).T if n else np.zeros((len(labels), 0))
    return Design(rows["feature"].to_pylist(), np.ascontiguousarray(x), np.array(labels, float))


def cv_deviances(spark: SparkSession, d: Design, path: np.ndarray, alpha: float, folds: int) -> DataFrame:
    """sample, step (of the path), deviance: of every sample under the fit without its fold (place modulo folds)."""
    kept = spark.sparkContext.broadcast((d.x, d.y, path))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, steps = kept.value
        fold = np.arange(len(y)) % folds
        for batch in batches:
            for f in batch.column(0).to_pylist():
                b, b0 = penalised.fits(x, y, (fold != f).astype(float)[None], steps, alpha, enough=1.0)
                test = np.flatnonzero(fold == f)
                dev = penalised.deviances(x[test], y[test], b[:, 0], b0[:, 0])
                step, sample = np.indices(dev.shape)
                yield pa.RecordBatch.from_arrays([pa.array(test[sample.reshape(-1)]), pa.array(step.reshape(-1)), pa.array(dev.reshape(-1))], names=["sample", "step", "deviance"])

    return spark.range(folds).repartition(folds, "id").mapInArrow(fit, "sample long, step long, deviance double")


def cross_validation(spark: SparkSession, d: Design, alpha: float, folds: int = 10, steps: int = 100) -> DataFrame:
    """step, penalty, nonzero, mean, sd, chosen: mean deviance left out and its standard error along the path.

    chosen: the largest penalty whose mean is within one standard error of the least. Errors are among folds (weighted by size), or among
    samples where folds have fewer than three.
    """
    path = penalised.penalties(d.x, d.y, alpha, steps)
    b, _ = penalised.fits(d.x, d.y, np.ones((1, len(d.y))), path, alpha)
    path = path[: len(b)]
    dev = cv_deviances(spark, d, path, alpha, folds)
    unit = F.col("sample") if len(d.y) < 3 * folds else F.col("sample") % folds
    per = dev.groupBy("step", unit.alias("unit")).agg(F.avg("deviance").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    sums = per.groupBy("step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("u"))
    mean = F.col("s") / F.col("n")
    each = sums.select("step", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) / (F.col("u") - 1)).alias("sd"))
    about = spark.createDataFrame([(i, float(v), int((b[i, 0] != 0).sum())) for i, v in enumerate(path)], "step long, penalty double, nonzero long")
    least = each.agg(F.min(F.struct("mean", "sd")).alias("m")).select((F.col("m.mean") + F.col("m.sd")).alias("most")).first()["most"]
    first = each.where(F.col("mean") <= least).agg(F.min("step")).first()[0]
    return about.join(each, "step").withColumn("chosen", F.col("step") == first)


def stability(spark: SparkSession, d: Design, penalty: float, alpha: float, runs: int = 2000, seed: int = 0) -> DataFrame:
    """feature, share: in how many of `runs` resamples of three quarters of the samples it has a coefficient; nothing is standardised there."""
    kept = spark.sparkContext.broadcast((d.x, d.y, np.array(d.features, object)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, names = kept.value
        for batch in batches:
            every = batch.column(0).to_pylist()
            for at in range(0, len(every), FITS_AT_ONCE):
                w = np.stack([penalised.drawn(len(y), run, seed) for run in every[at : at + FITS_AT_ONCE]])
                b, _ = penalised.fits(x, y, w, np.array([penalty]), alpha, standardise=False)
                n = (b[0] != 0).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(names[n > 0].tolist(), pa.string()), pa.array(n[n > 0])], names=["feature", "n"])

    parts = max(1, min(runs // FITS_AT_ONCE, spark.sparkContext.defaultParallelism))
    found = spark.range(0, runs, 1, parts).mapInArrow(fit, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return found.select("feature", (F.col("n") / runs).alias("share"))


@dataclass(frozen=True)
class Model:
    features: list[str]
    coefficients: list[float]
    intercept: float
    penalty: float

    def table(self, spark: SparkSession) -> DataFrame:
        """feature, coefficient; the intercept under a null name."""
        return spark.createDataFrame([(None, self.intercept), *zip(self.features, self.coefficients, strict=True)], "feature string, coefficient double")

    def predict(self, m: FeatureMatrix) -> DataFrame:
        """sample_idx, prob_1, pred_class of a matrix's samples; features that it lacks count as 0."""
        b = self.table(m.df.sparkSession).where("feature is not null and coefficient <> 0")
        weighted = m.df.join(b, "feature").select(F.posexplode(F.transform("counts", lambda c: c * F.col("coefficient"))).alias("sample_idx", "v"))
        every = m.df.sparkSession.range(len(m.samples)).select(F.col("id").cast("int").alias("sample_idx"))
        eta = every.join(weighted.groupBy("sample_idx").agg(F.sum("v").alias("v")), "sample_idx", "left").withColumn("eta", F.coalesce("v", F.lit(0.0)) + self.intercept)
        return eta.select("sample_idx", (1 / (1 + F.exp(-F.col("eta")))).alias("prob_1"), F.when(F.col("eta") > 0, 1).otherwise(0).alias("pred_class"))


def fit_path(spark: SparkSession, d: Design, alpha: float, folds: int = 10, steps: int = 100) -> Model:
    """The fit of all samples at the penalty that cross-validation chooses."""
    if not d.features:
        y = d.y.mean()
        return Model([], [], float(np.log(y / (1 - y))), 0.0)
    chosen = cross_validation(spark, d, alpha, folds, steps).where("chosen").first()
    path = penalised.penalties(d.x, d.y, alpha, steps)[: chosen["step"] + 1]
    b, b0 = penalised.fits(d.x, d.y, np.ones((1, len(d.y))), path, alpha, enough=1.0)
    return Model(d.features, [float(v) for v in b[-1, 0]], float(b0[-1, 0]), float(path[-1]))


def fit_model(m: FeatureMatrix, labels: list[int], kind: str, runs: int = 2000, threshold: float = 0.5, folds: int = 10, seed: int = 0) -> Model:
    """lasso or elasticnet: a path over the features that at least a share `threshold` of the resamples selects; ridge: over all."""
    if kind not in ALPHA:
        raise ValueError(f"unknown model {kind!r}: one of {', '.join(ALPHA)}")
    spark, d, alpha = m.df.sparkSession, design(m, labels), ALPHA[kind]
    if kind == "ridge":
        return fit_path(spark, d, alpha, folds)
    first = fit_path(spark, d, alpha, folds)
    stable = {r["feature"] for r in stability(spark, d, first.penalty, alpha, runs, seed).where(F.col("share") >= threshold).collect()}  # the design's features at most
    return fit_path(spark, d.of([f for f in d.features if f in stable]), alpha, folds)


def fit_top_ridge(m: FeatureMatrix, labels: list[int], top: int, folds: int = 10) -> Model:
    """Ridge, and ridge again on the features with the largest absolute coefficients (ties by name)."""
    spark, d = m.df.sparkSession, design(m, labels)
    first = fit_path(spark, d, 0.0, folds)
    best = sorted(zip(first.features, first.coefficients, strict=True), key=lambda x: (-abs(x[1]), x[0]))[:top]
    return fit_path(spark, d.of(sorted(f for f, _ in best)), 0.0, folds)
