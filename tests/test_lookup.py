"""Lookups in stored indexes: what is read, and that results are those of a scan."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom import sources
from tallyloom.functions import seq, superkmers
from tallyloom.matrix import FeatureMatrix
from tallyloom.operators import mask
from tests.test_operators import matrix, rc


def bytes_read(spark, work):
    """Bytes that file systems report while work runs; vectored reads of several ranges at once aren't reported, so they are off."""
    every = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.hadoop.vectored.io.enabled", "false")
    try:
        before = every()
        result = work()
        return every() - before, result
    finally:
        conf.unset("parquet.hadoop.vectored.io.enabled")


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """An index of 150,000 k-mers of one long sequence, and the sequence."""
    rng = np.random.default_rng(7)
    bases = rng.integers(0, 4, 150_030).astype(np.uint8)
    codes = seq._codes(bases, 31)
    codes = np.minimum(codes, superkmers.flipped(codes, 31))
    df = spark.createDataFrame(pd.DataFrame({"code": codes})).select(seq.decode(F.col("code"), 31).alias("feature"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.abs(F.xxhash64("code", i)) / 1e9).alias("counts"))
    path = str(tmp_path_factory.mktemp("index") / "i")
    sources.write_index(FeatureMatrix(df, [f"s{i}" for i in range(20)], 31, False), path)
    return sources.read_index(spark, path), "".join("ACGT"[b] for b in bases)


def test_a_lookup_reads_a_twentieth(spark, big):
    m, whole = big
    asked = spark.createDataFrame([("x", whole[70_000:70_080]), ("none", "ACGT" * 20)], "name string, seq string")
    every, _ = bytes_read(spark, lambda: m.df.agg(F.sum(F.size("counts")), F.max(F.get("counts", F.lit(19))), F.max("feature"), F.max("code"), F.max("mini")).collect())
    few, got = bytes_read(spark, lambda: mask.query(m, asked, "mean", True).collect())
    assert few * 20 < every
    plain = FeatureMatrix(m.df.select("feature", "counts"), m.samples, 31, False)
    assert sorted(map(str, got)) == sorted(map(str, mask.query(plain, asked, "mean", True).collect()))
    assert {r["name"]: r["n_hits"] for r in got} == {"x": 50, "none": 0}
    few, got = bytes_read(spark, lambda: mask.mask(m, asked).df.select("feature", "counts").collect())
    assert few * 10 < every and {r["feature"] for r in got} == {min(whole[i : i + 31], rc(whole[i : i + 31])) for i in range(70_000, 70_050)}
    plan = mask.mask(m, asked).df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(mini," in plan


def test_same_results_by_any_way(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    kmers = {min(s, rc(s)) for s in ("".join(rng.choice("ACGT") for _ in range(9)) for _ in range(200))}
    m = matrix(spark, {s: [float(i), 1.0] for i, s in enumerate(sorted(kmers))}, k=9, stranded=False)
    sources.write_index(m, str(tmp_path / "i"))
    stored = sources.read_index(spark, str(tmp_path / "i"))
    bucketed = sources.write_buckets(m, "kmers_in_buckets", 4)
    some = sorted(kmers)[::7]
    asked = spark.createDataFrame([(str(i), s if i % 2 else rc(s)) for i, s in enumerate(some)] + [("gone", "TTTTTTTTT"), ("short", "A"), ("null", None)], "name string, seq string")
    want = {s: v for s, v in ((r["feature"], r["counts"]) for r in m.df.collect()) if s in some}
    rest = kmers - set(some)
    assert rest == {r["feature"] for r in mask.mask(m, suppress=asked).df.collect()}
    for limit in (mask.MAX_MINIMISERS, 3):
        monkeypatch.setattr(mask, "MAX_MINIMISERS", limit)
        for x in (m, stored, bucketed):
            assert {r["feature"]: r["counts"] for r in mask.mask(x, asked).df.collect()} == want
            assert {r["feature"] for r in mask.mask(x, suppress=asked).df.collect()} == rest
            found = {r["name"]: r["counts"] for r in mask.query(x, asked, "median").collect()}
            assert found == {str(i): want[s] for i, s in enumerate(some)}
    assert mask.query(stored, asked.where("name = 'short'")).count() == 0
    with pytest.raises(ValueError):
        sources.write_buckets(matrix(spark, {"a": [1.0]}), "other", 2)


def test_buckets_stay_where_they_are(spark):
    rng = random.Random(2)
    m = sources.write_buckets(matrix(spark, {"".join(rng.choice("ACGT") for _ in range(12)): [1.0] for _ in range(300)}, k=12), "kmers_that_stay", 4)
    asked = spark.createDataFrame([("x", "".join(rng.choice("ACGT") for _ in range(4000)))], "name string, seq string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mask.mask(m, suppress=asked).df._jdf.queryExecution().sparkPlan().toString() and mask.mask(m, suppress=asked).df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("LeftAnti") :]
    matrix_side = join[: join.index("kmers_that_stay")]
    assert "Exchange" not in matrix_side and "Bucketed: true" in join
