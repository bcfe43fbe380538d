"""Sequence and vector functions against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import classify, seq, student_t, vec
from tallyloom.matrix import FeatureMatrix


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def arr(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_sequences(spark):
    assert one(spark, seq.revcomp(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, seq.canonical(F.lit("TTTG"))) == "CAAA"
    rng = random.Random(1)
    for k in (1, 5, 13, 31):
        s = "".join(rng.choice("ACGT") for _ in range(k))
        code = one(spark, seq.encode(F.lit(s), k))
        assert code == int("".join(str("ACGT".index(c)) for c in s), 4)
        assert one(spark, seq.decode(F.lit(code), k)) == s
    assert one(spark, seq.decode(seq.encode(F.lit("AAAA"), 4), 4)) == "AAAA" and one(spark, seq.encode(F.lit("T" * 31), 31)) == 4**31 - 1
    with pytest.raises(ValueError):
        seq.encode(F.lit("A"), 32)


def test_windows_over_chunk_borders(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 12, 13, 14, 255, 256, 257, 268, 269, 1000)] + ["ACGTNACGTACGTACGTACGT"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, seq string")
    got = sorted((r["i"], r["kmer"]) for r in seq.windows(df, "seq", 13).collect())
    assert got == sorted((i, t[j : j + 13]) for i, t in enumerate(texts) for j in range(len(t) - 12) if set(t[j : j + 13]) <= set("ACGT"))


@pytest.mark.parametrize("k", [1, 2, 3, 13, 16, 30, 31])
def test_window_codes(spark, k, monkeypatch):
    """Codes against plain Python, with further columns, lower case, other letters, nulls, and pieces smaller than the batch."""
    monkeypatch.setattr(seq, "CHUNK_BASES", 64)
    rng = random.Random(k)
    rows = [(i, f"n{i}", None if i == 3 else "".join(rng.choice("ACGTacgtN") if rng.random() < 0.02 else rng.choice("ACGT") for _ in range(rng.randint(0, 150)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, name string, seq string")
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    code = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
    for canonical in (False, True):
        got = sorted(map(tuple, seq.window_codes(df, "seq", k, canonical).collect()))
        windows = [(i, n, t.upper()[j : j + k]) for i, n, t in rows for j in range(len(t or "") - k + 1) if set(t.upper()[j : j + k]) <= set("ACGT")]
        assert got == sorted((i, n, min(code(w), code(flip(w))) if canonical else code(w)) for i, n, w in windows)


def test_average_ranks(spark):
    assert one(spark, vec.ranks(arr([4, 0, 4, 7, 1, 4]))) == [3, 0, 3, 5, 1, 3]


def test_statistics_and_distances(spark):
    rng = random.Random(3)
    for n in (2, 5, 20):
        x, y = [rng.randint(0, 9) for _ in range(n)], [rng.randint(1, 9) + rng.random() for _ in range(n)]
        assert math.isclose(one(spark, vec.sd(arr(x))), statistics.stdev(x), abs_tol=1e-12)
        assert one(spark, vec.median(arr(x))) == statistics.median(x)
        want = np.corrcoef(x, y)[0, 1] if len(set(x)) > 1 else 0.0
        assert math.isclose(one(spark, vec.pearson(arr(x), arr(y))), want, abs_tol=1e-9)
        assert math.isclose(one(spark, vec.mac(arr(x), arr(y))), sum(abs(a - b) / (a + b) for a, b in zip(x, y)) / n, abs_tol=1e-12)
    assert one(spark, vec.pearson(arr([0.1] * 7), arr(range(7)))) == 0.0
    assert one(spark, vec.spearman(arr([1, 2, 3]), arr([10, 100, 1000]))) == pytest.approx(1.0)
    assert one(spark, vec.mac(arr([0, 0]), arr([0, 4]))) == 0.5
    assert one(spark, vec.half_up(arr([0.5, 1.49, 2.5]))) == [1, 1, 3]
    assert one(spark, vec.mean(F.array().cast("array<double>"))) is None


def test_student_t():
    # one degree of freedom is Cauchy's, two has a closed form
    for t in (0.0, 0.3, 1.0, 5.0, 40.0):
        assert math.isclose(student_t.two_sided_tail([t], [1.0])[0], 1 - 2 * math.atan(t) / math.pi, rel_tol=1e-10, abs_tol=1e-14)
        assert math.isclose(student_t.two_sided_tail([t], [2.0])[0], 1 - t / math.sqrt(2 + t * t), rel_tol=1e-9, abs_tol=1e-12)
    assert math.isclose(student_t.two_sided_tail([2.262157], [9.0])[0], 0.05, rel_tol=1e-5)


@pytest.mark.parametrize("method", ["lr", "bayes", "svm"])
@pytest.mark.parametrize("folds", [0, 1, 5])
def test_classifiers(method, folds):
    rng = np.random.default_rng(4)
    y = np.arange(40) % 2
    apart, mixed, constant = y * 10 + rng.normal(size=40), rng.normal(size=40), np.ones(40)
    acc = classify.accuracy(np.stack([apart, mixed, constant]), y, method, folds)
    assert acc[0] == 1.0 and 0.2 <= acc[1] <= 0.8 and acc[2] <= 0.55
    if method != "lr":
        three = np.arange(42) % 3
        assert classify.accuracy((three * 20 + rng.normal(size=42))[None, :], three, method, 1)[0] > (0.95 if method == "bayes" else 0.6)


def test_ranks_of_long_rows(spark):
    rng = random.Random(3)
    rows = [[float(rng.randint(0, 40)) for _ in range(1000)], [rng.random() for _ in range(1000)], [5.0] * 1000, [1.0], [], [2.0, -0.5, 2.0]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<double>").select("i", vec.ranks(F.col("c")).alias("r"), vec.argsort(F.col("c")).alias("a")).collect()
    for r in got:
        x = np.array(rows[r["i"]])
        assert r["r"] == [float((x < v).sum() + ((x == v).sum() - 1) / 2) for v in x]
        assert r["a"] == np.argsort(x, kind="stable").tolist()


def test_column_sums_add_vectors(spark):
    from tallyloom.operators import index

    m = FeatureMatrix(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, None]), ("c", None)], "feature string, counts array<double>").repartition(3), ["x", "y"])
    assert {tuple(r) for r in index.column_sums(m).collect()} == {(0, 4.0), (1, 2.0)}
    assert "Generate" not in index.column_sums(m)._jdf.queryExecution().executedPlan().toString()
    assert index.column_sums(m.with_df(m.df.limit(0))).count() == 0
