"""The first pass of merging in buckets: the same contigs as by joints in tables, and little that is moved."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import paths, seq, unitigs, vec
from tallyloom.operators import merge
from tallyloom.storage import materialise
from tests.test_operators import matrix, rc


@pytest.mark.parametrize("method", ["pearson", "spearman", "mac"])
def test_distances_are_those_of_columns(spark, method):
    rng = np.random.default_rng(3)
    x, y = (np.concatenate([rng.integers(0, 4, (150, 6)), rng.integers(0, 2, (150, 6)) * 0.1, rng.random((100, 6)) * 1e9]).astype(float) for _ in range(2))
    x[0], y[1], x[2], y[2] = 0, 3, 0, 0
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x array<double>, y array<double>")
    of = dict(df.select("i", vec.DISTANCES[method](F.col("x"), F.col("y"))).collect())
    assert [of[i] for i in range(len(x))] == [None if np.isnan(d) else d for d in unitigs.DISTANCES[method](x, y).tolist()]


def by_tables(m, values, rep_mode, method, threshold):
    """The same level by a row for each joint and k-mer."""
    contigs = materialise(merge.seeds(m, values), "test")
    edges = materialise(merge.agreeing(merge.joints(contigs, m.k - 1, m.k, m.stranded), merge.coded_counts(m), method, threshold), "test")
    ranked = merge._ranked(edges, m.k - 1, m.stranded)
    joined, made = merge.contract(contigs, ranked, merge._representatives(contigs, ranked, m.stranded, rep_mode), m.k - 1, m.k, 1)
    return merge.written_out(materialise(joined, "test"), [materialise(made, "test")], m.k).withColumn("rep", seq.decode(F.col("code"), m.k))


def rows(df):
    return sorted((r["contig"], r["nb_merged"], r["rep"], str(r["rep_value"]), r["members"]) for r in df.collect())


@pytest.mark.parametrize("k,stranded,rep_mode,method,one_task", [(9, False, "min", None, 1 << 20), (8, False, "maxabs", "mac", 20), (9, True, "min", None, 20), (8, True, "max", "pearson", 1 << 20)])
def test_small_buckets_give_the_same(spark, monkeypatch, k, stranded, rep_mode, method, one_task):
    """Paths and cycles through many buckets, hot minimisers, equal values, values that are null or no number, and a test."""
    rng = random.Random(k + 10 * stranded)
    kmers = {"A" * k, "ACGT" * 2 + "A" * (k - 8)}
    for n in range(24):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(k, 5 * k)))
        s = s + s[: k - 1] if n % 2 else s  # every other one is a ring
        kmers |= {s[i : i + k] for i in range(len(s) - k + 1)}
    kmers = kmers if stranded else {min(x, rc(x)) for x in kmers}
    counts = {s: [float(rng.randint(1, 3)) for _ in range(3)] for s in sorted(kmers)}
    m = matrix(spark, counts, k=k, stranded=stranded)
    values = None
    if rep_mode != "min":
        values = spark.createDataFrame([(s, rng.choice([None, float("nan"), 1.0, -1.0, 2.0, 3.0, -3.0, -0.0])) for s in sorted(kmers)], "feature string, value double")
    want = rows(by_tables(m, values, rep_mode, method, 0.5))
    monkeypatch.setattr(unitigs, "BUCKET_KMERS", 12)
    monkeypatch.setattr(unitigs, "HOT", 14)
    monkeypatch.setattr(paths, "ONE_TASK", one_task)
    cut = []
    monkeypatch.setattr(unitigs, "opened", lambda df, k, make=unitigs.opened: cut.append(k) or make(df, k))
    assert rows(merge.merge(m, values, k - 1, k - 1, (method, 0.5), rep_mode)) == want
    assert max(x[1] for x in want) > 5 and len(want) > 1 and (method or cut)  # a cycle through several buckets was cut


def test_what_passes_move_grows_with_contigs(spark, monkeypatch):
    """20,000 k-mers in one path: what is written for each is some bits; counts are kept of the contigs' ends alone."""
    rng = random.Random(8)
    k, n = 21, 20_000
    s = "".join(rng.choice("ACGT") for _ in range(n + k - 1))
    kmers = sorted({min(w, rc(w)) for w in (s[i : i + k] for i in range(n))})
    m = matrix(spark, {x: [1.0, 2.0, 4.0] for x in kmers}, k=k, stranded=False)
    written = []

    def make(df, name):
        out = materialise(df, name)
        written.append((sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()), out.count() if "counts" in out.columns else 0))
        return out

    monkeypatch.setattr(merge, "materialise", make)
    monkeypatch.setattr(paths, "materialise", make)
    out = merge.merge(m, longest=k - 1, shortest=k - 3).collect()
    assert sum(r["nb_merged"] for r in out) == n and len(out) < 5
    assert 0 < sum(rows for _, rows in written) < 50
    assert sum(size for size, _ in written) < 40 * n
