"""Medians and means of vectors by group, small and large."""

import random

import numpy as np
import pandas as pd
import pytest

from tallyloom.functions import medians


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 1.0, 1.5, 1e300, np.inf])
    u = medians.ordered_bits(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5] and (medians.from_bits(u) == x).all()


@pytest.mark.parametrize("large", [medians.LARGE, 7])
def test_groups(spark, monkeypatch, large):
    monkeypatch.setattr(medians, "LARGE", large)
    rng = random.Random(2)
    rows = [(rng.choice("abcde"), [rng.choice([0.0, -1.5, rng.uniform(-9, 9), float(rng.randint(0, 3))]) for _ in range(3)]) for _ in range(60)] + [("one", [1.0, 2.0, 3.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "rep string, counts array<double>").repartition(4)
    by = {k: np.array([v for g, v in rows if g == k]) for k, _ in rows if k}
    got = {r["rep"]: (r["counts"], r["n"]) for r in medians.group_medians(df, "rep", 3).collect()}
    assert set(got) == set(by) and all(got[k][0] == np.median(v, axis=0).tolist() and got[k][1] == len(v) for k, v in by.items())
    got = {r["rep"]: (r["counts"], r["n"]) for r in medians.group_means(df, "rep").collect()}
    assert all(np.allclose(got[k][0], v.mean(axis=0), rtol=1e-12) and got[k][1] == len(v) for k, v in by.items()) and len(got) == len(by)
    assert medians.group_medians(df.limit(0), "rep", 3).count() == 0 == medians.group_means(df.limit(0), "rep").count()


def test_a_group_of_a_million(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(0, 1, 1_000_000), rng.integers(0, 9, 1_000_000).astype(float)])
    df = spark.createDataFrame(pd.DataFrame({"g": np.zeros(len(x), np.int64), "a": x[:, 0], "b": x[:, 1]})).selectExpr("g", "array(a, b) counts").repartition(8)
    out = medians.group_medians(df, "g", 2)
    assert "median" not in out._jdf.queryExecution().executedPlan().toString().lower().replace("medians-", "")
    assert out.first()["counts"] == np.median(x, axis=0).tolist()
