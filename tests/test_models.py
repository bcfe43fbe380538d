"""Penalised paths against a plain proximal-gradient solver in NumPy."""

import numpy as np
import pytest

from tallyloom.functions import penalised
from tallyloom.operators import models, tools
from tests.test_operators import matrix


def slow_fit(x, y, w, penalty, alpha, standardise):
    """Accelerated proximal gradient on the objective itself."""
    n = w.sum()
    mean = (w[:, None] * x).sum(0) / n
    s = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / n)
    keep = s > 1e-12
    z = np.where(keep, (x - mean) / np.where(keep, s, 1.0), 0.0)
    f = np.ones_like(s) if standardise else np.where(keep, 1 / np.where(keep, s, 1.0), 1.0)
    z1 = np.column_stack([np.ones(len(y)), z])
    rate = 1 / (np.linalg.norm(z1 * np.sqrt(w / n)[:, None], 2) ** 2 / 4 + penalty * (1 - alpha) * (f**2).max())
    b = v = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(60000):
        grad = z1.T @ (w * (1 / (1 + np.exp(-(z1 @ v))) - y)) / n
        grad[1:] += penalty * (1 - alpha) * f**2 * v[1:]
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty * alpha * f, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - b)
        if np.abs(new - b).max() < 1e-12:
            break
        b, t = new, t2
    raw = np.where(keep, b[1:] / np.where(keep, s, 1.0), 0.0)
    return raw, b[0] - raw @ mean


def data(seed, n=40, p=8):
    rng = np.random.default_rng(seed)
    x = rng.gamma(2.0, [[1.0, 5.0, 20.0, 0.5, 3.0, 100.0, 2.0, 1.0]], (n, p))
    x[:, 3] = 4.0  # constant
    y = (x[:, 0] - 0.3 * x[:, 1] + 0.05 * x[:, 2] + rng.normal(0, 1.5, n) > 1.0).astype(float)
    return x, y


@pytest.mark.parametrize("alpha", [1.0, 0.5, 0.0])
@pytest.mark.parametrize("standardise", [True, False])
def test_fits_by_another_solver(alpha, standardise):
    x, y = data(1)
    w = np.stack([np.ones(40), penalised.drawn(40, 0, 5), penalised.drawn(40, 1, 5)])
    path = penalised.penalties(x, y, alpha, 12, standardise)[: 8 if alpha else 12]
    b, b0 = penalised.fits(x, y, w, path, alpha, standardise, enough=1.0)
    assert np.abs(b[0, 0]).max() < (1e-9 if alpha else 1)
    for i in (1, 4, len(path) - 1):
        for run in range(3):
            c, c0 = slow_fit(x, y, w[run], path[i], alpha, standardise)
            scale = 1 if not standardise else 1 + np.abs(c0)
            assert np.abs(b[i, run] - c).max() < 1e-4 and abs(b0[i, run] - c0) < 1e-3 * scale
    assert (b[:, :, 3] == 0).all()


def fixture(spark):
    x, y = data(2, 60)
    labels = y.astype(int).tolist()
    return matrix(spark, {f"f{j}": x[:, j].tolist() for j in range(8)}, ), labels, x, y


def test_cross_validation_by_hand(spark):
    m, labels, x, y = fixture(spark)
    d = models.design(m, labels)
    assert d.features == [f"f{j}" for j in range(8)] and (d.x == x).all()
    rows = sorted(models.cross_validation(spark, d, 1.0, 10, 15).collect())
    path = penalised.penalties(x, y, 1.0, 15)
    fold = np.arange(60) % 10
    raw = np.zeros((10, len(rows)))
    for f in range(10):
        for i in range(len(rows)):
            c, c0 = slow_fit(x, y, (fold != f).astype(float), path[i], 1.0, True)
            q = np.clip(1 / (1 + np.exp(-(x[fold == f] @ c + c0))), 1e-5, 1 - 1e-5)
            raw[f, i] = np.mean(-2 * np.log(np.where(y[fold == f] == 1, q, 1 - q)))
    mean, sd = raw.mean(0), np.sqrt(raw.var(0) / 9)
    assert np.abs([r["mean"] for r in rows] - mean).max() < 1e-4 and np.abs([r["sd"] for r in rows] - sd).max() < 1e-4
    chosen = next(i for i in range(len(rows)) if mean[i] <= mean.min() + sd[mean.argmin()])
    assert [r["step"] for r in rows if r["chosen"]] == [chosen] and rows[0]["nonzero"] == 0


def test_stability_of_2000_runs_is_one_job(spark):
    m, labels, x, y = fixture(spark)
    d = models.design(m, labels)
    penalty = penalised.penalties(x, y, 1.0)[25]
    found = models.stability(spark, d, penalty, 1.0, 2000, 3)
    spark.sparkContext.setJobGroup("stability", "runs")
    got = {r["feature"]: r["share"] for r in found.collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stability"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2  # the shuffle's map stage may be a job of its own
    part = np.zeros(8)
    for run in range(60):
        part += slow_fit(x, y, penalised.drawn(60, run, 3), penalty, 1.0, False)[0] != 0
    few = {r["feature"]: r["share"] * 60 for r in models.stability(spark, d, penalty, 1.0, 60, 3).collect()}
    assert [round(few.get(f"f{j}", 0)) for j in range(8)] == part.tolist()
    assert set(got) <= set(d.features) and all(0 < v <= 1 for v in got.values()) and got["f2"] > 0.5


@pytest.mark.parametrize("kind", ["lasso", "elasticnet", "ridge"])
def test_models(spark, kind):
    m, labels, x, y = fixture(spark)
    model = models.fit_model(m, labels, kind, runs=100)
    d = models.design(m, labels).of(model.features)
    c, c0 = slow_fit(d.x, y, np.ones(60), model.penalty, models.ALPHA[kind], True)
    assert np.abs(np.array(model.coefficients) - c).max() < 1e-4
    got = {r["sample_idx"]: r for r in model.predict(m).collect()}
    q = 1 / (1 + np.exp(-(d.x @ c + c0)))
    assert all(abs(got[i]["prob_1"] - q[i]) < 1e-3 for i in range(60)) and np.mean([got[i]["pred_class"] == y[i] for i in range(60)]) > 0.7
    if kind == "ridge":
        top = models.fit_top_ridge(m, labels, 3)
        order = sorted(zip(model.features, model.coefficients, strict=True), key=lambda v: -abs(v[1]))[:3]
        assert sorted(top.features) == sorted(f for f, _ in order)
        table = {r["feature"]: r["coefficient"] for r in top.table(spark).collect()}
        assert table[None] == top.intercept and len(table) == 4


def test_edges(spark, monkeypatch):
    m, labels, *_ = fixture(spark)
    for bad in (lambda: models.design(m, [0] * 60), lambda: models.fit_model(m, labels, "forest")):
        with pytest.raises(ValueError):
            bad()
    none = models.fit_path(spark, models.design(m, labels).of([]), 1.0)
    assert none.features == [] and {r["pred_class"] for r in none.predict(m).collect()} <= {0, 1}
    monkeypatch.setattr(models, "MAX_CELLS", 10)
    with pytest.raises(ValueError):
        models.design(m, labels)
    assert tools.count_zeros(m).first()["zeros"] == 0
