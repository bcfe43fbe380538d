"""Cross-validated accuracy of one-feature classifiers, for whole batches of features at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def standardised(x: np.ndarray) -> np.ndarray:
    """(x - mean) / sample sd for each row; constant rows become 0."""
    s = x.std(axis=1, ddof=1, keepdims=True)
    return np.divide(x - x.mean(axis=1, keepdims=True), s, out=np.zeros_like(x), where=s > 0)


def bayes(train: np.ndarray, y: np.ndarray, test: np.ndarray, classes: int) -> np.ndarray:
    """Gaussian naive Bayes with unbiased variances (plus 1e-10); ties go to the class that comes first."""
    score = []
    for g in range(classes):
        part = train[:, y == g]
        if part.shape[1] == 0:
            score.append(np.full(test.shape, -np.inf))
            continue
        v = (part.var(axis=1, ddof=1, keepdims=True) if part.shape[1] > 1 else np.zeros((len(part), 1))) + 1e-10
        score.append(np.log(part.shape[1] / len(y)) - 0.5 * np.log(2 * np.pi * v) - (test - part.mean(axis=1, keepdims=True)) ** 2 / (2 * v))
    return np.argmax(np.stack(score), axis=0)


def logistic(train: np.ndarray, y: np.ndarray, test: np.ndarray, classes: int, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Logistic regression with intercept by Newton steps on all rows together."""
    w = np.zeros((len(train), 1))
    b = np.zeros((len(train), 1))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(w * train + b, -30, 30)))
        r, q = p - y, p * (1 - p) + 1e-9
        gw, gb = (r * train).sum(1, keepdims=True) + ridge * w, r.sum(1, keepdims=True)
        hww, hwb, hbb = (q * train * train).sum(1, keepdims=True) + ridge, (q * train).sum(1, keepdims=True), q.sum(1, keepdims=True)
        det = hww * hbb - hwb * hwb
        w, b = w - np.clip((hbb * gw - hwb * gb) / det, -5, 5), b - np.clip((hww * gb - hwb * gw) / det, -5, 5)
    return (w * test + b > 0).astype(int)


def linear_svm(train: np.ndarray, y: np.ndarray, test: np.ndarray, classes: int, ridge: float = 0.01, steps: int = 200) -> np.ndarray:
    """One-against-rest linear SVM: subgradient descent on the hinge loss with averaged weights."""
    margins = []
    for g in range(classes):
        s = np.where(y == g, 1.0, -1.0)
        w, b = np.zeros((len(train), 1)), np.zeros((len(train), 1))
        mw, mb = w.copy(), b.copy()
        for k in range(1, steps + 1):
            inside = (s * (w * train + b) < 1) * s
            rate = 1.0 / (ridge * (k + 10))
            w = w - rate * (ridge * w - (inside * train).mean(1, keepdims=True))
            b = b + rate * inside.mean(1, keepdims=True) * 0.1
            if k > steps // 2:
                mw, mb = mw + w, mb + b
        margins.append(mw * test + mb)
    return np.argmax(np.stack(margins), axis=0)


CLASSIFIERS = {"bayes": bayes, "lr": logistic, "svm": linear_svm}


def accuracy(x: np.ndarray, y: np.ndarray, method: str, folds: int) -> np.ndarray:
    """Accuracy for each row of x; folds 0: leave one out, 1: test on the training data, else fold = place mod folds."""
    x, n, classes = standardised(x), x.shape[1], int(y.max()) + 1
    fit = CLASSIFIERS[method]
    if folds == 1:
        return (fit(x, y, x, classes) == y).mean(axis=1)
    fold = np.arange(n) % (n if folds == 0 else folds)
    hits = np.zeros(len(x))
    for f in np.unique(fold):
        test = fold == f
        hits += (fit(x[:, ~test], y[~test], x[:, test], classes) == y[test]).sum(axis=1)
    return hits / n


def accuracy_column(counts: Column, labels: list[int], method: str, folds: int) -> Column:
    y = np.array(labels)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in batches:
            yield pd.Series(accuracy(np.stack(c.to_numpy()).astype(float), y, method, folds) if len(c) else np.zeros(0))

    return score(counts)
