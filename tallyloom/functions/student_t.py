"""The two-sided tail of Student's t with fractional degrees of freedom, as an Arrow UDF."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_beta(a: np.ndarray, b: float) -> np.ndarray:
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    return (lgamma(a) + math.lgamma(b) - lgamma(a + b)).astype(float)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    for m in range(1, rounds):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / safe(1.0 + numerator * d), safe(1.0 + numerator / c)
            out = out * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return out


def two_sided_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|): the regularised incomplete beta function of df / (df + t^2) at (df / 2, 1 / 2)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x, a, b = df / (df + t * t), df / 2.0, np.full_like(df, 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - _log_beta(a, 0.5))
        low = x < (a + 1.0) / (a + b + 2.0)
        p = np.where(low, front * _fraction(a, b, np.where(low, x, 0.5)) / a, 1.0 - front * _fraction(b, a, np.where(low, 0.5, 1.0 - x)) / b)
    return np.where(t == 0, 1.0, np.clip(p, 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    out = pd.Series(np.full(len(t), np.nan))
    known = (t.notna() & df.notna()).to_numpy()
    out[known] = two_sided_tail(t[known].to_numpy(), df[known].to_numpy())
    return out.where(known, None)
