"""Penalised logistic regression: coordinate descent with warm starts along a path of penalties, for many resamples at once; where the
signs of the coefficients have settled, they are solved for.

For sample weights w (0 or 1, N of them 1), fits minimise  sum(w * logloss) / N + penalty * (alpha * |s * b|_1 + (1 - alpha) / 2 * |s * b|_2^2)
over coefficients b and an intercept without penalty; s are the features' standard deviations among the samples of the fit (N in the
denominator), or 1 where nothing is standardised.
"""

from __future__ import annotations

import numpy as np

LEAST_VARIANCE = 1e-5
TOLERANCE = 1e-11
SWEEPS = 100
STEPS = 50
SOLVED = 300  # features, at most, whose coefficients are solved for at once


def scales(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The features' standard deviations under each row of weights; 0 for constant ones."""
    n = w.sum(axis=1, keepdims=True)
    mean = w @ x / n
    s = np.sqrt(np.maximum(w @ (x * x) / n - mean * mean, 0))
    return np.where(s > 1e-9 * (np.abs(mean) + 1e-300), s, 0.0)


def penalties(x: np.ndarray, y: np.ndarray, alpha: float, n: int = 100, standardise: bool = True) -> np.ndarray:
    """n penalties from the least that leaves no coefficient (under alpha 0.001 as if it were that), falling by equal factors to a 10,000th, or a 100th with fewer samples than features."""
    s = scales(x, np.ones((1, len(y))))[0]
    slope = np.abs((x - x.mean(axis=0)).T @ (y - y.mean())) / len(y)
    slope = np.where(s > 0, slope / np.where(s > 0, s if standardise else 1.0, 1.0), 0.0)
    return slope.max(initial=1e-12) / max(alpha, 1e-3) * (0.01 if len(y) < x.shape[1] else 1e-4) ** np.linspace(0, 1, n)


def _solved(z, u, target, l1, l2, usable, b, b0) -> bool:
    """Solve one fit's quadratic approximation, given which coefficients are not zero and their signs; b and b0 change if that is the minimum."""
    on = np.flatnonzero(usable & ((b != 0) | (l1 == 0)))
    if len(on) > SOLVED:
        return False
    part, sign = np.column_stack([z[:, on], np.ones(len(z))]), np.append(np.sign(b[on]), 0.0)
    try:
        new = np.linalg.solve(part.T @ (u[:, None] * part) + np.diag(np.append(l2[on], 0.0)), part.T @ (u * target) - np.append(l1[on], 0.0) * sign)
    except np.linalg.LinAlgError:
        return False
    slope = np.abs(z.T @ (u * (target - part @ new)))
    off = usable & (b == 0) & (l1 > 0)
    if not np.isfinite(new).all() or ((np.sign(new) != sign)[:-1] & (l1[on] > 0)).any() or (slope[off] > l1[off] + 1e-10).any():
        return False
    b[on], b0[0] = new[:-1], new[-1]
    return True


def _descend(z, z2, y, share, eta, l1, l2, usable, b, b0, live) -> None:
    """One quadratic approximation of the fits numbered in `live`, minimised; b and b0 change."""
    q = 1 / (1 + np.exp(-np.clip(eta[live], -50, 50)))
    v = np.maximum(q * (1 - q), LEAST_VARIANCE)
    u, target = share[live] * v, eta[live] + (y - q) / v
    left = np.arange(len(live))  # places in live
    for sweep in range(SWEEPS):
        if sweep % 5 == 0:
            left = np.array([k for k in left if not _solved(z, u[k], target[k], l1[live[k]], l2[live[k]], usable[live[k]], b[live[k]], b0[live[k] : live[k] + 1])], np.int64)
            if not len(left):
                return
        at = live[left]
        ul, bl = u[left], b[at]
        rl, curve = target[left] - bl @ z.T - b0[at, None], ul @ z2
        moved = 0.0
        for j in np.flatnonzero(usable[at].any(axis=0)):
            slope = (ul * rl) @ z[:, j] + curve[:, j] * bl[:, j]
            new = np.sign(slope) * np.maximum(np.abs(slope) - l1[at, j], 0) / np.where(usable[at, j], curve[:, j] + l2[at, j], 1.0)
            step = np.where(usable[at, j], new, 0.0) - bl[:, j]
            if step.any():
                rl -= step[:, None] * z[:, j]
                bl[:, j] += step
                moved = max(moved, float(np.max(curve[:, j] * step * step)))
        step = (ul * rl).sum(axis=1) / ul.sum(axis=1)
        b[at], b0[at] = bl, b0[at] + step
        if max(moved, float(np.max(step * step))) < TOLERANCE:
            return


def fits(x: np.ndarray, y: np.ndarray, w: np.ndarray, path: np.ndarray, alpha: float, standardise: bool = True, enough: float = 0.999) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (penalty, fit, feature) and intercepts (penalty, fit) for each row of weights, along the path.

    The path ends early where the first fit explains the share `enough` of its deviance.
    """
    centre, spread = x.mean(axis=0), x.std(axis=0)
    z = (x - centre) / np.where(spread > 0, spread, 1.0)
    runs, p = len(w), x.shape[1]
    own = scales(x, w) if standardise else np.ones((runs, p))
    usable = (scales(x, w) > 0) & (spread > 0)
    factor = np.where(usable, own / np.where(spread > 0, spread, 1.0), 0.0)
    share = w / w.sum(axis=1, keepdims=True)
    mean = share @ y
    b, b0 = np.zeros((runs, p)), np.log(np.clip(mean, 1e-9, 1 - 1e-9) / (1 - np.clip(mean, 1e-9, 1 - 1e-9)))
    eta = np.repeat(b0[:, None], len(y), axis=1)
    loss = lambda: (share * (np.logaddexp(0, eta) - y * eta)).sum(axis=1)
    null = loss()[0]
    z2 = z * z
    coefficients, intercepts = [], []
    for penalty in path:
        l1, l2 = penalty * alpha * factor, penalty * (1 - alpha) * factor**2
        live = np.arange(runs)
        for _ in range(STEPS):  # quadratic approximations, of the fits that still move
            start, start0 = b[live].copy(), b0[live].copy()
            _descend(z, z2, y, share, eta, l1, l2, usable, b, b0, live)
            eta[live] = b[live] @ z.T + b0[live, None]
            change = np.maximum(np.max(np.abs(b[live] - start) / (1 + np.abs(start)), axis=1, initial=0), np.abs(b0[live] - start0) / (1 + np.abs(start0)))
            live = live[change > 1e-7]
            if not len(live):
                break
        raw = b / np.where(spread > 0, spread, 1.0)
        coefficients.append(raw)
        intercepts.append(b0 - raw @ centre)
        if loss()[0] < (1 - enough) * null:
            break
    return np.array(coefficients), np.array(intercepts)


def deviances(x: np.ndarray, y: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Twice the log loss of each sample under coefficients (..., feature), probabilities kept within 1e-5 of 0 and 1."""
    q = np.clip(1 / (1 + np.exp(-np.clip(coefficients @ x.T + intercepts[..., None], -50, 50))), 1e-5, 1 - 1e-5)
    return -2 * (y * np.log(q) + (1 - y) * np.log(1 - q))


def drawn(n: int, run: int, seed: int) -> np.ndarray:
    """Weights of a resample: three quarters of the samples, drawn by the run's own generator."""
    w = np.zeros(n)
    w[np.random.default_rng([seed, run]).permutation(n)[: round(3 * n / 4)]] = 1
    return w
