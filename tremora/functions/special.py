"""Tail probabilities of the t and F laws, vectorised for Arrow batches."""

from __future__ import annotations

import math

import numpy as np

def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def betainc(a, b, x):
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 0.0, 1.0)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def t_two_sided(t, df):
    t = np.asarray(t, float)
    return betainc(np.asarray(df, float) / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f = np.maximum(np.asarray(f, float), 0.0)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def _invert(tail, alpha, hi):
    lo = 0.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(tail(mid)) > alpha else (lo, mid)
    return (lo + hi) / 2


def f_critical(alpha: float, d1: float, d2: float) -> float:
    return _invert(lambda f: f_upper(f, d1, d2), alpha, 1e6)


def t_critical(alpha: float, df: float) -> float:
    """Two-sided critical value."""
    return _invert(lambda t: t_two_sided(t, df), alpha, 1e6)
