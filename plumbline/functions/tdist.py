"""Tail probability of Student's t, for arrays."""

from __future__ import annotations

import math

import numpy as np


def _continued_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the fraction in the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_inc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * np.log(inner) + b * np.log1p(-inner)
    )
    front = np.exp(log_front)
    swap = x > (a + 1) / (a + b + 2)
    direct = front * _continued_fraction(a, b, np.where(swap, 0.0, x)) / a
    mirrored = 1.0 - front * _continued_fraction(b, a, np.where(swap, 1 - x, 0.0)) / b
    out = np.where(swap, mirrored, direct)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df: float) -> np.ndarray:
    """P(|T| > |t|) for df degrees of freedom."""
    t = np.asarray(t, dtype=float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))
