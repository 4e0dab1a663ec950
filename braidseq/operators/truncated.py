"""Normal densities cut off below, fitted: mean and variance of the uncut density from moments of what is left, by a bracketing root finder on arrays."""

from __future__ import annotations

from collections.abc import Callable
from math import erfc, pi, sqrt

import numpy as np

_erfc = np.vectorize(erfc, otypes=[float])


def roots(f: Callable[[np.ndarray], np.ndarray], lo: np.ndarray, hi: np.ndarray, tolerance: float = 1e-13, steps: int = 200) -> np.ndarray:
    """A root of f, elementwise, between lo and hi where f changes its sign; nan where it does not.

    Each step halves the bracket or, where that is nearer to the end, takes the regula falsi point with the stale end's value halved.
    """
    lo, hi = np.array(lo, float), np.array(hi, float)
    a, b = f(lo), f(hi)
    bad = ~(np.sign(a) * np.sign(b) <= 0)
    for step in range(steps):
        with np.errstate(invalid="ignore", divide="ignore"):
            x = hi - b * (hi - lo) / (b - a)
        middle = (lo + hi) / 2
        x = np.where(np.isfinite(x) & (x > lo) & (x < hi) & (step % 3 < 2), x, middle)
        y = f(x)
        left = np.sign(y) == np.sign(a)
        # The end that stays loses half of its value, so that it moves too.
        a, b = np.where(left, y, a / 2), np.where(left, b / 2, y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, x)
        exact = y == 0
        lo, hi = np.where(exact, x, lo), np.where(exact, x, hi)
        if np.all((hi - lo <= tolerance * np.maximum(1.0, np.abs(hi))) | bad):
            break
    return np.where(bad, np.nan, (lo + hi) / 2)


def hazard(z: np.ndarray) -> np.ndarray:
    """Density of the standard normal over the probability of being above, for any z."""
    z = np.asarray(z, float)
    near = np.clip(z, -37.0, 25.0)
    usual = np.exp(-near * near / 2) / (sqrt(2 * pi) * 0.5 * _erfc(near / sqrt(2)))
    far = np.maximum(z, 25.0)
    return np.where(z > 25, far + 1 / far - 2 / far**3 + 10 / far**5, usual)


def above(cut: float, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Probability of the uncut density above the cut."""
    return np.maximum(0.5 * _erfc((cut - mean) / np.sqrt(2 * variance)), 1e-300)


def fitted(mean: np.ndarray, square: np.ndarray, cut: float, least: float, far: float = 1e4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the normals that, cut off below `cut`, have these means and mean squares: the likeliest ones for such data.

    With a the mean above the cut and b = square - cut * mean, the variance is b - mu * a, and mu the root of what is left of the first moment's equation.
    Where the data are spread as widely as an exponential density has them, or wider, there is no root: mu goes to -far times the mean above the cut.
    Variances are at least `least`.
    """
    mean, square = np.asarray(mean, float), np.asarray(square, float)
    a = np.maximum(mean - cut, 1e-12)
    b = square - cut * mean
    variance = lambda mu: np.maximum(b - mu * a, 1e-300)

    def left(mu):
        s = np.sqrt(variance(mu))
        return mean - mu - s * hazard((cut - mu) / s)

    # Narrow data do not feel the cut at all: the top of the bracket is where the variance reaches nothing.
    top = b / a
    mu = roots(left, cut - far * a, top - 1e-12 * np.maximum(1.0, np.abs(top)))
    mu = np.where(np.isnan(mu), np.where(left(cut - far * a) < 0, cut - far * a, mean), mu)
    u = b - mu * a
    plain = square - mean * mean
    return np.where(plain <= least, mean, mu), np.maximum(np.where(plain <= least, least, u), least)
