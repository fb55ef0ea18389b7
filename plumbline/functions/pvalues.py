"""Tail probabilities, computed on the few numbers that an aggregate leaves."""

from __future__ import annotations

import math

import numpy as np


def chi2_sf(x: float, dof: int) -> float:
    """P(X > x) of a chi-square variable, by the incomplete gamma function."""
    if x <= 0 or dof < 1:
        return 1.0
    a, z = dof / 2, x / 2
    if z > 700 + 10 * a:
        return 0.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


#: Values of each sample up to which the p-value of a gap is exact.
EXACT = 10_000


def kolmogorov_sf(x: float) -> float:
    """P(K > x) of the limit distribution of scaled gaps.

    Two series of the same function: the alternating one needs few terms where
    x is large, its dual (by the theta function's inversion) where x is small.
    """
    if x <= 0:
        return 1.0
    if x < 1.18:
        terms = (math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 6))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * sum(terms)))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 6))))


def ks_exact(d: float, n: int, m: int) -> float:
    """P(D >= d) of two samples without ties, exactly.

    The order of both samples is a lattice path from (0, 0) to (n, m), all of
    them equally likely; the value at a point is the share of the paths to it
    that have left the band |i/n - j/m| < d.  Shares need no large numbers,
    and none is subtracted, so small p-values keep their digits.
    """
    g = math.gcd(n, m)
    a, b = m // g, n // g
    h = round(d * b * m)  # gaps are whole multiples of 1 / lcm(n, m)
    if h <= 0:
        return 1.0
    left = np.zeros(1)  # shares of the points lo.. of a diagonal
    lo = 0
    for s in range(1, n + m + 1):
        first, last = max(0, s - m), min(n, s)
        i = np.arange(first, last + 1)
        # the points (i - 1, j) and (i, j - 1) of the diagonal before
        held = np.concatenate(([0.0], left, [0.0]))
        now = held[i - lo] * i / s + held[i - lo + 1] * (s - i) / s
        now[np.abs(i * a - (s - i) * b) >= h] = 1.0
        left, lo = now, first
    return float(min(1.0, left[-1]))


def ks_sf(d: float, n: int, m: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value: exact up to ``EXACT`` values in
    each sample, else that of the limit distribution."""
    if not n or not m or d <= 0:
        return 1.0
    if max(n, m) <= EXACT:
        return ks_exact(d, int(n), int(m))
    return kolmogorov_sf(d * math.sqrt(n * m / (n + m)))
