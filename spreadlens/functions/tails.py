"""Tail probabilities used on one-row-per-test tables (never on raw rows)."""
from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()

# fixed values: MacKinnon (1994) response surfaces, constant case, for 1 and 2 integrated series
MACKINNON = {
    1: {"star": -1.61, "min": -18.83, "max": 2.74,
        "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    2: {"star": -2.62, "min": -18.86, "max": 0.92,
        "small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377)},
}


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def unit_root_p(t: float, series: int = 1) -> float:
    """p-value of a Dickey-Fuller t statistic (series=2 for a residual of two series)."""
    if not math.isfinite(t):
        return math.nan
    s = MACKINNON[series]
    if t > s["max"]:
        return 1.0
    if t < s["min"]:
        return 0.0
    poly = s["small"] if t <= s["star"] else s["large"]
    return normal_cdf(sum(b * t ** k for k, b in enumerate(poly)))


def chi2_sf(x: float, df: int) -> float:
    """Upper chi-square tail by the regularised incomplete gamma function."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h
