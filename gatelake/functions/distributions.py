"""Tail probabilities of the usual test statistics, in plain Python (they are asked for a few numbers at a time)."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(x: float, a: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / ((num * d + b) or 1e-300)
        c = (b + num / c) or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def normal_quantile(p: float) -> float:
    """The value below which a standard normal lies with chance p."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_p(x: float, df: float) -> float:
    return gamma_sf(x / 2, df / 2)


def studentised_range_p(q: float, groups: int, df: float) -> float:
    """Upper tail of the studentised range, by numeric integration (4 decimals or better)."""
    import numpy as np

    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([1 - normal_sf(float(v)) for v in z])
    s = np.linspace(1e-3, 1 + 12 / math.sqrt(2 * df), 600)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    within = np.array([groups * np.trapezoid(phi * (cdf - np.interp(z - q * v, z, cdf, left=0.0)) ** (groups - 1), z) for v in s])
    return float(min(1.0, max(0.0, 1 - np.trapezoid(np.exp(log_density) * within, s))))


def holm(p: list[float]) -> list[float]:
    """Holm's step-down adjustment."""
    order = sorted(range(len(p)), key=p.__getitem__)
    out, most = [0.0] * len(p), 0.0
    for i, at in enumerate(order):
        most = max(most, min(1.0, (len(p) - i) * p[at]))
        out[at] = most
    return out


def benjamini_hochberg(p: list[float]) -> list[float]:
    order = sorted(range(len(p)), key=p.__getitem__, reverse=True)
    out, least = [0.0] * len(p), 1.0
    for i, at in enumerate(order):
        least = min(least, p[at] * len(p) / (len(p) - i))
        out[at] = least
    return out


def bonferroni(p: list[float]) -> list[float]:
    return [min(1.0, x * len(p)) for x in p]


ADJUST = {"holm": holm, "fdr_bh": benjamini_hochberg, "bonferroni": bonferroni}
