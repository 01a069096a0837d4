"""One-dimensional densities over binned counts, peaks, valleys and warps.

Events are counted into a fixed grid by Spark; everything after that is numpy on at most GRID numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .transforms import number

GRID = 1024


@dataclass
class Density:
    x: np.ndarray
    p: np.ndarray
    n: int


def silverman(n: float, sd: float, iqr: float) -> float:
    spread = min(v for v in (sd, iqr / 1.349) if v > 0) if sd > 0 or iqr > 0 else 1.0
    return 0.9 * spread * n ** (-0.2)


def smooth(counts: np.ndarray, step: float, bandwidth: float) -> np.ndarray:
    """Convolution of binned counts with a normal kernel, by FFT."""
    half = np.arange(-len(counts) + 1, len(counts)) * step
    kernel = np.exp(-0.5 * (half / bandwidth) ** 2) / (bandwidth * math.sqrt(2 * math.pi))
    size = 1 << int(np.ceil(np.log2(3 * len(counts))))
    out = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[len(counts) - 1 : 2 * len(counts) - 1]
    return np.maximum(out, 0) / max(counts.sum(), 1e-300)


def binned(df: DataFrame, column: str, lo: float, hi: float, grid: int = GRID) -> np.ndarray:
    """Counts at grid points by linear binning: each value is shared between its two neighbours. One aggregate of at most `grid` rows."""
    step = (hi - lo) / (grid - 1)
    at = (number(column) - lo) / step
    cell = F.least(F.floor(at), F.lit(grid - 2)).cast("int")
    rows = df.where(number(column).between(lo, hi)).groupBy(cell.alias("i")).agg(F.count("*").alias("n"), F.sum(at - cell).alias("w")).collect()
    out = np.zeros(grid)
    for r in rows:
        out[r.i] += r.n - r.w
        out[r.i + 1] += r.w
    return out


def kde(df: DataFrame, column: str, *, bandwidth: float | str = "silverman", grid: int = GRID, lo: float | None = None, hi: float | None = None) -> Density:
    """Gaussian density on a grid that reaches three bandwidths beyond the data (or over the given range)."""
    x = number(column)
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).head()
    if not row.n:
        raise ValueError(f"no values in {column}")
    if bandwidth == "silverman":
        q = quantiles(df, [column], [0.25, 0.75]).head()[column]
        h = silverman(row.n, row.sd or 0.0, q[1] - q[0])
    elif bandwidth == "cross_validated":
        h = cross_validated(df, column, row.lo, row.hi, row.sd or 1.0)
    else:
        h = float(bandwidth)
    lo, hi = row.lo - 3 * h if lo is None else lo, row.hi + 3 * h if hi is None else hi
    counts = binned(df, column, lo, hi, grid)
    return Density(np.linspace(lo, hi, grid), smooth(counts, (hi - lo) / (grid - 1), h), row.n)


def kde_by(df: DataFrame, column: str, by: str, lo: float, hi: float, *, grid: int = GRID, bandwidth: float | str = "silverman") -> dict:
    """`kde` of each group over one range, for all groups at once: two aggregates, and one of at most `grid` counts a group."""
    x, step = number(column), (hi - lo) / (grid - 1)
    known = df.where(x.isNotNull())
    sizes = {r[0]: (r.n, r.sd or 0.0) for r in known.groupBy(by).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd")).collect()}
    spread = {r[0]: r[1][1] - r[1][0] for r in quantiles(known, [column], [0.25, 0.75], [by]).collect()} if bandwidth == "silverman" else {}
    at = (x - lo) / step
    cell = F.least(F.floor(at), F.lit(grid - 2)).cast("int")
    counts = {g: np.zeros(grid) for g in sizes}
    for r in known.where(x.between(lo, hi)).groupBy(by, cell.alias("i")).agg(F.count("*").alias("n"), F.sum(at - cell).alias("w")).collect():
        counts[r[0]][r.i] += r.n - r.w
        counts[r[0]][r.i + 1] += r.w
    h = {g: silverman(n, sd, spread[g]) if bandwidth == "silverman" else float(bandwidth) for g, (n, sd) in sizes.items()}
    return {g: Density(np.linspace(lo, hi, grid), smooth(counts[g], step, h[g]), sizes[g][0]) for g in sizes}


def cross_validated(df: DataFrame, column: str, lo: float, hi: float, sd: float, folds: int = 10, steps: int = 10, cells: int = GRID) -> float:
    """The bandwidth of greatest held-out likelihood, among `steps` between 1/50 of the deviation and all of it.

    Folds are counted into one grid by a hash of the value, so that all events count and the driver sees folds * cells numbers.
    """
    step = (hi - lo) / (cells - 1) or 1.0
    x = number(column)
    cell, part = F.least(F.floor((x - lo) / step), F.lit(cells - 1)).cast("int"), F.pmod(F.xxhash64(x), F.lit(folds)).cast("int")
    counts = np.zeros((folds, cells))
    for r in df.where(x.isNotNull()).groupBy(part.alias("f"), cell.alias("c")).agg(F.count("*").alias("n")).collect():
        counts[r.f, r.c] = r.n

    def score(h: float) -> float:
        total = 0.0
        for f in range(folds):
            rest = smooth(counts.sum(0) - counts[f], step, h)
            total += float((counts[f] * np.log(np.maximum(rest, 1e-300))).sum())
        return total

    return float(max(np.linspace(sd / 50, sd, steps), key=score))


def best_bandwidth(values: np.ndarray, candidates: np.ndarray, folds: int = 10) -> float:
    """The bandwidth of greatest held-out likelihood."""
    parts = [values[i::folds] for i in range(folds)]

    def score(h: float) -> float:
        total = 0.0
        for i, held in enumerate(parts):
            rest = np.concatenate([p for j, p in enumerate(parts) if j != i])
            d = np.exp(-0.5 * ((held[:, None] - rest[None]) / h) ** 2).mean(axis=1) / (h * math.sqrt(2 * math.pi))
            total += float(np.log(np.maximum(d, 1e-300)).sum())
        return total

    return float(max(candidates, key=score))


def find_peaks(p: np.ndarray, least_height: float = 0.05, spacing: float = 0.1) -> np.ndarray:
    """Local maxima of at least a share of the highest, each the highest within a share of the grid's length; a plateau counts at its left end."""
    rise = np.concatenate([[True], p[1:] > p[:-1]])
    later = np.concatenate([p[1:] < p[:-1], [True]])
    # walk plateaus to the right to see whether they fall
    falls = later.copy()
    for i in range(len(p) - 2, -1, -1):
        if p[i + 1] == p[i]:
            falls[i] = falls[i + 1]
    found = np.flatnonzero(rise & falls & (p >= least_height * p.max()))
    kept: list[int] = []
    for i in found[np.argsort(-p[found], kind="stable")]:
        if all(abs(i - k) >= spacing * len(p) for k in kept):
            kept.append(int(i))
    return np.array(sorted(kept), dtype=int)


def savgol(y: np.ndarray, window: int, order: int = 3, derivative: int = 0) -> np.ndarray:
    """Savitzky-Golay filter; the ends are read off the polynomial of the outermost full window."""
    half = window // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    out = np.empty(len(y))
    out[half : len(y) - half] = np.convolve(y, fit[derivative][::-1] * math.factorial(derivative), "valid")
    for part, at in ((y[:window], np.arange(half)), (y[-window:], np.arange(window - half, window))):
        poly = np.polynomial.Polynomial(fit @ part)
        values = poly.deriv(derivative)(at - half) if derivative else poly(at - half)
        out[at if part is not y[-window:] and at[0] == 0 else len(y) - window + at] = values
    return out


def smoothed_peaks(p: np.ndarray, *, window: int = 11, order: int = 3, least_height: float = 0.05, spacing: float = 0.1, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Smooth with ever wider windows until at most `most` peaks are left."""
    found = find_peaks(p, least_height, spacing)
    q = p
    while len(found) > most:
        if window >= len(p) // 2:
            raise ValueError("no window gives so few peaks")
        q = savgol(p, window, order)
        found = find_peaks(q, least_height, spacing)
        window += 10
    return q, found


def valley(x: np.ndarray, p: np.ndarray, peaks: np.ndarray) -> float:
    """The place of least density between the two highest peaks."""
    a, b = sorted(peaks[np.argsort(-p[peaks], kind="stable")[:2]])
    return float(x[a + int(np.argmin(p[a : b + 1]))])


def inflection(x: np.ndarray, p: np.ndarray, peak: int, *, incline: bool = False, window: int | None = None, order: int = 3) -> float:
    """Where the slope changes most on the far side of a peak (before it, with incline)."""
    window = window or max(5, len(p) // 4) | 1
    bend = np.diff(savgol(p, window, order), 2)
    if incline:
        return float(x[1 + int(np.argmax(bend[: max(1, peak - 1)]))])
    return float(x[peak + 1 + int(np.argmax(bend[peak:]))]) if peak < len(bend) else float(x[-1])


def threshold(d: Density, *, least_height: float = 0.05, spacing: float = 0.1, use_inflection: bool = True, quantile: float = 0.95) -> tuple[float, int]:
    """A cut between the density's main peaks, and how many peaks there were."""
    found = find_peaks(d.p, least_height, spacing)
    if not len(found):
        raise ValueError("the density has no peak")
    if len(found) == 1:
        if use_inflection:
            return inflection(d.x, d.p, int(found[0])), 1
        return float(np.interp(quantile, np.cumsum(d.p) / d.p.sum(), d.x)), 1
    if len(found) == 2:
        return valley(d.x, d.p, found), 2
    q, two = smoothed_peaks(d.p, least_height=least_height, spacing=spacing)
    return (valley(d.x, q, two) if len(two) == 2 else inflection(d.x, q, int(two[0]))), len(found)


def cluster_landmarks(peaks: dict[str, list[float]], k: int, rounds: int = 50) -> tuple[np.ndarray, list[tuple[str, float, int]]]:
    """Centres of k groups of all samples' peaks, and (sample, peak, group). Centres start at the peaks' quantiles."""
    rows = sorted((p, s) for s, ps in peaks.items() for p in ps)
    values = np.array([p for p, _ in rows])
    centres = np.quantile(values, (np.arange(k) + 0.5) / k)
    for _ in range(rounds):
        group = np.abs(values[:, None] - centres[None]).argmin(axis=1)
        new = np.array([values[group == g].mean() if (group == g).any() else centres[g] for g in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    group = np.abs(values[:, None] - centres[None]).argmin(axis=1)
    return centres, [(s, p, int(g)) for (p, s), g in zip(rows, group, strict=True)]


def pure_groups(landmarks: list[tuple[str, float, int]]) -> list[int]:
    """Groups whose peaks are all of one sample: no other has a landmark there."""
    samples: dict[int, set[str]] = {}
    for s, _, g in landmarks:
        samples.setdefault(g, set()).add(s)
    return sorted(g for g, names in samples.items() if len(names) == 1)


def nearest_landmarks(landmarks: list[tuple[str, float, int]], centres: np.ndarray) -> dict[int, dict[str, float]]:
    """In each group that more than one sample has, each sample's peak nearest to the centre."""
    out: dict[int, dict[str, float]] = {}
    alone = set(pure_groups(landmarks))
    for s, p, g in landmarks:
        if g not in alone and (s not in out.setdefault(g, {}) or abs(p - centres[g]) < abs(out[g][s] - centres[g])):
            out[g][s] = p
    return out


def match_landmarks(target: list[float], other: list[float]) -> list[tuple[float, float]]:
    """Pairs of peaks, one of each sample, in order: each target peak takes the nearest free peak, nearest pairs first; crossings are left out."""
    pairs: list[tuple[float, float]] = []
    options = sorted((abs(t - o), t, o) for t in target for o in other)
    for _, t, o in options:
        if all(t != a and o != b and (t - a) * (o - b) > 0 for a, b in pairs):
            pairs.append((t, o))
    return sorted(pairs)


def warp_knots(target: Density, other: Density, *, least_height: float = 0.05, spacing: float = 0.1) -> tuple[list[float], list[float]]:
    """Knots of the piecewise-linear map that moves the other density's peaks onto the target's; the range's ends stay.

    Peaks are grouped around as many centres as the target has; of each group both samples have, the peaks nearest to the centre are a pair.
    Without such a group, peaks are paired by distance.
    """
    peaks = lambda d: [float(d.x[i]) for i in find_peaks(d.p, least_height, spacing)]
    first, second = peaks(target), peaks(other)
    centres, landmarks = cluster_landmarks({"target": first, "other": second}, max(1, len(first)))
    pairs = sorted((g["target"], g["other"]) for g in nearest_landmarks(landmarks, centres).values() if len(g) == 2)
    if not pairs or any((a - c) * (b - d) <= 0 for (a, b), (c, d) in zip(pairs[:-1], pairs[1:], strict=True)):
        pairs = match_landmarks(first, second)
    lo, hi = float(other.x[0]), float(other.x[-1])
    xs, ys = [lo], [min(lo, *(t for t, _ in pairs)) if pairs else lo]
    for t, o in pairs:
        if o > xs[-1] and t > ys[-1]:
            xs.append(o)
            ys.append(t)
    if hi > xs[-1]:
        xs.append(hi)
        ys.append(max(hi, ys[-1]))
    return xs, ys


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance: square root of the divergence, natural logarithm."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float(np.sum(a[a > 0] * np.log(a[a > 0] / m[a > 0])))
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def kullback_leibler(p: np.ndarray, q: np.ndarray) -> float:
    p, q = p / p.sum(), q / q.sum()
    if np.any((q == 0) & (p > 0)):
        return math.inf
    return float(np.sum(p[p > 0] * np.log(p[p > 0] / q[p > 0])))
