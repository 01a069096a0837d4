"""Plane geometry: predicates on events as Columns, and small numeric helpers for gate shapes.

Predicates run in the JVM over all events. Shapes themselves are tiny and are handled on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .transforms import number

Point = tuple[float, float]


def side(x: str | Column, threshold: float | Column) -> Column:
    """'+' where x >= threshold, '-' where x < threshold, null where x is missing."""
    v = number(x)
    return F.when(v >= threshold, "+").when(v < threshold, "-")


def quadrant(x: str | Column, y: str | Column, x_threshold: float | Column, y_threshold: float | Column) -> Column:
    """'++', '+-', '-+' or '--': x first; null where either is missing."""
    return F.concat(side(x, x_threshold), side(y, y_threshold))


def in_polygon(x: str | Column, y: str | Column, polygon: list[Point]) -> Column:
    """Strictly inside a simple polygon: crossings of a ray are odd, and the point is on no edge. A bounding box comes first, which scans can use."""
    u, v = number(x), number(y)
    ring = polygon if polygon[0] != polygon[-1] else polygon[:-1]
    if len(ring) < 3:
        return F.lit(False)
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            at = (v - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crossings = crossings + F.when(((v >= min(y1, y2)) & (v < max(y1, y2))) & (u < at), 1).otherwise(0)
        cross = (u - x1) * (y2 - y1) - (v - y1) * (x2 - x1)
        on_edge = on_edge | ((cross == 0) & u.between(min(x1, x2), max(x1, x2)) & v.between(min(y1, y2), max(y1, y2)))
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = (u > min(xs)) & (u < max(xs)) & (v > min(ys)) & (v < max(ys))
    return F.coalesce(box & (crossings % 2 == 1) & ~on_edge, F.lit(False))


def holders(x: str | Column, y: str | Column, polygons: dict[str, list[Point]]) -> Column:
    """The names of all polygons that hold a point, in their order: `in_polygon` for so many that a plan can't have an expression for each corner."""
    rings = [(n, np.array(p if p[0] != p[-1] else p[:-1], float)) for n, p in polygons.items()]
    rings = [(n, r) for n, r in rings if len(r) >= 3]

    @F.pandas_udf("array<string>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        u, v = xs.to_numpy(float), ys.to_numpy(float)
        order = np.argsort(u, kind="stable")  # missing values come last, and are in no range
        u, v = u[order], v[order]
        out: list[list[str]] = [[] for _ in u]
        for name, ring in rings:
            (left, low), (right, high) = ring.min(0), ring.max(0)
            own = np.arange(np.searchsorted(u, left, "right"), np.searchsorted(u, right, "left"))
            own = own[(v[own] > low) & (v[own] < high)]
            for i in range(0, len(own), step := max(1, 2_000_000 // len(ring))):
                part = own[i : i + step]
                for j in part[_inside(u[part], v[part], ring)].tolist():
                    out[order[j]].append(name)
        return pd.Series(out, dtype=object)

    return run(number(x), number(y))


def _inside(u: np.ndarray, v: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """As `in_polygon`, with its order of operations."""
    u, v, (x1, y1), (x2, y2) = u[:, None], v[:, None], ring.T, np.roll(ring, -1, axis=0).T
    level = y1 == y2
    at = (v - y1) * ((x2 - x1) / np.where(level, 1.0, y2 - y1)) + x1
    crossings = (~level & (v >= np.minimum(y1, y2)) & (v < np.maximum(y1, y2)) & (u < at)).sum(1)
    cross = (u - x1) * (y2 - y1) - (v - y1) * (x2 - x1)
    on_edge = (cross == 0) & (u >= np.minimum(x1, x2)) & (u <= np.maximum(x1, x2)) & (v >= np.minimum(y1, y2)) & (v <= np.maximum(y1, y2))
    return (crossings % 2 == 1) & ~on_edge.any(1)


def in_ellipse(x: str | Column, y: str | Column, centre: Point, width: float, height: float, angle: float) -> Column:
    """Inside or on an ellipse of full axes width and height, turned by angle degrees counter-clockwise."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    dx, dy = number(x) - centre[0], number(y) - centre[1]
    along, across = (dx * c + dy * s) / (width / 2), (dy * c - dx * s) / (height / 2)
    return F.coalesce(along * along + across * across <= 1, F.lit(False))


def confidence_ellipse(var_x: float, var_y: float, cov: float, conf: float = 0.95) -> tuple[float, float, float]:
    """Width, height and angle (degrees) of the ellipse that holds `conf` of a normal distribution."""
    mean, half = (var_x + var_y) / 2, math.hypot((var_x - var_y) / 2, cov)
    size = -2 * math.log(1 - conf)
    angle = math.degrees(math.atan2(mean + half - var_x, cov)) if cov else (0.0 if var_x >= var_y else 90.0)
    return 2 * math.sqrt((mean + half) * size), 2 * math.sqrt(max(mean - half, 0.0) * size), angle


def ellipse_polygon(centre: Point, width: float, height: float, angle: float, n: int = 64) -> list[Point]:
    t = np.linspace(0, 2 * math.pi, n, endpoint=False)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    u, v = width / 2 * np.cos(t), height / 2 * np.sin(t)
    return [(float(centre[0] + a * c - b * s), float(centre[1] + a * s + b * c)) for a, b in zip(u, v, strict=True)]


def convex_hull(points: np.ndarray) -> list[Point]:
    """Hull vertices counter-clockwise; empty if all points are on a line."""
    pts = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return []

    def chain(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append((float(p[0]), float(p[1])))
        return out

    ring = chain(pts)[:-1] + chain(pts[::-1])[:-1]
    return ring if len(ring) > 2 else []


def area(polygon: list[Point]) -> float:
    x, y = np.array(polygon, dtype=float).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clip(subject: list[Point], window: list[Point]) -> list[Point]:
    """The part of a polygon inside a convex one."""
    ring = window if np.dot(*_turn(window)) > 0 else window[::-1]
    out = list(subject)
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        inside = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0
        new: list[Point] = []
        for p, q in zip(out, [*out[1:], *out[:1]], strict=True):
            if inside(p) != inside(q):
                d = (q[0] - p[0]) * (b[1] - a[1]) - (q[1] - p[1]) * (b[0] - a[0])
                t = ((a[0] - p[0]) * (b[1] - a[1]) - (a[1] - p[1]) * (b[0] - a[0])) / d
                cut = (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
                new += [p, cut] if inside(p) else [cut]
            elif inside(p):
                new.append(p)
        out = new
    return out


def _turn(polygon: list[Point]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.array(polygon, dtype=float).T
    return np.ones(len(x)), x * np.roll(y, -1) - y * np.roll(x, -1)


def overlap(first: list[Point], second: list[Point], threshold: float = 0.0) -> float:
    """The share of the first polygon's area that a convex second one covers; 0 if below the threshold."""
    cut = clip(first, second)
    share = area(cut) / area(first) if len(cut) > 2 else 0.0
    return share if share >= threshold else 0.0


def hausdorff(first: list[Point], second: list[Point]) -> float:
    """The discrete Hausdorff distance between vertices."""
    a, b = np.array(first, dtype=float), np.array(second, dtype=float)
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return float(max(d.min(axis=1).max(), d.min(axis=0).max()))


def union_outline(first: list[Point], second: list[Point]) -> list[Point]:
    """The convex outline of two overlapping polygons; an error if they are apart."""
    if len(clip(first, convex_hull(np.array(second)))) < 3:
        raise ValueError("polygons don't overlap")
    return convex_hull(np.array([*first, *second]))
