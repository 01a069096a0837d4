"""Scale transforms, scalers and normalisation as Column expressions.

Everything here stays in the JVM. Forward logicle and hyperlog have no closed form: their inverse is increasing, and Newton steps run as one
higher-order `aggregate`. Input is cast to double; a NaN is taken as missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN10 = math.log(10)
NEWTON_STEPS = 60


def number(c: str | Column) -> Column:
    """A double with NaN as null, so that comparisons never treat a missing value as large."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass(frozen=True)
class Scale:
    """A pair of inverse functions on Columns."""

    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column]
    positive: bool = False  # defined for positive values only


def _solve_width(b: float, w: float) -> float:
    """The d > 0 of a biexponential with linear width w: 2 (ln d - ln b) + w (d + b) = 0, by bisection."""
    if w == 0:
        return b
    lo, hi = 0.0, b
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid == 0 or 2 * (math.log(mid) - math.log(b)) + w * (mid + b) < 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def logicle_constants(t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> dict[str, float]:
    """Coefficients of B(y) = A e^(by) - C e^(-dy) - F, with B(1) = t and B(x1) = 0."""
    b, w, x2 = (m + a) * LN10, w / (m + a), a / (m + a)
    x1 = x2 + w
    x0 = x2 + 2 * w
    d = _solve_width(b, w)
    ca = math.exp(x0 * (b + d))
    fa = math.exp(b * x1) - ca * math.exp(-d * x1)
    scale = t / (math.exp(b) - fa - ca * math.exp(-d))
    return {"b": b, "d": d, "A": scale, "C": ca * scale, "F": fa * scale, "x1": x1}


def hyperlog_constants(t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> dict[str, float]:
    """Coefficients of B(y) = A e^(by) + C y - F, with B(1) = t and B(x1) = 0."""
    b, w, x2 = (m + a) * LN10, w / (m + a), a / (m + a)
    x1 = x2 + w
    ca = math.exp(b * (x2 + 2 * w)) / w
    fa = math.exp(b * x1) + ca * x1
    scale = t / (math.exp(b) + ca - fa)
    return {"b": b, "A": scale, "C": ca * scale, "F": fa * scale, "x1": x1}


def _newton(x: Column, value: Callable[[Column], Column], slope: Callable[[Column], Column]) -> Column:
    steps = F.sequence(F.lit(1), F.lit(NEWTON_STEPS))
    return F.when(x.isNotNull(), F.aggregate(steps, F.lit(1.0), lambda y, _: y - (value(y) - x) / slope(y)))


def logicle(t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> Scale:
    k = logicle_constants(t, w, m, a)
    value = lambda y: k["A"] * F.exp(k["b"] * y) - k["C"] * F.exp(-k["d"] * y) - k["F"]
    slope = lambda y: k["A"] * k["b"] * F.exp(k["b"] * y) + k["C"] * k["d"] * F.exp(-k["d"] * y)
    return Scale(lambda x: _newton(x, value, slope), value)


def hyperlog(t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> Scale:
    k = hyperlog_constants(t, w, m, a)
    value = lambda y: k["A"] * F.exp(k["b"] * y) + k["C"] * y - k["F"]
    slope = lambda y: k["A"] * k["b"] * F.exp(k["b"] * y) + F.lit(k["C"])
    return Scale(lambda x: _newton(x, value, slope), value)


def asinh(t: float = 262144.0, m: float = 4.5, a: float = 0.0) -> Scale:
    s, width = math.sinh(m * LN10) / t, (m + a) * LN10
    return Scale(lambda x: (F.asinh(x * s) + a * LN10) / width, lambda y: F.sinh(y * width - a * LN10) / s)


def log(base: str | int = "parametrized", t: float = 262144.0, m: float = 4.5) -> Scale:
    """The logarithm of 0 is minus infinity, and comes back as 0; of negative values it is null."""
    ends = lambda f: lambda x: F.when(x == 0, F.lit(-math.inf)).otherwise(f(x))
    if base == "parametrized":
        return Scale(ends(lambda x: F.log10(x / t) / m + 1), lambda y: t * F.pow(F.lit(10.0), (y - 1) * m), True)
    if base == 10:
        return Scale(ends(F.log10), lambda y: F.pow(F.lit(10.0), y), True)
    if base == 2:
        return Scale(ends(F.log2), lambda y: F.pow(F.lit(2.0), y), True)
    if base in ("natural", "e"):
        return Scale(ends(F.log), F.exp, True)
    raise ValueError(f"unknown base {base!r}")


METHODS: dict[str, Callable[..., Scale]] = {"logicle": logicle, "hyperlog": hyperlog, "asinh": asinh, "log": log}


def make(method: str | None, **params) -> Scale:
    """A transform by name; None changes nothing."""
    if method is None:
        return Scale(lambda x: x, lambda y: y)
    if method not in METHODS:
        raise ValueError(f"unknown transform {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](**params)


def finite(scale: Scale, x: Column) -> Column:
    """The forward transform, null where it isn't defined or not finite."""
    return scale.forward(F.when(x > 0, x) if scale.positive else x)


def clamp_to_positive(df: DataFrame, features: list[str]) -> DataFrame:
    """Each feature with values <= 0 replaced by its smallest positive value. A feature without any is an error."""
    least = df.agg(*[F.min(F.when(number(f) > 0, number(f))).alias(f) for f in features]).head()
    if missing := [f for f in features if least[f] is None]:
        raise ValueError(f"all values <= 0: {', '.join(missing)}")
    return df.withColumns({f: F.when(number(f) <= 0, F.lit(least[f])).otherwise(number(f)) for f in features})


def positive_range(df: DataFrame, feature: str) -> DataFrame:
    """min and max over positive values."""
    x = number(feature)
    return df.where(x > 0).agg(F.min(x).alias("min"), F.max(x).alias("max"))


def apply(df: DataFrame, features: dict[str, str | None] | list[str], method: str | None = "logicle", params: dict[str, dict] | dict | None = None) -> DataFrame:
    """Transform columns in place; other columns stay. A dict gives a method, and params then a dict of parameters, by feature."""
    methods = features if isinstance(features, dict) else dict.fromkeys(features, method)
    own = (lambda f: (params or {}).get(f, {})) if isinstance(features, dict) else (lambda f: params or {})
    scales = {f: make(m, **own(f)) for f, m in methods.items()}
    if positive := [f for f, s in scales.items() if s.positive]:
        df = clamp_to_positive(df, positive)
    return df.withColumns({f: s.forward(number(f)) for f, s in scales.items()})


def invert(df: DataFrame, features: dict[str, str | None] | list[str], method: str | None = "logicle", params: dict | None = None) -> DataFrame:
    """Undo `apply`. Values that were clamped come back clamped."""
    methods = features if isinstance(features, dict) else dict.fromkeys(features, method)
    own = (lambda f: (params or {}).get(f, {})) if isinstance(features, dict) else (lambda f: params or {})
    return df.withColumns({f: make(m, **own(f)).inverse(number(f)) for f, m in methods.items()})


@dataclass
class Scaler:
    """Column-wise scaling with statistics fitted once and kept: standard, minmax, robust, maxabs, quantile, yeo_johnson, box_cox.

    Standard deviations are those of a population; a constant column is divided by 1.
    """

    method: str = "standard"
    params: dict = field(default_factory=dict)
    stats: dict[str, dict[str, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, features: list[str]) -> Scaler:
        from .quantiles import quantiles  # it builds on this module

        aggs = {
            "standard": lambda x: {"shift": F.avg(x), "scale": F.stddev_pop(x)},
            "minmax": lambda x: {"shift": F.min(x), "scale": F.max(x) - F.min(x)},
            "maxabs": lambda x: {"shift": F.lit(0.0), "scale": F.max(F.abs(x))},
        }
        if self.method in aggs:
            exprs = {f: aggs[self.method](number(f)) for f in features}
            row = df.agg(*[e.alias(f"{f}\t{k}") for f, x in exprs.items() for k, e in x.items()]).head()
            self.stats = {f: {"shift": row[f"{f}\tshift"], "scale": row[f"{f}\tscale"] or 1.0} for f in features}
        elif self.method == "robust":
            row = quantiles(df, features, [0.25, 0.5, 0.75]).head()
            self.stats = {f: {"shift": row[f][1], "scale": (row[f][2] - row[f][0]) or 1.0} for f in features}
        elif self.method == "quantile":
            n = int(self.params.get("n_quantiles", 100))
            row = quantiles(df, features, [i / (n - 1) for i in range(n)]).head()
            self.stats = {f: {"grid": list(row[f])} for f in features}
        elif self.method in ("yeo_johnson", "box_cox"):
            self.stats = {f: {"lambda": _power_lambda(df, f, self.method)} for f in features}
        else:
            raise ValueError(f"unknown scaler {self.method!r}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: self._forward(number(f), s) for f, s in self.stats.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        """Undo `transform`; what the quantile method has cut to its ends comes back as the least or greatest value."""
        return df.withColumns({f: self._backward(number(f), s) for f, s in self.stats.items()})

    def set_params(self, **params) -> Scaler:
        """New parameters; the scaler must be fitted again."""
        self.params, self.stats = {**self.params, **params}, {}
        return self

    def _backward(self, y: Column, s: dict) -> Column:
        if "shift" in s:
            return y * s["scale"] + s["shift"]
        if "grid" in s:
            return piecewise(y, [i / (len(s["grid"]) - 1) for i in range(len(s["grid"]))], s["grid"])
        return yeo_johnson_inverse(y, s["lambda"]) if self.method == "yeo_johnson" else box_cox_inverse(y, s["lambda"])

    def _forward(self, x: Column, s: dict) -> Column:
        if "shift" in s:
            return (x - s["shift"]) / s["scale"]
        if "grid" in s:
            return piecewise(x, s["grid"], [i / (len(s["grid"]) - 1) for i in range(len(s["grid"]))])
        return yeo_johnson(x, s["lambda"]) if self.method == "yeo_johnson" else box_cox(x, s["lambda"])


def piecewise(x: Column, knots: list[float], values: list[float]) -> Column:
    """Linear interpolation between increasing knots, constant outside; repeated knots give the mean of their values."""
    merged: dict[float, list[float]] = {}
    for k, v in zip(knots, values, strict=True):
        merged.setdefault(k, []).append(v)
    xs = sorted(merged)
    ys = [sum(merged[k]) / len(merged[k]) for k in xs]
    out = F.lit(ys[-1])
    for i in reversed(range(len(xs) - 1)):
        out = F.when(x < xs[i + 1], ys[i] + (x - xs[i]) * ((ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= xs[0], F.lit(ys[0])).otherwise(out))


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if abs(lam) < 1e-9 else F.pow(y * lam + 1, F.lit(1 / lam))


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.expm1(y) if abs(lam) < 1e-9 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    down = -F.expm1(-y) if abs(lam - 2) < 1e-9 else 1 - F.pow(1 - y * (2 - lam), F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)


def _power_lambda(df: DataFrame, feature: str, method: str) -> float:
    """The lambda of greatest likelihood between -3 and 3: each of eight rounds is one aggregate over a grid of seven values, and the next grid lies around the best."""
    x = number(feature)
    jacobian = F.sum(F.log(x)) if method == "box_cox" else F.sum(F.signum(x) * F.log1p(F.abs(x)))
    shape = box_cox if method == "box_cox" else yeo_johnson
    lo, hi = -3.0, 3.0
    for _ in range(8):
        grid = [lo + (hi - lo) * i / 6 for i in range(7)]
        row = df.agg(F.count(x).alias("n"), jacobian.alias("j"), *[F.var_pop(shape(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).head()
        like = [(-row.n / 2 * math.log(row[f"v{i}"]) + (g - 1) * row.j) if row[f"v{i}"] else -math.inf for i, g in enumerate(grid)]
        best = max(range(7), key=like.__getitem__)
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, 6)]
    return (lo + hi) / 2


def row_norm(features: list[str], norm: str = "l2") -> Column:
    xs = [number(f) for f in features]
    if norm == "l2":
        return F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
    if norm == "l1":
        return sum((F.abs(x) for x in xs[1:]), F.abs(xs[0]))
    return F.greatest(*[F.abs(x) for x in xs], F.lit(0.0))


def normalise_rows(df: DataFrame, features: list[str], norm: str = "l2", keep: str = "norm") -> DataFrame:
    """Divide each row by its norm, which is kept in a column; rows of norm 0 stay."""
    size = F.when(row_norm(features, norm) == 0, 1.0).otherwise(row_norm(features, norm))
    return df.withColumn(keep, size).withColumns({f: number(f) / F.col(keep) for f in features})


def normalise_columns(df: DataFrame, features: list[str], norm: str = "max") -> DataFrame:
    """Divide each column by its norm over all rows (one aggregate)."""
    return df.withColumns({f: number(f) / n for f, n in column_norms(df, features, norm).items()})


def column_norms(df: DataFrame, features: list[str], norm: str = "max") -> dict[str, float]:
    """What `normalise_columns` divides by, to be kept for `denormalise_columns`."""
    size = {"max": lambda x: F.max(F.abs(x)), "l1": lambda x: F.sum(F.abs(x)), "l2": lambda x: F.sqrt(F.sum(x * x))}[norm]
    row = df.agg(*[size(number(f)).alias(f) for f in features]).head()
    return {f: row[f] or 1.0 for f in features}


def denormalise_columns(df: DataFrame, norms: dict[str, float]) -> DataFrame:
    return df.withColumns({f: number(f) * n for f, n in norms.items()})


def denormalise_rows(df: DataFrame, features: list[str], kept: str = "norm") -> DataFrame:
    return df.withColumns({f: number(f) * F.col(kept) for f in features}).drop(kept)


def scaled_within(df: DataFrame, features: list[str], by: list[str], method: str = "standard") -> DataFrame:
    """Scale within groups, by a window."""
    w = Window.partitionBy(*by)

    def one(f: str) -> Column:
        x = number(f)
        if method == "standard":
            s = F.stddev_pop(x).over(w)
            return (x - F.avg(x).over(w)) / F.when(s == 0, 1.0).otherwise(s)
        span = F.max(x).over(w) - F.min(x).over(w)
        return (x - F.min(x).over(w)) / F.when(span == 0, 1.0).otherwise(span)

    return df.withColumns({f: one(f) for f in features})


def geometric_mean(c: str | Column) -> Column:
    """Aggregate: the n-th root of the product of positive values, 0 if any is 0, null if any is negative."""
    x = number(c)
    return F.when(F.min(x) < 0, F.lit(None).cast("double")).when(F.min(x) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(F.when(x > 0, x)))))


def compensate(df: DataFrame, features: list[str], spill: list[list[float]]) -> DataFrame:
    """Undo spillover: the rows y of y S = x, as linear expressions with the inverse of the small matrix S."""
    import numpy as np

    inverse = np.linalg.inv(np.array(spill, dtype=float))
    xs = [number(f) for f in features]
    return df.withColumns({f: sum((xs[i] * float(inverse[i, j]) for i in range(1, len(xs))), xs[0] * float(inverse[0, j])) for j, f in enumerate(features)})
