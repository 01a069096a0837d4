"""Summaries over samples, feature tables, and statistical tests.

Group statistics are hash aggregates with partial sums; only a few numbers reach the driver, where p-values are computed.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.quantiles import quantiles, running
from ..functions.transforms import geometric_mean, number

#: Aggregates by name; moments are those of a population, as usual for descriptive statistics.
DESCRIBE = {
    "mean": F.avg,
    "SD": F.stddev_pop,
    "median": None,  # a quantile, see describe
    "CV": lambda x: F.try_divide(F.stddev_pop(x), F.avg(x)),
    "skew": F.skewness,
    "kurtosis": F.kurtosis,
    "gmean": geometric_mean,
}


def describe(events: DataFrame, channel: str, by: list[str], stats: list[str] | None = None) -> DataFrame:
    """Descriptive statistics of a channel for each group: one aggregate, and quantiles for the median."""
    x, stats = number(channel), stats or list(DESCRIBE)
    out = events.groupBy(*by).agg(F.count("*").alias("_n"), *[DESCRIBE[s](x).alias(s) for s in stats if s != "median"])
    if "median" in stats:
        median = quantiles(events, [channel], [0.5], by).select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col(channel)[0].alias("median"))
        on = F.lit(True)
        for i, b in enumerate(by):
            on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
        out = out.join(median, on)
    return out.select(*by, *stats)


def ratios(stats: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """n1 / n2 of pairs of populations within each sample, one aggregate and a small self join; null where n2 is 0."""
    a = stats.select("sample_id", F.col("population").alias("p1"), F.col("n").alias("n1"))
    b = stats.select("sample_id", F.col("population").alias("p2"), F.col("n").alias("n2"))
    a = a.where(F.col("p1") == first) if first else a
    b = b.where(F.col("p2") == second) if second else b
    return a.join(b, "sample_id").where("p1 != p2").select("sample_id", F.concat_ws(":", "p1", "p2").alias("ratio"), F.try_divide("n1", "n2").alias("value"))


def feature_table(stats: DataFrame, populations: list[str]) -> DataFrame:
    """One row for each sample: <population>_N, _FOR and _FOP."""
    aggs = []
    for p in populations:
        own = F.col("population") == p
        aggs += [F.max(F.when(own, F.col(c))).alias(f"{p}_{s}") for c, s in (("n", "N"), ("frac_of_root", "FOR"), ("frac_of_parent", "FOP"))]
    return stats.groupBy("sample_id").agg(*aggs)


def variance_order(df: DataFrame, ids: list[str]) -> DataFrame:
    """Sample variance of each variable, in falling order: one pass, unpivoted afterwards."""
    features = [c for c in df.columns if c not in ids]
    row = df.agg(*[F.var_samp(number(f)).alias(f) for f in features])
    return row.unpivot([], features, "variable", "variance").orderBy(F.desc("variance"))


def average_ranks(df: DataFrame, value: str, to: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Ranks with ties averaged. Values are first counted, and distinct ones ordered bucket by bucket."""
    by = by or []
    counts = running(df.groupBy(*by, value).agg(F.count("*").alias("_k")), value, "_k", "_below", by)
    ranked = counts.withColumn(to, F.col("_below") + (F.col("_k") + 1) / 2).drop("_k", "_below")
    return df.join(ranked, [*by, value])


def correlation(df: DataFrame, features: list[str], method: str = "pearson") -> DataFrame:
    """feature_a, feature_b, r for all pairs, in one aggregate (after ranking, for spearman)."""
    cols = {f: f for f in features}
    if method == "spearman":
        df = df.select(*[number(f).alias(f) for f in features]).dropna()
        for f in features:
            df = average_ranks(df, f, f"_r_{f}")
        cols = {f: f"_r_{f}" for f in features}
    pairs = list(itertools.combinations_with_replacement(features, 2))
    row = df.agg(*[F.corr(number(cols[a]), number(cols[b])).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(cells))


def group_moments(df: DataFrame, between: str, value: str) -> DataFrame:
    x = number(value)
    return df.groupBy(between).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def _moments(df: DataFrame, between: str, value: str) -> list:
    return [r for r in group_moments(df, between, value).orderBy(between).collect() if r[0] is not None and r.n]


def anova(df: DataFrame, between: str, value: str) -> dict[str, float]:
    """One-way F test for equal variances."""
    g = _moments(df, between, value)
    n, k = sum(r.n for r in g), len(g)
    mean = sum(r.n * r.mean for r in g) / n
    between_ss, within_ss = sum(r.n * (r.mean - mean) ** 2 for r in g), sum((r.n - 1) * (r.var or 0.0) for r in g)
    f = (between_ss / (k - 1)) / (within_ss / (n - k))
    return {"F": f, "df1": k - 1, "df2": n - k, "p": D.f_p(f, k - 1, n - k)}


def welch_anova(df: DataFrame, between: str, value: str) -> dict[str, float]:
    g = _moments(df, between, value)
    w = [r.n / r.var for r in g]
    k, total = len(g), sum(w)
    mean = sum(a * r.mean for a, r in zip(w, g, strict=True)) / total
    spread = sum((1 - a / total) ** 2 / (r.n - 1) for a, r in zip(w, g, strict=True))
    f = (sum(a * (r.mean - mean) ** 2 for a, r in zip(w, g, strict=True)) / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * spread)
    df2 = (k * k - 1) / (3 * spread)
    return {"F": f, "df1": k - 1, "df2": df2, "p": D.f_p(f, k - 1, df2)}


def post_hoc(df: DataFrame, between: str, value: str, equal_variance: bool = True) -> list[dict]:
    """Tukey's test of all pairs of groups, or Games-Howell's without equal variances."""
    g, out = _moments(df, between, value), []
    n, k = sum(r.n for r in g), len(g)
    pooled = sum((r.n - 1) * r.var for r in g) / (n - k)
    for a, b in itertools.combinations(g, 2):
        va, vb = (pooled / a.n, pooled / b.n) if equal_variance else (a.var / a.n, b.var / b.n)
        dof = n - k if equal_variance else (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
        q = abs(a.mean - b.mean) / math.sqrt((va + vb) / 2)
        out.append({"a": a[0], "b": b[0], "diff": a.mean - b.mean, "q": q, "p": D.studentised_range_p(q, k, dof)})
    return out


def t_test(df: DataFrame, between: str, value: str, equal_variance: bool = False) -> dict[str, float]:
    """Two groups; Welch's test unless variances are taken as equal."""
    g = _moments(df, between, value)
    if len(g) != 2:
        raise ValueError("a t-test needs two groups")
    a, b = g
    if equal_variance:
        dof = a.n + b.n - 2
        pooled = ((a.n - 1) * a.var + (b.n - 1) * b.var) / dof
        se = math.sqrt(pooled / a.n + pooled / b.n)
    else:
        va, vb = a.var / a.n, b.var / b.n
        se, dof = math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    t = (a.mean - b.mean) / se
    return {"t": t, "df": dof, "p": D.t_p(t, dof)}


def paired_t_test(df: DataFrame, first: str, second: str) -> dict[str, float]:
    d = number(first) - number(second)
    r = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")).head()
    t = r["mean"] / (r.sd / math.sqrt(r.n))
    return {"t": t, "df": r.n - 1, "p": D.t_p(t, r.n - 1)}


def _ties(df: DataFrame, value: str) -> Column | float:
    t = df.groupBy(value).agg(F.count("*").cast("double").alias("k"))
    return t.agg(F.sum(F.col("k") ** 3 - F.col("k")).alias("t")).head().t or 0.0


def kruskal(df: DataFrame, between: str, value: str) -> dict[str, float]:
    """H with average ranks and tie correction."""
    data = df.select(between, number(value).alias(value)).dropna()
    g = average_ranks(data, value).groupBy(between).agg(F.count("*").alias("n"), F.sum("rank").alias("r")).collect()
    n = sum(x.n for x in g)
    h = 12 / (n * (n + 1)) * sum(x.r**2 / x.n for x in g) - 3 * (n + 1)
    h /= 1 - _ties(data, value) / (n**3 - n)
    return {"H": h, "df": len(g) - 1, "p": D.chi2_p(h, len(g) - 1)}


def mann_whitney(df: DataFrame, between: str, value: str) -> dict[str, float]:
    """U of the first group by name; normal approximation with tie and continuity correction."""
    data = df.select(between, number(value).alias(value)).dropna()
    g = average_ranks(data, value).groupBy(between).agg(F.count("*").alias("n"), F.sum("rank").alias("r")).orderBy(between).collect()
    if len(g) != 2:
        raise ValueError("the test needs two groups")
    (a, b), n = g, sum(x.n for x in g)
    u = a.r - a.n * (a.n + 1) / 2
    sd = math.sqrt(a.n * b.n / 12 * (n + 1 - _ties(data, value) / (n * (n - 1))))
    z = max(0.0, abs(u - a.n * b.n / 2) - 0.5) / sd
    return {"U": u, "p": min(1.0, 2 * D.normal_sf(z))}


def wilcoxon(df: DataFrame, first: str, second: str) -> dict[str, float]:
    """Signed ranks of paired values; zero differences are left out; normal approximation with tie correction."""
    d = df.select((number(first) - number(second)).alias("d")).where("d != 0").withColumn("a", F.abs("d"))
    r = average_ranks(d, "a").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("up")).head()
    n, down = r.n, r.n * (r.n + 1) / 2 - r.up
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - _ties(d, "a") / 48)
    z = (min(r.up, down) - n * (n + 1) / 4) / sd
    return {"W": min(r.up, down), "p": min(1.0, 2 * D.normal_sf(abs(z)))}


def friedman(df: DataFrame, subject: str, columns: list[str]) -> dict[str, float]:
    """Repeated measures in columns, ranked within each row."""
    xs = [number(c) for c in columns]
    rank = lambda x: sum(((y < x).cast("double") + (y == x).cast("double") / 2 for y in xs), F.lit(0.5))
    row = df.dropna(subset=columns).agg(F.count("*").alias("n"), *[F.sum(rank(x)).alias(f"r{i}") for i, x in enumerate(xs)], sum((F.sum(rank(x) ** 2) for x in xs[1:]), F.sum(rank(xs[0]) ** 2)).alias("sq")).head()
    n, k = row.n, len(columns)
    between = sum((row[f"r{i}"] - n * (k + 1) / 2) ** 2 for i in range(k)) / n
    within = (row.sq - n * k * (k + 1) ** 2 / 4) / (n * (k - 1))
    q = between / within if within else 0.0
    return {"Q": q, "df": k - 1, "p": D.chi2_p(q, k - 1)}


def jarque_bera(df: DataFrame, value: str) -> dict[str, float]:
    """Normality from skewness and excess kurtosis, in one pass."""
    x = number(value)
    r = df.agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k")).head()
    jb = r.n / 6 * (r.s**2 + r.k**2 / 4)
    return {"JB": jb, "p": D.chi2_p(jb, 2)}


#: Rows for which the Shapiro-Wilk p-value's approximation was made.
SHAPIRO_ROWS = 5000


def shapiro(df: DataFrame, value: str) -> dict[str, float]:
    """W and p of Shapiro-Wilk's test by Royston's approximation (AS R94), which holds for 3 to SHAPIRO_ROWS values; more are an error."""
    x = sorted(r.v for r in df.select(number(value).alias("v")).where("v is not null").limit(SHAPIRO_ROWS + 1).collect())
    n = len(x)
    if not 3 <= n <= SHAPIRO_ROWS:
        raise ValueError(f"the test is made for 3 to {SHAPIRO_ROWS} values; see jarque_bera")
    m = [D.normal_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    size, u = sum(v * v for v in m), 1 / math.sqrt(n)
    # fixed values: Royston's polynomials
    last = -2.706056 * u**5 + 4.434685 * u**4 - 2.071190 * u**3 - 0.147981 * u**2 + 0.221157 * u + m[-1] / math.sqrt(size)
    second = -3.582633 * u**5 + 5.682633 * u**4 - 1.752461 * u**3 - 0.293762 * u**2 + 0.042981 * u + m[-2] / math.sqrt(size)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    elif n <= 5:
        phi = (size - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = [-last, *(v / math.sqrt(phi) for v in m[1:-1]), last]
    else:
        phi = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = [-last, -second, *(v / math.sqrt(phi) for v in m[2:-2]), second, last]
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    w = sum(c * v for c, v in zip(a, x, strict=True)) ** 2 / spread if spread else 1.0
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(w, 1.0))) - math.asin(math.sqrt(0.75))))
    else:
        # fixed values: Royston's mean and deviation of the transformed statistic
        if n <= 11:
            y, mu = -math.log(-2.273 + 0.459 * n - math.log(max(1 - w, 1e-300))), 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
            sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        else:
            k = math.log(n)
            y, mu = math.log(max(1 - w, 1e-300)), -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
            sigma = math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
        p = D.normal_sf((y - mu) / sigma)
    return {"W": w, "p": p}


def normality(df: DataFrame, variables: list[str], method: str = "shapiro", alpha: float = 0.05) -> list[dict]:
    """Each variable's statistic, p and whether it may be normal."""
    test = {"shapiro": shapiro, "jarque_bera": jarque_bera}[method]
    out = []
    for v in variables:
        r = test(df, v)
        out.append({"variable": v, "statistic": next(iter(r.values())), "p": r["p"], "normal": r["p"] > alpha})
    return out


def levene(df: DataFrame, between: str, value: str) -> dict[str, float]:
    """Equal variances: an F test of distances from group medians."""
    medians = quantiles(df, [value], [0.5], [between]).select(between, F.col(value)[0].alias("_m"))
    away = df.join(medians, between).withColumn("_d", F.abs(number(value) - F.col("_m")))
    return anova(away, between, "_d")


def by_variable(test, df: DataFrame, between: str, variables: list[str], adjust: str = "holm") -> list[dict]:
    """One test for each variable, p-values adjusted together."""
    rows = [{"variable": v, **test(df, between, v)} for v in variables]
    for r, p in zip(rows, D.ADJUST[adjust]([r["p"] for r in rows]), strict=True):
        r["p_adjusted"] = p
    return rows


def five_numbers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Minimum, quartiles and maximum for each group: the data of a box plot."""
    q = quantiles(df, [value], [0.0, 0.25, 0.5, 0.75, 1.0], by).withColumnRenamed(value, "q")
    return q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def histogram2d(df: DataFrame, x: str, y: str, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Counts on an equally spaced grid: the data of a two-dimensional plot."""
    cell = lambda c, r: F.width_bucket(number(c), F.lit(float(r[0])), F.lit(float(r[1])), F.lit(bins))
    out = df.select(cell(x, x_range).alias("bx"), cell(y, y_range).alias("by")).groupBy("bx", "by").agg(F.count("*").alias("n"))
    return out.where(F.col("bx").between(1, bins) & F.col("by").between(1, bins))


def qq_table(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """Quantiles of the data at plotting positions: the data of a QQ plot."""
    at = [(i + 0.5) / points for i in range(points)]
    q = quantiles(df, [value], at).withColumnRenamed(value, "q")
    return q.select(F.posexplode("q").alias("i", "quantile")).withColumn("position", (F.col("i") + 0.5) / points)


def meta_field(df: DataFrame, json_col: str, path: str, to: str) -> DataFrame:
    """A nested field of a JSON column."""
    return df.withColumn(to, F.get_json_object(json_col, path))


class PCA:
    """Principal components of standardised rows without missing values; each component's largest loading is positive."""

    def __init__(self, features: list[str], k: int, scale: bool = True) -> None:
        self.features, self.k, self.scale = features, k, scale

    def fit(self, df: DataFrame) -> PCA:
        import numpy as np

        data = df.select(*[number(f).alias(f) for f in self.features]).dropna()
        pairs = list(itertools.combinations_with_replacement(range(len(self.features)), 2))
        row = data.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(self.features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(self.features)], *[F.covar_pop(self.features[i], self.features[j]).alias(f"c{i}_{j}") for i, j in pairs]).head()
        self.mean = np.array([row[f"m{i}"] for i in range(len(self.features))])
        self.sd = np.array([(row[f"s{i}"] or 1.0) if self.scale else 1.0 for i in range(len(self.features))])
        cov = np.zeros((len(self.features),) * 2)
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] / (self.sd[i] * self.sd[j])
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[: self.k]
        self.components = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
        self.ratio = values[order] / values.sum()
        return self

    def transform(self, df: DataFrame, prefix: str = "PCA") -> DataFrame:
        """Scores as expressions, one column for each component."""
        z = [(number(f) - float(self.mean[i])) / float(self.sd[i]) for i, f in enumerate(self.features)]
        return df.withColumns({f"{prefix}{j + 1}": sum((z[i] * float(self.components[i, j]) for i in range(1, len(z))), z[0] * float(self.components[0, j])) for j in range(self.k)})

    def ellipses(self, df: DataFrame, label: str, components: tuple[int, int] = (0, 1), s: float = 3.0) -> DataFrame:
        """label, x, y, width, height, angle: the ellipse of s standard deviations around each label's scores."""
        a, b = (F.col(f"PCA{c + 1}") for c in components)
        m = self.transform(df).groupBy(label).agg(F.avg(a).alias("x"), F.avg(b).alias("y"), F.var_samp(a).alias("xx"), F.var_samp(b).alias("yy"), F.covar_samp(a, b).alias("xy"))
        mean, half = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2.0)) + F.col("xy") ** 2)
        angle = F.degrees(F.atan2(mean + half - F.col("xx"), F.col("xy")))
        return m.select(label, "x", "y", (2 * s * F.sqrt(mean + half)).alias("width"), (2 * s * F.sqrt(F.greatest(mean - half, F.lit(0.0)))).alias("height"), F.when(F.col("xy") != 0, angle).when(F.col("xx") >= F.col("yy"), 0.0).otherwise(90.0).alias("angle"))

    def loadings(self, component: int = 0) -> dict[str, float]:
        return {f: abs(float(self.components[i, component])) for i, f in enumerate(self.features)}
