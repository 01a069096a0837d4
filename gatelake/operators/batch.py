"""Batch effects: reference samples, divergences, registration, correction, and mixing scores."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import density
from ..functions.transforms import number, piecewise
from .sampling import TREE_ROWS, uniform

SAMPLE = "sample_id"
#: Events that a block of space has, about, where neighbours are sought.
BLOCK_ROWS = 4096


def covariances(events: DataFrame, features: list[str]) -> DataFrame:
    """The sample covariance matrix of each sample, flattened, in one aggregate."""
    cells = [F.covar_samp(number(a), number(b)) for a, b in itertools.product(features, features)]
    return events.groupBy(SAMPLE).agg(F.array(*cells).alias("cov"))


def covariance_distances(events: DataFrame, features: list[str]) -> DataFrame:
    """a, b, distance: Frobenius norm of the difference of covariances for all ordered pairs of samples (a row for each sample is paired, not events)."""
    cov = covariances(events, features)
    a, b = cov.select(F.col(SAMPLE).alias("a"), F.col("cov").alias("ca")), cov.select(F.col(SAMPLE).alias("b"), F.col("cov").alias("cb"))
    square = F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    return a.crossJoin(b).select("a", "b", F.sqrt(square).alias("distance"))


def reference_sample(events: DataFrame, features: list[str]) -> DataFrame:
    """The sample whose covariance is on average closest to all samples' (its own included)."""
    mean = covariance_distances(events, features).groupBy("a").agg(F.avg("distance").alias("mean_distance"))
    return mean.orderBy("mean_distance", "a").limit(1).withColumnRenamed("a", SAMPLE)


def histograms(events: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """sample_id, p: shares of each sample's values in equal bins."""
    cell = F.least(F.floor((number(column) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    n = events.where(number(column).between(lo, hi)).groupBy(SAMPLE, cell.alias("bin")).agg(F.count("*").alias("n"))
    counts = n.groupBy(SAMPLE).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    p = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0)) / F.col("total"))
    return counts.select(SAMPLE, p.alias("p"))


def divergences(events: DataFrame, column: str, lo: float, hi: float, bins: int = 32) -> DataFrame:
    """a, b, jsd: Jensen-Shannon distance (natural logarithm) of all ordered pairs of samples."""
    h = histograms(events, column, lo, hi, bins)
    a, b = h.select(F.col(SAMPLE).alias("a"), F.col("p").alias("pa")), h.select(F.col(SAMPLE).alias("b"), F.col("p").alias("pb"))
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    terms = F.zip_with("pa", "pb", lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2
    return a.crossJoin(b).select("a", "b", F.sqrt(F.greatest(total, F.lit(0.0))).alias("jsd"))


def similarity_matrix(events: DataFrame, reference: str, features: list[str], components: int = 2, bins: int = 16, metric: str = "jsd", *, reducer: str = "pca", reducer_params: dict | None = None, kernel: bool = False, bandwidth: float | str = "scott") -> pd.DataFrame:
    """Distances between samples after projection on the reference sample's components (of pca, kernel_pca or diffusion).

    Densities are on a common grid of bins ** components: shares of its cells, or, with `kernel`, product-normal kernel densities at its points.
    """
    data, scores = _projected(events, reference, features, components, reducer, reducer_params or {})
    row = data.agg(*[F.min(s).alias(f"lo{i}") for i, s in enumerate(scores)], *[F.max(s).alias(f"hi{i}") for i, s in enumerate(scores)]).head()
    lo, hi = [row[f"lo{i}"] for i in range(components)], [row[f"hi{i}"] for i in range(components)]
    if kernel:
        found = kernel_densities(data, scores, lo, hi, bins, bandwidth)
        names, p = list(found), np.array([d.ravel() + 1e-300 for d in found.values()])
    else:
        cells = [F.least(F.floor((F.col(s) - lo[i]) / (((hi[i] - lo[i]) or 1.0) / bins)), F.lit(bins - 1)).cast("int") for i, s in enumerate(scores)]
        flat = sum((c * bins**i for i, c in enumerate(cells[1:], 1)), cells[0])
        got = data.groupBy(SAMPLE, flat.alias("cell")).agg(F.count("*").alias("n")).toPandas()  # at most bins ** components rows a sample
        table = got.pivot(index=SAMPLE, columns="cell", values="n").fillna(0.0)
        names, p = table.index, (table.to_numpy() + 1e-9)
    p = p / p.sum(1, keepdims=True)
    how = density.jensen_shannon if metric == "jsd" else density.kullback_leibler
    return pd.DataFrame([[how(a, b) for b in p] for a in p], index=pd.Index(names, name=SAMPLE), columns=names)


def _projected(events: DataFrame, reference: str, features: list[str], k: int, method: str, params: dict) -> tuple[DataFrame, list[str]]:
    """sample_id and scores of all events in the reference sample's space."""
    from .embedding import METHODS, reduced

    prefix = METHODS[method].name if method in METHODS else "PCA"
    scores = [f"{prefix}{i + 1}" for i in range(k)]
    return reduced(events, features, method, k, events.where(F.col(SAMPLE) == reference), **params).select(SAMPLE, *scores).dropna(subset=scores), scores


def kernel_densities(data: DataFrame, axes: list[str], lo: list[float], hi: list[float], bins: int, bandwidth: float | str = "scott") -> dict:
    """Each sample's product-normal kernel density at the points of a grid, exact: all events count at every point.

    A task adds up products of its events' kernels along the axes, so a grid for each sample is all that leaves it. Bandwidths are Scott's, by
    sample and axis, or one number.
    """
    d = len(axes)
    stats = {r[SAMPLE]: r for r in data.groupBy(SAMPLE).agg(F.count("*").alias("n"), *[F.stddev_samp(a).alias(f"s{i}") for i, a in enumerate(axes)]).collect()}  # a row a sample
    wide = {s: [float(bandwidth) if bandwidth != "scott" else (r[f"s{i}"] or 1.0) * r.n ** (-1 / (d + 4)) for i in range(d)] for s, r in stats.items()}
    points = [np.linspace(a, b, bins) for a, b in zip(lo, hi, strict=True)]
    kind = data.schema[SAMPLE].dataType.simpleString()
    letters = "abcdefgh"[:d]
    product = ",".join(f"n{c}" for c in letters) + "->" + letters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for s, own in pdf.groupby(SAMPLE):
                for i in range(0, len(own), 4096):
                    part = own[axes].to_numpy(float)[i : i + 4096]
                    k = [np.exp(-0.5 * ((part[:, j, None] - points[j][None]) / h) ** 2) / (h * np.sqrt(2 * np.pi)) for j, h in enumerate(wide[s])]
                    total[s] = total.get(s, 0.0) + np.einsum(product, *k, optimize=True).ravel()
        if total:  # Arrow makes no lists of a column without rows
            yield pd.DataFrame({SAMPLE: list(total), "v": list(total.values())})

    parts = data.select(SAMPLE, *axes).mapInPandas(run, f"{SAMPLE} {kind}, v array<double>")
    got = parts.select(SAMPLE, F.posexplode("v").alias("i", "v")).groupBy(SAMPLE, "i").agg(F.sum("v").alias("v"))
    rows = got.groupBy(SAMPLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("v")).collect()  # a grid a sample
    return {r[SAMPLE]: np.array(r.v).reshape((bins,) * d) / stats[r[SAMPLE]].n for r in sorted(rows, key=lambda r: str(r[SAMPLE]))}


def register(events: DataFrame, column: str, reference: DataFrame, *, to: str | None = None, **peaks) -> DataFrame:
    """events with the column warped so that its density's peaks fall on the reference's: a piecewise-linear expression, applied in the JVM."""
    target, own = density.kde(reference, column), density.kde(events, column)
    xs, ys = density.warp_knots(target, own, **peaks)
    return events.withColumn(to or column, piecewise(number(column), xs, ys))


class Harmony:
    """Iterative soft-clustering correction of sample effects in a scaled space.

    Cluster centres, and the offset of each sample in each cluster, are small tables on the driver. Each round streams all events past them twice
    in Arrow batches and brings back sums only; the correction itself is one more pass.
    """

    def __init__(self, features: list[str], clusters: int = 20, sigma: float = 0.1, theta: float = 2.0, ridge: float = 1.0, rounds: int = 10, seed: int = 42) -> None:
        self.features, self.clusters, self.sigma, self.theta, self.ridge, self.rounds, self.seed = features, clusters, sigma, theta, ridge, rounds, seed

    def run(self, events: DataFrame) -> DataFrame:
        """events with every feature corrected (in its own units)."""
        f = self.features
        row = events.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(f)], *[F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(f)]).head()
        mean, sd = (np.array([row[f"{k}{i}"] for i in range(len(f))]) for k in "ms")
        sd = np.where(sd > 0, sd, 1.0)
        shares = {r[SAMPLE]: r.n for r in events.groupBy(SAMPLE).agg(F.count("*").alias("n")).collect()}
        names = sorted(shares, key=str)
        share = np.array([shares[s] for s in names], float) / sum(shares.values())
        place = {s: i for i, s in enumerate(names)}
        start = uniform(events, self.clusters, id_col="event_id", seed=self.seed).orderBy("event_id").select(*[number(c).alias(c) for c in f]).toPandas().to_numpy(float)
        state = {"centres": (start - mean) / sd, "offset": np.zeros((len(start), len(names), len(f))), "bias": np.ones((len(start), len(names)))}

        def soft(x: np.ndarray, b: np.ndarray, s: dict) -> np.ndarray:
            unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            r = np.exp(-2 * (1 - unit(x) @ unit(s["centres"]).T) / self.sigma) * s["bias"][:, b].T
            return r / np.maximum(r.sum(1, keepdims=True), 1e-300)

        def shift(x: np.ndarray, b: np.ndarray, s: dict, r: np.ndarray) -> np.ndarray:
            return x - np.einsum("nk,nkd->nd", r, s["offset"][:, b].transpose(1, 0, 2))

        k, n_b, d = len(start), len(names), len(f)
        schema = "kind int, value array<double>"

        def sums(s: dict):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                mass, moved, raw = np.zeros((k, n_b)), np.zeros((k, d)), np.zeros((k, n_b, d))
                for pdf in batches:
                    x, b = (pdf[f].to_numpy(float) - mean) / sd, pdf[SAMPLE].map(place).to_numpy(int)
                    r = soft(shift(x, b, s, soft(x, b, s)), b, s)
                    now = shift(x, b, s, r)
                    moved += r.T @ now
                    for j in np.unique(b):
                        own = b == j
                        mass[:, j] += r[own].sum(0)
                        raw[:, j] += r[own].T @ x[own]
                yield pd.DataFrame({"kind": [0, 1, 2], "value": [mass.ravel(), moved.ravel(), raw.ravel()]})

            return run

        data = events.select(SAMPLE, *[number(c).alias(c) for c in f]).dropna()
        for _ in range(self.rounds):
            got = data.mapInPandas(sums(state), schema).select("kind", F.posexplode("value").alias("i", "v")).groupBy("kind", "i").agg(F.sum("v").alias("v")).toPandas()
            part = lambda kind: got[got.kind == kind].sort_values("i").v.to_numpy()  # noqa: E731, B023
            mass, moved, raw = part(0).reshape(k, n_b), part(1).reshape(k, d), part(2).reshape(k, n_b, d)
            total = mass.sum(1)
            state["centres"] = moved / np.maximum(total, 1e-12)[:, None]
            state["bias"] = ((total[:, None] * share + 1) / (mass + 1)) ** self.theta
            middle = raw.sum(1) / np.maximum(total, 1e-12)[:, None]
            new = (raw - mass[:, :, None] * middle[:, None]) / (mass[:, :, None] + self.ridge)
            change = float(np.abs(new - state["offset"]).max())
            state["offset"] = new
            if change < 1e-4:
                break

        def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x, b = (pdf[f].to_numpy(float) - mean) / sd, pdf[SAMPLE].map(place).to_numpy(int)
                now = shift(x, b, state, soft(shift(x, b, state, soft(x, b, state)), b, state))
                yield pdf.assign(**{c: now[:, i] * sd[i] + mean[i] for i, c in enumerate(f)})

        doubles = events.withColumns({c: number(c) for c in f})
        return doubles.mapInPandas(correct, doubles.schema)


def _split(points: np.ndarray, most: int) -> list:
    """A tree of median cuts: (feature, cut, below, above), or () for a block of at most `most` of the points."""
    if len(points) <= most or not (spread := np.ptp(points, axis=0)).max():
        return ()
    f = int(spread.argmax())
    values = np.unique(points[:, f])
    cut = float(values[min(np.searchsorted(values, np.median(points[:, f]), "right"), len(values) - 1)])
    below = points[:, f] < cut
    return f, cut, _split(points[below], most), _split(points[~below], most)


def _blocks(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The block of each row; a node's numbers follow those of the heap that its path makes."""
    out = np.zeros(len(x), np.int64)
    todo = [(tree, np.arange(len(x)), 1)]
    while todo:
        node, rows, at = todo.pop()
        if not node:
            out[rows] = at
            continue
        low = x[rows, node[0]] < node[1]
        todo += [(node[2], rows[low], 2 * at), (node[3], rows[~low], 2 * at + 1)]
    return out


def _nearest(x: np.ndarray, y: np.ndarray, tie: np.ndarray, label: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of x squared distance, tie and label of the k nearest rows of y by (distance, tie)."""
    order = np.argsort(tie, kind="stable")
    y, tie, label = y[order], tie[order], label[order]
    step = max(1, 2_000_000 // max(1, len(y)))
    for i in range(0, len(x), step):
        d = sum((x[i : i + step, f, None] - y[None, :, f]) ** 2 for f in range(x.shape[1]))
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(y) > k else np.full(len(d), np.inf)
        for row, most in zip(d, last, strict=True):
            near = np.flatnonzero(row <= most)
            near = near[np.argsort(row[near], kind="stable")[:k]]
            yield row[near], tie[near], label[near]


def lisi(events: DataFrame, features: list[str], label: str = SAMPLE, neighbours: int = 30, seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """id, lisi: the effective number of labels among each event's nearest neighbours (itself included), for every event that has all features.

    Neighbours are sought among all events: first in the event's own block of space, then in each block that is no farther than the last one
    found. Blocks are cut by a sample of TREE_ROWS events, which changes no result. Equal distances are ordered by a hash of the id; of
    events at one place, the first `neighbours` serve as neighbours for all. A null label is a label of its own.
    """
    xs = [f"_x{i}" for i in range(len(features))]
    data = events.select(id_col, F.col(label).cast("string").alias("_label"), F.xxhash64(id_col).alias("_tie"), *[(number(c) + F.lit(0.0)).alias(x) for c, x in zip(features, xs, strict=True)]).dropna(subset=xs)
    k = neighbours
    salted = Window.partitionBy(*xs, F.pmod("_tie", F.lit(64))).orderBy("_tie")
    few = data.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k)
    listed = few.groupBy(*xs).agg(F.slice(F.array_sort(F.collect_list(F.struct("_tie", "_label"))), 1, k).alias("_own"))
    places = listed.select(*xs, F.inline("_own"))

    sample = uniform(data, TREE_ROWS, id_col=id_col, seed=seed).select(*xs).toPandas()
    share = len(sample) / max(1, data.count())
    tree = _split(np.unique(sample.to_numpy(float), axis=0), max(8, round(BLOCK_ROWS * share)))
    at = ", ".join(f"{x} double" for x in xs)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_block=_blocks(tree, pdf[xs].to_numpy(float)))

    blocked = places.mapInPandas(dealt, f"{at}, _tie long, _label string, _block long")
    boxes = blocked.groupBy("_block").agg(*[f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max))]).toPandas()  # a row a block
    numbers, low, high = boxes["_block"].to_numpy(), boxes[[f"lo{x}" for x in xs]].to_numpy(float), boxes[[f"hi{x}" for x in xs]].to_numpy(float)

    def table(x: np.ndarray, y: pd.DataFrame) -> pd.DataFrame:
        got = list(_nearest(x, y[xs].to_numpy(float), y["_tie"].to_numpy(), y["_label"].to_numpy(object), k))
        return pd.DataFrame(x, columns=xs).assign(_d=[g[0] for g in got], _t=[g[1] for g in got], _l=[g[2] for g in got])

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        return table(np.unique(pdf[xs].to_numpy(float), axis=0), pdf)

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                x = part[xs].to_numpy(float)
                bound = np.where(part["_n"] < k, np.inf, part["_most"])
                d = sum(np.maximum(np.maximum(low[None, :, f] - x[:, f, None], x[:, f, None] - high[None, :, f]), 0) ** 2 for f in range(len(xs)))
                rows, there = np.nonzero((d <= bound[:, None]) & (numbers[None] != _blocks(tree, x)[:, None]))
                yield pd.DataFrame(x[rows], columns=xs).assign(_block=numbers[there])

    def others(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        return table(asked[xs].to_numpy(float), pdf) if len(asked) else pd.DataFrame()

    schema = f"{at}, _d array<double>, _t array<long>, _l array<string>"
    first = blocked.groupBy("_block").applyInPandas(own, schema)
    asked = first.select(*xs, F.size("_d").alias("_n"), F.array_max("_d").alias("_most")).mapInPandas(asking, f"{at}, _block long")
    more = asked.groupBy("_block").cogroup(blocked.groupBy("_block")).applyInPandas(others, schema)
    near = first.unionByName(more).groupBy(*xs).agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("_d", "_t", "_l")))), 1, k).alias("_near"))
    labels = F.col("_near._l")
    squares = F.aggregate(F.array_distinct(labels), F.lit(0.0), lambda n, v: n + F.pow(F.size(F.filter(labels, lambda w: w.eqNullSafe(v))) / F.size(labels), 2))
    return data.join(near.select(*xs, (1 / squares).alias("lisi")), xs).select(id_col, "lisi")


def lisi_distribution(before: DataFrame, after: DataFrame, features: list[str], label: str = SAMPLE, neighbours: int = 30, id_col: str = "event_id") -> DataFrame:
    """data ('Before', 'After'), id and lisi: the scores of events as they were and as they were corrected."""
    one = lambda df, name: lisi(df, features, label, neighbours, id_col=id_col).select(F.lit(name).alias("data"), id_col, "lisi")
    return one(before, "Before").unionByName(one(after, "After"))


def marker_variance(events: DataFrame, reference: str, markers: list[str], samples: list[str] | None = None, grid: int = 128, bandwidth: float | str = "silverman") -> DataFrame:
    """marker, sample_id, x, density: each marker's density in the reference and in the samples compared with it, on the reference's grid."""
    some = events if samples is None else events.where(F.col(SAMPLE).isin([reference, *samples]))
    rows = []
    for m in markers:
        d = density.kde(events.where(F.col(SAMPLE) == reference), m, grid=grid, bandwidth=bandwidth)
        for s, own in density.kde_by(some, m, SAMPLE, float(d.x[0]), float(d.x[-1]), grid=grid, bandwidth=bandwidth).items():
            rows += [(m, str(s), float(x), float(p)) for x, p in zip(own.x, own.p, strict=True)]
    return events.sparkSession.createDataFrame(rows, "marker string, sample_id string, x double, density double")


def dim_reduction_grid(events: DataFrame, reference: str, features: list[str], components: int = 2, method: str = "pca", **params) -> DataFrame:
    """events with the components (PCA1..., or KernelPCA1..., Diffusion1...) of the reference sample, and `is_reference`: every sample is seen in the reference's space."""
    from .embedding import reduced

    out = reduced(events, features, method, components, events.where(F.col(SAMPLE) == reference), **params)
    return out.withColumn("is_reference", F.col(SAMPLE) == reference)


def summed_density(events: DataFrame, columns: list[str], grid: int = 256) -> DataFrame:
    """sample_id, x, density of a column, or of the sum of several, by sample and over one range."""
    total = sum((number(c) for c in columns[1:]), number(columns[0]))
    data = events.select(SAMPLE, total.alias("_v"))
    whole = density.kde(data, "_v", grid=grid)
    each = density.kde_by(data, "_v", SAMPLE, float(whole.x[0]), float(whole.x[-1]), grid=grid)
    rows = [(s, float(x), float(p)) for s, d in each.items() for x, p in zip(d.x, d.p, strict=True)]
    kind = events.schema[SAMPLE].dataType.simpleString()
    return events.sparkSession.createDataFrame(rows, f"sample_id {kind}, x double, density double")


def meta_mask(events: DataFrame, mask, name: str) -> DataFrame:
    """'P' where the mask holds, else 'N'."""
    return events.withColumn(name, F.when(mask, "P").otherwise("N"))
