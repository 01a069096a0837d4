"""Clustering of events, summaries of clusters, and meta-clusters over samples.

Events are assigned on the executors. What is clustered on the driver is bounded: summaries (a row for each sample and cluster) and SOM nodes. Graphs and
densities are those of all events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantiles
from ..functions.transforms import number
from .gates import clustered

SAMPLE, CLUSTER, META = "sample_id", "cluster_label", "meta_label"
#: Methods that find the number of clusters themselves.
SHAPED = ("dbscan", "hdbscan", "graph")


def global_clusters(events: DataFrame, features: list[str], method: str = "kmeans", k: int = 10, seed: int = 42, id_col: str = "event_id", **params) -> DataFrame:
    """events with cluster_label: over all samples, by an ML estimator with k clusters, or by one of SHAPED (see `shaped_clusters`; k is a graph's neighbours)."""
    if method in SHAPED:
        more = {"k": k, "seed": seed} if method == "graph" else {}
        return shaped_clusters(events, features, method, id_col=id_col, **more, **params)
    return clustered(events, features, method, k, seed, **params).withColumnRenamed("cluster", CLUSTER)


def sample_clusters(events: DataFrame, features: list[str], k: int = 10, seed: int = 42, rounds: int = 25) -> DataFrame:
    """events with cluster_label by k-means in each sample. All samples advance together: centres are a small table, each round is one aggregate over the kept events."""
    from .sampling import key

    w = Window.partitionBy(SAMPLE).orderBy(key("event_id", seed), "event_id")
    xs = F.array(*[number(f) for f in features])
    points = events.withColumn("_x", xs).persist(StorageLevel.MEMORY_AND_DISK)
    seeds = points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(SAMPLE, (F.col("_r") - 1).alias("c"), F.col("_x").alias("m"))
    centres = {}
    for r in seeds.collect():  # k rows a sample
        centres.setdefault(r[SAMPLE], {})[r.c] = np.array(r.m, float)
    spark = events.sparkSession
    for _ in range(rounds):
        assigned = _nearest_in_sample(points, centres, spark)
        sums = assigned.groupBy(SAMPLE, CLUSTER).agg(F.count("*").alias("n"), *[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(len(features))]).collect()
        moved = 0.0
        for r in sums:
            new = np.array([r[f"m{i}"] for i in range(len(features))])
            moved = max(moved, float(np.abs(new - centres[r[SAMPLE]][r[CLUSTER]]).max()))
            centres[r[SAMPLE]][r[CLUSTER]] = new
        if moved < 1e-9:
            break
    points.unpersist()
    return _nearest_in_sample(events.withColumn("_x", xs), centres, spark).drop("_x")


def _nearest_in_sample(points: DataFrame, centres: dict, spark) -> DataFrame:
    rows = [(s, [(float(c), [float(v) for v in m]) for c, m in sorted(cs.items())]) for s, cs in centres.items()]
    kind = points.schema[SAMPLE].dataType
    table = spark.createDataFrame(rows, T.StructType([T.StructField(SAMPLE, kind), T.StructField("_cs", T.ArrayType(T.StructType([T.StructField("c", T.DoubleType()), T.StructField("m", T.ArrayType(T.DoubleType()))])))]))
    far = lambda m: F.aggregate(F.zip_with("_x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
    best = F.array_min(F.transform("_cs", lambda c: F.struct(far(c["m"]).alias("d"), c["c"].alias("c"))))
    return points.join(table, SAMPLE).withColumn(CLUSTER, best["c"].cast("int")).drop("_cs")


def summarise(events: DataFrame, features: list[str], how: str = "median", by: tuple[str, ...] = (SAMPLE, CLUSTER)) -> DataFrame:
    """Median or mean of each feature for each cluster of each sample; rows without a cluster are left out."""
    known = events.where(F.col(by[-1]).isNotNull())
    if how == "median":
        return quantiles(known, features, [0.5], by).withColumns({f: F.col(f)[0] for f in features})
    return known.groupBy(*by).agg(*[F.avg(number(f)).alias(f) for f in features])


def sizes(events: DataFrame) -> DataFrame:
    """Rows and share of each cluster in its sample."""
    n = events.groupBy(SAMPLE, CLUSTER).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(SAMPLE)))


def assign_meta(events: DataFrame, meta: DataFrame) -> DataFrame:
    """events with the meta label of their cluster; the table has a row for each sample and cluster."""
    return events.drop(META).join(meta.select(SAMPLE, CLUSTER, META), [SAMPLE, CLUSTER])


def meta_clusters(events: DataFrame, features: list[str], k: int | None = None, how: str = "median", scale: str | None = None, resamples: int = 10, seed: int = 42, *, method: str = "agglomerative", linkage: str = "average", **params) -> DataFrame:
    """Summaries (a row for each sample and cluster) clustered into meta labels.

    agglomerative: k clusters by a linkage, or without k by consensus; more than LINKAGE_ROWS summaries are first summarised by as many centres, which
    keep their weights. Other methods, kmeans, gmm, bisecting_kmeans and those of SHAPED, run on the table of summaries as on events.
    """
    from ..session import stored

    table = summarise(events, features, how)
    if scale:
        r = table.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).head()
        shift, by = ("m", lambda i: r[f"s{i}"]) if scale == "standard" else ("lo", lambda i: r[f"hi{i}"] - r[f"lo{i}"])
        table = table.withColumns({c: (F.col(c) - r[f"{shift}{i}"]) / (by(i) if by(i) else 1.0) for i, c in enumerate(features)})
    table = stored(table.withColumn("_row", F.monotonically_increasing_id()), "summaries")
    if method != "agglomerative":
        more = {"k": k or 10, "seed": seed} if method not in SHAPED else {"k": params.pop("k_neighbours", 15), "seed": seed} if method == "graph" else params
        found = global_clusters(table.drop(CLUSTER), features, method, id_col="_row", **more).select("_row", F.col(CLUSTER).alias(META))
        return assign_meta(events, table.join(found, "_row"))
    if table.count() > LINKAGE_ROWS:
        centred = global_clusters(table.withColumnRenamed(CLUSTER, "_of"), features, "kmeans", LINKAGE_ROWS, seed, initMode="random", maxIter=5).withColumnRenamed(CLUSTER, "_centre").withColumnRenamed("_of", CLUSTER)
        rows = centred.groupBy("_centre").agg(*[F.avg(f).alias(f) for f in features], F.count("*").alias("_n")).toPandas()
    else:
        centred = table.withColumn("_centre", F.col("_row"))
        rows = centred.orderBy(SAMPLE, CLUSTER).select("_centre", *features, F.lit(1).alias("_n")).toPandas()
    x, weights = rows[features].to_numpy(float), rows["_n"].to_numpy(float)
    label = Consensus(seed=seed, resamples=resamples).fit(x).predict(x) if k is None else agglomerate(x, k, linkage=linkage, weights=weights)
    named = events.sparkSession.createDataFrame(pa.table({"_centre": rows["_centre"].to_numpy().astype(np.int64), META: label.astype(np.int32)}))
    return assign_meta(events, centred.join(named, "_centre"))


def graph_meta_clusters(events: DataFrame, features: list[str], k: int = 15, how: str = "median", scale: str | None = None, seed: int = 42) -> DataFrame:
    """Summaries clustered by a shared-neighbour graph and its communities, which are tables, too."""
    return meta_clusters(events, features, None, how, scale, method="graph", k_neighbours=k, seed=seed)


def reset(events: DataFrame, *labels: str) -> DataFrame:
    """events with the labels (by default all) emptied."""
    return events.withColumns({c: F.lit(None).cast(events.schema[c].dataType) for c in labels or (CLUSTER, META) if c in events.columns})


def without_null_features(events: DataFrame, features: list[str]) -> list[str]:
    """The features without missing values, which alone are clustered on."""
    n = {r.feature: r.n_null for r in null_counts(events, features).collect()}
    return [f for f in features if not n[f]]


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n_null: missing values of each column, in one aggregate."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], columns, "feature", "n_null")


LINKAGES = ("average", "single", "complete", "ward")
#: Rows whose distances the driver holds; a larger table is first summarised by as many centres.
LINKAGE_ROWS = 3000


def agglomerate(x: np.ndarray, k: int, distance: np.ndarray | None = None, linkage: str = "average", weights: np.ndarray | None = None) -> np.ndarray:
    """k clusters of at most a few thousand rows by one of LINKAGES, numbered by first member.

    Chains of nearest neighbours find all merges in quadratic time; the lowest ones are made. Rows may stand for several (weights).
    """
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}; known: {', '.join(LINKAGES)}")
    n = len(x)
    size = np.ones(n) if weights is None else np.asarray(weights, float).copy()
    d = np.zeros((n, n)) if distance is None else distance.astype(float).copy()
    if distance is None:
        for f in range(x.shape[1]):
            d += (x[:, f, None] - x[None, :, f]) ** 2
        d = d * (2 * size[:, None] * size[None] / (size[:, None] + size[None])) if linkage == "ward" else np.sqrt(d)
    elif linkage == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    merges, chain, alive = [], [], np.ones(n, bool)
    while len(merges) < n - 1:
        if not chain:
            chain = [int(alive.argmax())]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        merges.append((d[i, j], i, j))
        a, b = size[i], size[j]
        if linkage == "average":
            row = (a * d[i] + b * d[j]) / (a + b)
        elif linkage == "ward":
            row = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        else:
            row = (np.minimum if linkage == "single" else np.maximum)(d[i], d[j])
        row[~alive] = np.inf
        row[i] = row[j] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i], alive[j] = a + b, False
    label = np.arange(n)
    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        p, q = label[i], label[j]
        label[label == max(p, q)] = min(p, q)
    return np.unique(label, return_inverse=True)[1]


def linkage_groups(distance: np.ndarray, names: list[str], k: int) -> list[tuple[str, int]]:
    """Names by group (from 1), sorted by group, from a distance matrix."""
    return sorted(zip(names, (agglomerate(distance, k, distance) + 1).tolist(), strict=True), key=lambda r: (r[1], r[0]))


class Consensus:
    """Consensus clustering of a small table: the k at which the area under the consensus distribution still grows most."""

    def __init__(self, smallest: int = 5, largest: int = 15, resamples: int = 10, share: float = 0.5, seed: int = 42) -> None:
        self.range, self.resamples, self.share, self.seed = (smallest, largest), resamples, share, seed

    def fit(self, x: np.ndarray) -> Consensus:
        lo, hi = self.range
        take = int(len(x) * self.share)
        if take <= hi - 1:
            lo, hi = min(lo, 2), max(3, min(hi, take))
        rng, areas, self.matrices = np.random.default_rng(self.seed), [], {}
        for k in range(lo, hi):
            together, drawn = np.zeros((len(x),) * 2), np.zeros((len(x),) * 2)
            for _ in range(self.resamples):
                rows = np.sort(rng.choice(len(x), max(take, k), replace=False))
                lab = agglomerate(x[rows], k)
                drawn[np.ix_(rows, rows)] += 1
                together[np.ix_(rows, rows)] += lab[:, None] == lab[None]
            m = np.divide(together, drawn, out=np.zeros_like(together), where=drawn > 0)
            np.fill_diagonal(m, 1)
            self.matrices[k] = m
            values = np.sort(m[np.triu_indices(len(x), 1)])
            areas.append(float(np.sum(np.diff(values) * np.arange(1, len(values)) / len(values))) if len(values) > 1 else 0.0)
        gains = [areas[0], *((b - a) / a if a else 0.0 for a, b in zip(areas[:-1], areas[1:], strict=True))]
        self.k = lo + int(np.argmax(gains))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Clusters of the consensus matrix at the chosen k."""
        return agglomerate(x, self.k, 1 - self.matrices[self.k])

    def predict_data(self, x: np.ndarray) -> np.ndarray:
        """Clusters of other rows at the chosen k."""
        return agglomerate(x, min(self.k, len(x)))


class SOM:
    """A self-organising map. Each round of training streams all events past the nodes in Arrow batches and brings back sums by node only."""

    def __init__(self, features: list[str], shape: tuple[int, int] = (10, 10), sigma: float = 1.0, rate: float = 0.5, rounds: int = 20, seed: int = 42) -> None:
        self.features, self.shape, self.sigma, self.rate, self.rounds, self.seed = features, shape, sigma, rate, rounds, seed

    def fit(self, events: DataFrame, id_col: str = "event_id") -> SOM:
        from .sampling import uniform

        n, f = self.shape[0] * self.shape[1], self.features
        data = events.select(id_col, *[number(c).alias(c) for c in f]).dropna()
        x = uniform(data, n, id_col=id_col, seed=self.seed).orderBy(id_col).select(*f).toPandas().to_numpy(float)  # a row a node
        rng = np.random.default_rng(self.seed)
        nodes = x[rng.permutation(len(x)) if len(x) == n else rng.integers(0, len(x), n)].copy()
        data = data.select(*f).persist(StorageLevel.MEMORY_AND_DISK)
        best_of = self._best

        def sums(now: np.ndarray):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros((len(now), len(f) + 1))
                for pdf in batches:
                    rows = pdf[f].to_numpy(float)
                    np.add.at(total, best_of(rows, now), np.column_stack([rows, np.ones(len(rows))]))
                yield pd.DataFrame({"node": np.arange(len(now)), "v": list(total)})

            return run

        grid = np.array([(i, j) for i in range(self.shape[0]) for j in range(self.shape[1])], float)
        apart = ((grid[:, None] - grid[None]) ** 2).sum(-1)
        for t in range(self.rounds):  # batch updates, with a neighbourhood that shrinks to sigma
            width = max(self.sigma, max(self.shape) / 2 * (1 - t / self.rounds))
            got = data.mapInPandas(sums(nodes), "node int, v array<double>").select("node", F.posexplode("v").alias("i", "v")).groupBy("node", "i").agg(F.sum("v").alias("v")).toPandas()
            total = got.pivot(index="node", columns="i", values="v").sort_index().to_numpy(float)
            hit = np.exp(-apart / (2 * width**2))
            mass = hit @ total[:, -1]
            target = np.divide(hit @ total[:, :-1], mass[:, None], out=nodes.copy(), where=mass[:, None] > 0)
            nodes += (self.rate + (1 - self.rate) * (t + 1) / self.rounds) * (target - nodes)
        data.unpersist()
        self.nodes = nodes
        return self

    @staticmethod
    def _best(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = [((nodes**2).sum(1) - 2 * x[i : i + 4096] @ nodes.T).argmin(axis=1) for i in range(0, len(x), 4096)]
        return np.concatenate(out) if out else np.zeros(0, int)

    def meta_cluster(self, k: int | None = None) -> SOM:
        self.meta = Consensus(seed=self.seed).fit(self.nodes).predict(self.nodes) if k is None else agglomerate(self.nodes, k)
        return self

    def predict(self, events: DataFrame) -> DataFrame:
        """events with cluster_label: the meta cluster of the best matching node (or the node itself before meta_cluster)."""
        nodes, features, meta = self.nodes, self.features, getattr(self, "meta", np.arange(len(self.nodes)))
        best = self._best

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(**{CLUSTER: meta[best(pdf[features].to_numpy(float), nodes)].astype("int32")})

        kept = events.drop(CLUSTER)
        return kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField(CLUSTER, T.IntegerType())]))


def knn_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of a small table."""
    out = []
    for i in range(0, len(x), 1024):
        d = (x[i : i + 1024] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[i : i + 1024] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def louvain(edges: dict[tuple[int, int], float], n: int, seed: int = 0) -> np.ndarray:
    """Communities of greatest modularity by local moves and contraction."""
    labels = np.arange(n)
    rng = np.random.default_rng(seed)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loops = np.zeros(n)
        for (a, b), w in edges.items():
            if a == b:
                loops[a] += w
            else:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        degree = np.array([sum(x.values()) for x in near]) + 2 * loops
        total = degree.sum()
        if total == 0:
            return np.unique(labels, return_inverse=True)[1]
        own, mass, moved = np.arange(n), degree.copy(), False
        for _ in range(20):
            changes = 0
            for v in rng.permutation(n):
                mass[own[v]] -= degree[v]
                to: dict[int, float] = {}
                for u, w in near[v].items():
                    to[own[u]] = to.get(own[u], 0) + w
                best = max([own[v], *sorted(to)], key=lambda c: to.get(c, 0) - degree[v] * mass[c] / total)
                changes += best != own[v]
                own[v] = best
                mass[best] += degree[v]
            moved |= changes > 0
            if not changes:
                break
        new = np.unique(own, return_inverse=True)[1]
        labels = new[labels]
        if not moved or new.max() + 1 == n:
            return np.unique(labels, return_inverse=True)[1]
        joined: dict[tuple[int, int], float] = {}
        for (a, b), w in edges.items():
            key = (min(new[a], new[b]), max(new[a], new[b]))
            joined[key] = joined.get(key, 0) + w
        edges, n = joined, int(new.max()) + 1


def per_sample(events: DataFrame, cluster) -> DataFrame:
    """`cluster`, any function of a table of events, for each sample by itself: one plan a sample. `sample_clusters` and `shaped_clusters` take all samples in one."""
    samples = [r[SAMPLE] for r in events.select(SAMPLE).distinct().orderBy(SAMPLE).collect()]  # a row a sample
    out = None
    for s in samples:
        part = cluster(events.where(F.col(SAMPLE) == s))
        out = part if out is None else out.unionByName(part)
    return events.limit(0) if out is None else out


def shaped_clusters(events: DataFrame, features: list[str], method: str, *, by: str | None = None, id_col: str = "event_id", **params) -> DataFrame:
    """events with cluster_label by density or by a neighbour graph of all events; in each group of `by` for itself, all groups in one plan.

    Methods and parameters: dbscan (eps, least), hdbscan (least, samples), graph (k neighbours, seed). Labels count from 0 (in each group); noise is
    -1, and an event that lacks a feature has none.
    """
    from . import density_clusters, graph, space

    if method == "graph":
        edges = graph.neighbour_graph(events, features, params.pop("k", 30), id_col, by)
        if by is not None:
            group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
            edges = edges.join(events.select(F.col(id_col).cast("long").alias("a"), group.alias("g")), "a")
        found = graph.communities(edges, **params)
        rows = space.located(events, features, id_col).select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
        labels = rows.join(graph.numbered(rows, "community", "label"), "community").select("id", F.col("label").cast("int").alias("label"))
    elif method in SHAPED:
        rows, gap = (space.located(events, features, id_col), None) if by is None else space.side_by_side(events, features, by, id_col)
        if method == "hdbscan":
            labels = density_clusters.hdbscan(rows, beyond=gap, **params)
        elif gap is not None and params["eps"] >= gap:
            raise ValueError("eps is wider than the data")
        else:
            labels = density_clusters.dbscan(rows, **params)
    else:
        raise ValueError(f"unknown clusterer {method!r}; known: {', '.join(SHAPED)}")
    out = events.drop(CLUSTER).join(labels.select(F.col("id").alias(id_col), F.col("label").alias(CLUSTER)), id_col, "left")
    if by is None:
        return out.select(*[c for c in events.columns if c != CLUSTER], CLUSTER)
    known = out.where(F.col(CLUSTER) >= 0).select(F.col(by).alias("_by"), F.col(CLUSTER).alias("_all")).distinct()
    own = known.withColumn("_own", F.row_number().over(Window.partitionBy("_by").orderBy("_all")) - 1)  # a row a cluster
    out = out.join(own, F.col(by).eqNullSafe(F.col("_by")) & (F.col(CLUSTER) == F.col("_all")), "left").withColumn(CLUSTER, F.coalesce("_own", CLUSTER))
    return out.select(*[c for c in events.columns if c != CLUSTER], CLUSTER)


def graph_clusters(events: DataFrame, features: list[str], k: int = 30, seed: int = 42, id_col: str = "event_id", by: str | None = None) -> DataFrame:
    """events with cluster_label: communities of the shared-neighbour graph of all events (in each group of `by`)."""
    return shaped_clusters(events, features, "graph", by=by, id_col=id_col, k=k, seed=seed)


def performance(events: DataFrame, features: list[str], label: str = CLUSTER) -> dict[str, float]:
    """Calinski-Harabasz and Davies-Bouldin from one grouped aggregate and one pass for the distances."""
    xs = [number(f) for f in features]
    g = events.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], sum((F.var_pop(x) for x in xs[1:]), F.var_pop(xs[0])).alias("v"))
    rows = g.collect()
    n, means = np.array([r.n for r in rows]), np.array([[r[f"m{i}"] for i in range(len(xs))] for r in rows])
    overall = (n[:, None] * means).sum(0) / n.sum()
    between, within = (n * ((means - overall) ** 2).sum(1)).sum(), (n * np.array([r.v for r in rows])).sum()
    k = len(rows)
    centre = events.join(g, label)
    d = sum(((x - F.col(f"m{i}")) ** 2 for i, x in enumerate(xs[1:], 1)), (xs[0] - F.col("m0")) ** 2)
    spread = {r[0]: r.s for r in centre.groupBy(label).agg(F.avg(F.sqrt(d)).alias("s")).collect()}
    s = np.array([spread[r[label]] for r in rows])
    apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(-1))
    np.fill_diagonal(apart, np.inf)
    return {"calinski_harabasz": float(between / (k - 1) / (within / (n.sum() - k))), "davies_bouldin": float(((s[:, None] + s[None]) / apart).max(1).mean())}


def silhouette(events: DataFrame, features: list[str], label: str = CLUSTER) -> float:
    """The mean silhouette with squared distances, which needs cluster sums only: one aggregate and one pass."""
    xs = [number(f) for f in features]
    square = sum((x * x for x in xs[1:]), xs[0] * xs[0])
    known = events.where(F.col(label).isNotNull())
    rows = known.groupBy(label).agg(F.count("*").alias("n"), F.sum(square).alias("q"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]).collect()
    if len(rows) < 2:
        raise ValueError("a silhouette needs two clusters or more")

    def mean_to(r, n: float) -> Column:
        """Mean squared distance to a cluster's events: |x|^2 + mean |y|^2 - 2 x . mean y, over n of them."""
        dot = sum((x * float(r[f"s{i}"]) for i, x in enumerate(xs[1:], 1)), xs[0] * float(r["s0"]))
        return (square * r.n + float(r.q) - 2 * dot) / n

    own, near = F.lit(None).cast("double"), F.lit(None).cast("double")
    for r in rows:
        own = F.when(F.col(label) == r[label], mean_to(r, r.n - 1) if r.n > 1 else F.lit(None).cast("double")).otherwise(own)
    near = F.least(*[F.when(F.col(label) != r[label], mean_to(r, r.n)) for r in rows], F.lit(float("inf")))
    score = F.when(own.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(near - own, F.greatest(near, own)), F.lit(0.0)))
    return known.agg(F.avg(score).alias("s")).head().s


def minimum_spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a tree over a few thousand points, by Prim's algorithm."""
    n = len(points)
    near, cost, inside, out = np.zeros(n, int), np.full(n, np.inf), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.sqrt(((points - points[at]) ** 2).sum(1))
        better = ~inside & (d < cost)
        cost[better], near[better] = d[better], at
        at = int(np.where(inside, np.inf, cost).argmin())
        out.append((int(near[at]), at, float(cost[at])))
    return out


def rename(events: DataFrame, names: dict, label: str = META, sample: str | None = None) -> DataFrame:
    """Labels mapped to new ones, in one sample if given."""
    new = F.coalesce(F.create_map(*[F.lit(str(v)) for kv in names.items() for v in kv])[F.col(label).cast("string")], F.col(label).cast("string"))
    return events.withColumn(label, new if sample is None else F.when(F.col(SAMPLE) == sample, new).otherwise(F.col(label).cast("string")))


def as_populations(events: DataFrame, label: str = META, prefix: str = "cluster", id_col: str = "event_id") -> DataFrame:
    """Membership rows: one population for each sample and label."""
    return events.where(F.col(label).isNotNull()).select(SAMPLE, id_col, F.concat_ws("_", F.lit(prefix), F.col(label).cast("string")).alias("population"))
