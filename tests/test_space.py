"""Neighbours, graphs and clusters over all events, against brute force; small blocks make the searches cross them."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from gatelake.operators import clustering, density_clusters, graph, space
from pyspark.sql import functions as F


def points(seed, n=300, dims=2, copies=20, grid=None):
    """Blobs, a band, some lone points, exact copies; on a grid there are many ties, too."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n // 3, dims)), rng.normal(8, 0.7, (n // 3, dims)), rng.uniform(-12, 20, (n - 2 * (n // 3), dims))])
    x = np.round(x * grid) / grid if grid else x
    x = np.concatenate([x, np.repeat(x[:2], copies, axis=0)])
    ids = rng.permutation(len(x)) * 3 - 50
    return ids, x


def frame(spark, ids, x):
    rows = [(int(i), *map(float, v)) for i, v in zip(ids, x, strict=True)]
    names = ["event_id", *[f"f{i}" for i in range(x.shape[1])]]
    return spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'event_id' else 'double'}" for n in names)).repartition(3), names[1:]


def rows_of(spark, ids, x):
    df, names = frame(spark, ids, x)
    return space.located(df, names)


@pytest.mark.parametrize(("dims", "grid"), [(1, 1), (2, None), (3, 2)])
def test_blocks(spark, dims, grid):
    ids, x = points(1, dims=dims, grid=grid)
    spots = space.places(rows_of(spark, ids, x))
    blocks = space.Blocks.of(spots, dims, 20)
    homes = space.dealt(spots, blocks).select("home", "x", "n", "pid").collect()
    assert max(Counter(r.home for r in homes).values()) <= 20 and sum(r.n for r in homes) == len(x)
    assert {r.home for r in homes} <= set(range(blocks.leaves)) and blocks.leaves >= len(homes) / 20
    own = np.array([r.x for r in homes])
    home = np.array([r.home for r in homes])
    low, high = blocks.cells()
    assert ((own >= low[home]) & (own <= high[home])).all()
    for metric, radius in itertools.product(("euclidean", "manhattan"), (0.0, 1.5, np.inf)):
        row, leaf = blocks.near(own, np.full(len(own), radius), metric)
        found = set(zip(row.tolist(), leaf.tolist(), strict=True))
        assert len(found) == len(row)
        d = space.distances(own, own, metric)
        assert all((i, home[j]) in found for i, j in zip(*np.nonzero(d <= radius), strict=True))
    assert space.Blocks.of(spots.limit(0), dims).leaves == 1


def brute_nearest(ids, x, k):
    d = space.distances(x, x)
    return {int(i): [(float(d[a, b]), int(ids[b])) for b in sorted(range(len(x)), key=lambda b: (d[a, b], ids[b])) if b != a][:k] for a, i in enumerate(ids)}


@pytest.mark.parametrize(("dims", "grid", "most"), [(2, None, 16), (2, 1, 16), (4, 1, 30), (2, 1, 5000)])
def test_nearest(spark, dims, grid, most, monkeypatch):
    ids, x = points(2, dims=dims, grid=grid)
    monkeypatch.setattr(space, "BLOCK_ROWS", most)
    monkeypatch.setattr(space.Blocks.of.__func__, "__defaults__", (most,))
    df, names = frame(spark, ids, x)
    got = {r.id: [(e.d, e.id) for e in r.near] for r in space.nearest(df, names, 7).collect()}
    assert got == brute_nearest(ids, x, 7)


def test_few_events_and_missing_values(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 3.0, None), (3, float("nan"), 1.0), (4, 1.0, 1.0)], "event_id long, a double, b double")
    got = {r.id: [e.id for e in r.near] for r in space.nearest(df, ["a", "b"], 5).collect()}
    assert got == {1: [4], 4: [1]}
    assert space.nearest(df.limit(0), ["a", "b"], 5).count() == 0
    assert {r.label for r in density_clusters.dbscan(space.located(df, ["a", "b"]), 0.1, 2).collect()} == {-1}
    assert density_clusters.dbscan(space.located(df.limit(0), ["a", "b"]), 0.1).count() == 0 == density_clusters.hdbscan(space.located(df.limit(0), ["a", "b"])).count()
    with pytest.raises(ValueError, match="integer"):
        space.located(df.withColumn("event_id", F.col("event_id").cast("string")), ["a"])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_counts_within(spark, metric):
    ids, x = points(3, grid=2)
    spots = space.places(rows_of(spark, ids, x))
    blocks = space.Blocks.of(spots, 2, 16)
    got = {r.pid: r.within for r in space.counts_within(space.dealt(spots, blocks), blocks, 1.5, metric).collect()}
    n = (space.distances(x, x, metric) <= 1.5).sum(1)
    assert {int(min(ids[(x == x[i]).all(1)])): int(n[i]) for i in range(len(x))} == got


def test_a_busy_block_is_shared(spark):
    """Many searches for one block go to several tasks, and none is lost."""
    ids, x = points(4)
    spots = space.places(rows_of(spark, ids, x))
    blocks = space.Blocks.of(spots, 2, 5000)
    homes = space.dealt(spots, blocks)
    sizes = lambda a, b: pa.table({"pid": a.column("pid"), "m": pa.array([a.num_rows] * a.num_rows, "int64"), "n": pa.array([b.num_rows] * a.num_rows, "int64")})
    got = space.answered(space.asking(homes.select("pid", "x", "home"), blocks, 1.0), homes.select("home", "x", "n"), sizes, "pid long, m long, n long", most=50).collect()
    assert len(got) == len(np.unique(x, axis=0)) == {r.n for r in got}.pop() and max(r.m for r in got) < 100


def brute_components(edges):
    low = {v: v for e in edges for v in e}
    while True:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


@pytest.mark.parametrize("driver_edges", [0, 10, 10**6])
def test_components(spark, driver_edges):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (5000, 5000)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), driver_edges)
    assert {r.id: r.component for r in got.collect()} == brute_components(edges)
    assert graph.components(spark.createDataFrame([], "a long, b long"), driver_edges).count() == 0


def brute_dbscan(ids, x, eps, least):
    near = space.distances(x, x) <= eps
    core = near.sum(1) >= least
    low = brute_components([(i, j) for i, j in zip(*np.nonzero(near & core & core[:, None]), strict=True)])
    d = space.distances(x, x)
    out = {}
    for i in range(len(x)):
        # of equally near cores the place of the smallest id
        own = min(((d[i, j], min(ids[(x == x[j]).all(1)]), j) for j in np.flatnonzero(near[i] & core)), default=None)
        out[int(ids[i])] = -1 if own is None else low[own[2]]
    return out


def partition(labels):
    groups = {}
    for i, v in labels.items():
        groups.setdefault(v, set()).add(i)
    return {frozenset(g) for v, g in groups.items() if v != -1}, groups.get(-1, set())


@pytest.mark.parametrize(("dims", "grid", "eps", "least", "most", "edges"), [(2, None, 1.0, 5, 16, 0), (2, 2, 1.0, 6, 16, None), (3, 1, 1.5, 4, 20, 5), (2, None, 1.0, 5, 5000, None), (2, 1, 0.0, 10, 16, None)])
def test_dbscan(spark, dims, grid, eps, least, most, edges):
    ids, x = points(5, dims=dims, grid=grid)
    got = {r.id: r.label for r in density_clusters.dbscan(rows_of(spark, ids, x), eps, least, most=most, driver_edges=edges).collect()}
    assert partition(got) == partition(brute_dbscan(ids, x, eps, least))
    assert set(got.values()) - {-1} == set(range(len(set(got.values()) - {-1})))


def mutual(x, samples):
    d = space.distances(x, x)
    core = np.sort(d, axis=1)[:, samples - 1] if samples <= len(x) else np.full(len(x), np.inf)
    return np.maximum(np.maximum(core[:, None], core[None]), d), core


def brute_tree(w):
    n, out, left, cost = len(w), [], set(range(1, len(w))), w[0].copy()
    while left:
        at = min(left, key=lambda j: cost[j])
        out.append(cost[at])
        left.discard(at)
        cost = np.minimum(cost, w[at])
    return sorted(out) if n else []


@pytest.mark.parametrize(("dims", "grid", "most"), [(2, None, 5000), (2, None, 16), (2, 1, 16), (3, 2, 12)])
def test_reachability_tree(spark, dims, grid, most):
    ids, x = points(6, 200, dims, 4, grid)
    spots = space.places(rows_of(spark, ids, x), 5)
    blocks = space.Blocks.of(spots, dims, most)
    cores = density_clusters.core_distances(spots, blocks, 5)
    tree = density_clusters.reachability_tree(cores, blocks).collect()
    w, core = mutual(x, 5)
    _, first = np.unique(x, axis=0, return_index=True)
    assert {r.pid: r.core for r in cores.collect()} == {int(min(ids[(x == x[i]).all(1)])): float(core[i]) for i in first}
    assert np.allclose(sorted(r.w for r in tree), brute_tree(w[np.ix_(first, first)]), rtol=0, atol=0)
    assert len(partition(brute_components([(r.a, r.b) for r in tree]))[0]) == 1 and len(tree) == len(first) - 1


def brute_hdbscan(x, least, samples):
    """Components at every weight, from the top down."""
    w, _ = mutual(x, samples)
    np.fill_diagonal(w, np.inf)
    weights = sorted(set(w[np.isfinite(w)].tolist()), reverse=True)

    def parts(own, below):
        left, out = set(own), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                i = todo.pop()
                seen.add(i)
                new = [j for j in left if w[i, j] < below]
                left.difference_update(new)
                todo += new
            out.append(seen)
        return out

    lam = lambda v: 1 / v if v > 0 else 1e100

    def branch(own, birth, whole=False):
        """(stability, clusters) of the best choice within a branch that begins (from the top) at birth."""
        stable, now = 0.0, set(own)
        for v in weights:
            split = parts(now, v)
            if len(split) == 1:
                continue
            big = [p for p in split if len(p) >= least]
            stable += (lam(v) - birth) * sum(len(p) for p in split if len(p) < least)
            if len(big) == 1:
                now = big[0]
                continue
            stable += (lam(v) - birth) * sum(len(p) for p in big)
            below = [branch(p, lam(v)) for p in big]
            under, chosen = sum(b[0] for b in below), [c for b in below for c in b[1]]
            return (under, chosen) if whole or stable < under else (stable, [set(own)])
        return (0.0, []) if whole else (stable, [set(own)])

    return branch(range(len(x)), 0.0, True)[1]


@pytest.mark.parametrize(("seed", "grid", "least", "samples", "most"), [(7, None, 8, 8, 5000), (8, None, 5, 3, 16), (9, 2, 6, 4, 16), (10, 1, 12, 2, 5000)])
def test_hdbscan(spark, seed, grid, least, samples, most):
    ids, x = points(seed, 120, 2, 5, grid)
    got = {r.id: r.label for r in density_clusters.hdbscan(rows_of(spark, ids, x), least, samples, most=most).collect()}
    want = {frozenset(int(ids[i]) for i in c) for c in brute_hdbscan(x, least, samples)}
    assert partition(got)[0] == want and set(got) == set(ids.tolist())
    assert set(got.values()) - {-1} == set(range(len(want)))


def test_neighbour_graph(spark):
    ids, x = points(11, 150)
    df, names = frame(spark, ids, x)
    got = {(r.a, r.b): r.w for r in graph.neighbour_graph(df, names, 6).collect()}
    near = {i: {j for _, j in n} for i, n in brute_nearest(ids, x, 6).items()}
    want = {(min(i, j), max(i, j)): len(near[i] & near[j]) / len(near[i] | near[j]) for i in near for j in near[i]}
    assert got == {k: w for k, w in want.items() if w > 0}


def quality(edges, label):
    total, mass, inside = 0.0, Counter(), 0.0
    for (a, b), w in edges.items():
        total += 2 * w
        mass[label[a]] += w
        mass[label[b]] += w
        inside += 2 * w * (label[a] == label[b])
    return inside / total - sum(m * m for m in mass.values()) / total**2


def test_communities(spark):
    """In rounds over tables the modularity is that of the driver's moves, about; on the driver it is the very same."""
    ids, x = points(12, 240, copies=3)
    df, names = frame(spark, ids, x)
    edges = graph.neighbour_graph(df, names, 8).persist()
    held = {(r.a, r.b): r.w for r in edges.collect()}
    small = {r.id: r.community for r in graph.communities(edges).collect()}
    large = {r.id: r.community for r in graph.communities(edges, task_edges=0).collect()}
    assert set(small) == set(large) == {v for e in held for v in e}
    assert abs(graph.modularity(edges, graph.communities(edges)) - quality(held, small)) < 1e-9
    assert quality(held, large) > 0.95 * quality(held, small) > 0.3
    names_ = sorted(small)
    order = {v: i for i, v in enumerate(names_)}
    by = clustering.louvain({(order[a], order[b]): w for (a, b), w in sorted(held.items())}, len(names_), 42)
    assert abs(quality(held, {v: by[order[v]] for v in names_}) - quality(held, small)) < 0.02


@pytest.mark.parametrize(("grid", "h", "first", "most"), [(None, 1.0, 0, 16), (None, 1.0, 20, 16), (1, 2.0, 3, 16), (2, 0.5, 0, 5000), (None, 3.0, 0, 16), (None, 100.0, 1, 16), (1, 0.0, 5, 16)])
def test_faithful_cover(spark, grid, h, first, most):
    """The greedy cover in hash order, however it is made."""
    import hashlib

    from gatelake.operators import sampling

    ids, x = points(13, 200, grid=grid)
    df, names = frame(spark, ids, x)
    kept = []
    for i in sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{ids[i]}:0".encode()).hexdigest(), ids[i])):
        if not kept or space.distances(x[i : i + 1], x[kept]).min() > h:
            kept.append(i)
    got = [r.event_id for r in sampling.faithful_downsample(df, names, h, first=first, most=most).collect()]
    assert sorted(got) == sorted(ids[kept].tolist())
    assert sampling.faithful_downsample(df.limit(0), names, h).count() == 0


@pytest.mark.parametrize(("method", "params"), [("dbscan", {"eps": 1.0, "least": 4}), ("hdbscan", {"least": 6}), ("graph", {"k": 6})])
def test_all_samples_in_one_plan(spark, method, params):
    """Clusters of each group, the null one too, are those of the group alone; labels begin at 0 in each."""
    parts = {g: points(s, n) for g, s, n in (("a", 14, 90), ("b", 15, 120), (None, 16, 60), ("tiny", 17, 3))}
    rows, at = [], 0
    for g, (_, x) in parts.items():
        for v in x:
            rows.append((at, g, float(v[0]), float(v[1])))
            at += 1
    df = spark.createDataFrame([*rows, (9999, "a", 1.0, None)], "event_id long, sample_id string, f0 double, f1 double").repartition(3)
    got = clustering.shaped_clusters(df, ["f0", "f1"], method, by="sample_id", **params).collect()
    assert len(got) == len(rows) + 1 and [r.cluster_label for r in got if r.event_id == 9999] == [None]
    for g in parts:
        own = {r.event_id: r.cluster_label for r in got if r.sample_id == g and r.event_id != 9999}
        alone = clustering.shaped_clusters(df.where(F.col("sample_id").eqNullSafe(F.lit(g))), ["f0", "f1"], method, **params).where("event_id <> 9999")
        want = {r.event_id: r.cluster_label for r in alone.collect()}
        assert set(own.values()) - {-1} == set(range(len(set(own.values()) - {-1})))
        assert partition(own) == partition(want)


def test_polygon_gates_by_density(spark):
    from gatelake.operators import gates

    ids, x = points(18, 300)
    df, _ = frame(spark, ids, x)
    for method, params in (("dbscan", {"eps": 1.0, "least": 5}), ("hdbscan", {"least": 20}), ("graph", {"k": 15})):
        g = gates.PolygonGate("g", "root", "f0", "f1", method=method, params=params).fit(df)
        assert len(g.children) >= 2 and gates.Gate.from_json(g.to_json()).params == params
        inside = g.predict(df).groupBy("population").count().collect()
        assert sum(r["count"] for r in inside) >= 90


def test_local_density_and_upsampling(spark):
    from gatelake.operators import sampling

    ids, x = points(19, 200, copies=4, grid=4)
    df, names = frame(spark, ids, x)
    tree = df.where("event_id % 2 = 0")
    inside = x[ids % 2 == 0]
    d = space.distances(inside, inside, "manhattan")
    np.fill_diagonal(d, np.inf)
    radius = 5 * np.median(d.min(1))
    want = (space.distances(x, inside, "manhattan") <= radius).sum(1)
    odd = df.unionByName(spark.createDataFrame([(10**6, None, 1.0)], df.schema))
    got = {r.event_id: r.density for r in sampling.local_density(odd, names, tree).collect()}
    assert got == {**dict(zip(ids.tolist(), want.astype(float).tolist(), strict=True)), 10**6: 0.0}
    assert {r.density for r in sampling.local_density(df, names, tree.limit(0)).collect()} == {0.0}
    weights = {r.event_id: r.weight for r in sampling.density_weights(df, names, tree_fraction=None).collect()}
    more = Counter(r.event_id for r in sampling.upsample_density(df, names, 4, tree_fraction=None).collect())
    assert set(more) == set(weights) and all(n <= 4 for n in more.values()) and all(more[i] == 1 for i, w in weights.items() if w == 0) and all(more[i] == 4 for i, w in weights.items() if w >= 1)
    assert sampling.upsample_density(df, names, 4, size=50).count() == 50
    assert sampling.upsample_density(df.withColumn("w", F.lit(2.5)), names, 2, weight="w").count() == 2 * len(ids)


def test_communities_of_groups_in_rounds(spark):
    """Groups are graphs of their own: together they give what each gives alone, in rounds as in one task."""
    rng = random.Random(3)
    edges = [(g * 1000 + a, g * 1000 + b, 1.0, str(g)) for g, n in ((0, 4), (1, 30)) for c in range(n) for a, b in itertools.combinations(range(10 * c, 10 * c + 6), 2) if rng.random() < 0.8]
    edges += [(g * 1000 + 10 * c, g * 1000 + 10 * c + 10, 1.0, str(g)) for g, n in ((0, 3), (1, 29)) for c in range(n)]
    df = spark.createDataFrame(edges, "a long, b long, w double, g string").persist()
    one = graph.communities(df).persist()
    rounds = graph.communities(df, task_edges=0).persist()
    assert {r.id // 1000 for r in rounds.collect()} == {0, 1} and rounds.where("community div 1000 <> id div 1000").isEmpty()
    alone = {r.id: r.community for g in "01" for r in graph.communities(df.where(F.col("g") == g).drop("g")).collect()}
    assert {r.id: r.community for r in one.collect()} == alone
    assert graph.modularity(df, rounds) > 0.95 * graph.modularity(df, one) > 1.0
    assert graph.communities(df.limit(0)).count() == 0 and graph.modularity(df.limit(0), one) == 0.0


def plain_linkage(x, k, linkage, weights):
    """Merge the nearest two of all clusters until k are left; distances from the definitions."""
    groups = [[i] for i in range(len(x))]

    def apart(a, b):
        if linkage == "ward":
            wa, wb = weights[a].sum(), weights[b].sum()
            ca, cb = (weights[a, None] * x[a]).sum(0) / wa, (weights[b, None] * x[b]).sum(0) / wb
            return 2 * wa * wb / (wa + wb) * ((ca - cb) ** 2).sum()
        d = space.distances(x[a], x[b])
        if linkage == "average":
            return (d * weights[a][:, None] * weights[b][None]).sum() / weights[a].sum() / weights[b].sum()
        return d.min() if linkage == "single" else d.max()

    while len(groups) > k:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: apart(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_linkages(linkage):
    rng = np.random.default_rng(4)
    x, weights = rng.normal(size=(45, 2)), rng.integers(1, 5, 45).astype(float)
    for w in (np.ones(45), weights):
        for k in (1, 4, 20):
            got = clustering.agglomerate(x, k, linkage=linkage, weights=w)
            assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == plain_linkage(x, k, linkage, w)
    with pytest.raises(ValueError, match="linkage"):
        clustering.agglomerate(x, 2, linkage="other")


def test_meta_clusters_by_any_method(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(s, k, *map(float, rng.normal(9 * k, 0.3, 2))) for s in range(8) for k in range(3) for _ in range(6)]
    df = spark.createDataFrame([(i, f"s{s}", k, a, b) for i, (s, k, a, b) in enumerate(rows)], "event_id long, sample_id string, cluster_label int, x double, y double")
    ways = [{"k": 3, "linkage": m} for m in clustering.LINKAGES] + [{"k": 3, "method": "kmeans"}, {"method": "dbscan", "eps": 2.0, "least": 3}, {"method": "hdbscan", "least": 4}, {"method": "graph", "k_neighbours": 5}, {"k": 3, "scale": "minmax"}]
    for how in ways:
        got = clustering.meta_clusters(df, ["x", "y"], **how).select("cluster_label", "meta_label").distinct().collect()
        assert len(got) == 3 == len({r.meta_label for r in got}), how
    monkeypatch.setattr(clustering, "LINKAGE_ROWS", 10)  # more summaries than rows: centres first
    got = clustering.meta_clusters(df, ["x", "y"], k=3, linkage="ward").select("cluster_label", "meta_label").distinct().collect()
    assert len(got) == 3 == len({r.meta_label for r in got})
