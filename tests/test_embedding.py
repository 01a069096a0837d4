"""Embeddings over landmarks, and densities on grids, against plain numpy."""

import numpy as np
import pytest
from gatelake.operators import batch, embedding, gates
from pyspark.sql import functions as F


def frame(spark, x):
    rows = [(i, f"s{i % 3}", *map(float, v)) for i, v in enumerate(x)]
    names = [f"f{j}" for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "event_id long, sample_id string, " + ", ".join(f"{n} double" for n in names)).repartition(3), names


def scores(df, prefix, k=2):
    return np.array([[r[f"{prefix}{j + 1}"] for j in range(k)] for r in df.orderBy("event_id").collect()], float)


@pytest.mark.parametrize("params", [{}, {"kind": "rbf", "gamma": 0.3}, {"kind": "poly", "degree": 2}, {"kind": "cosine"}, {"kind": "sigmoid", "gamma": 0.1}])
def test_kernel_pca_of_the_whole_table(spark, params):
    x = np.random.default_rng(1).normal(size=(120, 3)) * [1, 2, 0.5]
    x[:, 2] += 2 * x[:, 0]
    df, names = frame(spark, x)
    z = (x - x.mean(0)) / x.std(0)
    k = embedding.kernel(z, z, **params)
    h = np.eye(120) - 1 / 120
    values, vectors = np.linalg.eigh(h @ k @ h)
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    got = scores(embedding.KernelPCA(names, 2, landmarks=1000, **params).fit(df).transform(df), "KernelPCA")
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    some = scores(embedding.reduced(df, names, "kernel_pca", landmarks=60, **params), "KernelPCA")
    assert abs(np.corrcoef(some[:, 0], got[:, 0])[0, 1]) > 0.8


def test_linear_kernel_is_pca(spark):
    x = np.random.default_rng(2).normal(size=(90, 3)) @ np.diag([3, 1, 0.2])
    df, names = frame(spark, x)
    a, b = scores(embedding.reduced(df, names, "pca"), "PCA"), scores(embedding.reduced(df, names, "kernel_pca"), "KernelPCA")
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-6)
    with pytest.raises(ValueError, match="unknown embedding"):
        embedding.reduced(df, names, "other")
    with pytest.raises(ValueError, match="unknown kernel"):
        embedding.KernelPCA(names, kind="other").fit(df)


def test_diffusion_separates_blobs_and_unrolls(spark):
    rng = np.random.default_rng(3)
    blobs = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (4, 4, 0), (0, 4, 4))])
    df, names = frame(spark, blobs)
    y = scores(embedding.Diffusion(names, 2, landmarks=100, scale=False, time=4).fit(df).transform(df), "Diffusion")
    centre = np.array([y[60 * i : 60 * i + 60].mean(0) for i in range(3)])
    assert (np.argmin(((y[:, None] - centre[None]) ** 2).sum(-1), 1) == np.repeat([0, 1, 2], 60)).mean() > 0.95
    t = 1.5 * np.pi * (1 + 2 * rng.random(600))
    roll = np.column_stack([t * np.cos(t), 8 * rng.random(600), t * np.sin(t)])
    df, names = frame(spark, roll)
    y = scores(embedding.Diffusion(names, 2, landmarks=400, scale=False, neighbours=4).fit(df).transform(df), "Diffusion")
    rank = lambda v: np.argsort(np.argsort(v))
    assert abs(np.corrcoef(rank(y[:, 0]), rank(t))[0, 1]) > 0.95  # the first coordinate goes along the roll
    flat = embedding.trustworthiness(roll, scores(embedding.reduced(df, names, "pca"), "PCA"))
    assert embedding.trustworthiness(roll, y) > max(0.9, flat - 0.05)


def test_landmarks_have_their_own_coordinates(spark):
    x = np.random.default_rng(4).normal(size=(80, 2))
    df, names = frame(spark, x)
    m = embedding.Diffusion(names, 2, landmarks=80).fit(df)
    assert np.allclose(m.project(m.points), m.psi * np.abs(m.values), atol=1e-8)
    odd = df.unionByName(spark.createDataFrame([(999, "s", None, 1.0)], df.schema))
    assert odd.transform(m.transform).where("event_id = 999 AND Diffusion1 IS NULL").count() == 1
    again = embedding.Landmarks.from_state(m.state())
    assert np.allclose(again.coordinates(x), m.coordinates(x))
    with pytest.raises(ValueError, match="no events"):
        m.fit(df.limit(0))


def test_gates_on_kernel_components(spark):
    rng = np.random.default_rng(5)
    angle, r = rng.random(300) * 2 * np.pi, np.repeat([1.0, 5.0], 150) + rng.normal(0, 0.1, 300)
    df, names = frame(spark, np.column_stack([r * np.cos(angle), r * np.sin(angle)]))
    g = gates.ThresholdGate("g", "root", "KernelPCA1", method="quantile", params={"q": 0.5}, embedding={"method": "kernel_pca", "features": names, "params": {"kind": "rbf", "gamma": 1.0, "landmarks": 200}}).fit(df)
    g = gates.Gate.from_json(g.to_json())
    inner = {r.event_id for r in g.predict(df).where("population = '+'").collect()}
    assert len(inner & set(range(150))) in (*range(8), *range(143, 151))  # rings that no line tells apart


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_kernel_densities(spark, dims):
    x = np.random.default_rng(6).normal(size=(150, dims)) * [1.0, 2.0, 0.5][:dims]
    df, names = frame(spark, x)
    lo, hi, bins = x.min(0).tolist(), x.max(0).tolist(), 7
    got = batch.kernel_densities(df, names, lo, hi, bins)
    grid = np.stack(np.meshgrid(*[np.linspace(a, b, bins) for a, b in zip(lo, hi, strict=True)], indexing="ij"), -1).reshape(-1, dims)
    for s in range(3):
        own = x[s::3]
        h = own.std(0, ddof=1) * len(own) ** (-1 / (dims + 4))
        want = np.exp(-0.5 * (((grid[:, None] - own[None]) / h) ** 2).sum(-1)).mean(1) / np.prod(h * np.sqrt(2 * np.pi))
        assert np.allclose(got[f"s{s}"].ravel(), want, rtol=1e-9)


def test_kernel_densities_of_tasks_without_rows(spark):
    df, names = frame(spark, np.random.default_rng(8).normal(size=(30, 2)))
    few, many = (batch.kernel_densities(df.repartition(n), names, [-2.0, -2.0], [2.0, 2.0], 5) for n in (1, 40))
    assert list(few) == list(many) == ["s0", "s1", "s2"] and all(np.allclose(few[s], many[s], rtol=1e-12) for s in few)


def test_similarity_by_kernel_density_of_tasks_without_rows(spark):
    df, names = frame(spark, np.random.default_rng(9).normal(size=(60, 3)))
    few, many = (batch.similarity_matrix(df.repartition(n), "s0", names, bins=8, kernel=True, reducer="kernel_pca", reducer_params={"kind": "rbf"}) for n in (1, 80))
    assert list(few.index) == list(many.index) and np.allclose(few, many, atol=1e-6)


def test_similarity_by_kernel_density_and_other_reducers(spark):
    rng = np.random.default_rng(7)
    df, names = frame(spark, rng.normal(size=(300, 3)))
    df = df.withColumn("f0", F.when(F.col("sample_id") == "s2", F.col("f0") + 3).otherwise(F.col("f0")))
    for how in ({"kernel": True, "bins": 24}, {"kernel": True, "bins": 24, "reducer": "kernel_pca", "reducer_params": {"kind": "rbf"}}, {"reducer": "diffusion"}, {"kernel": True, "bandwidth": 0.5}):
        m = batch.similarity_matrix(df, "s0", names, **how)
        assert np.allclose(np.diag(m), 0, atol=1e-7) and np.allclose(m, m.T) and m.loc["s0", "s2"] > m.loc["s0", "s1"]
    seen = batch.dim_reduction_grid(df, "s0", names, method="kernel_pca", kind="rbf")
    assert {"KernelPCA1", "KernelPCA2", "is_reference"} <= set(seen.columns) and seen.where("KernelPCA1 IS NULL").isEmpty()
