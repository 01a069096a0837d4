"""Embeddings beyond principal components: kernel PCA and diffusion maps over landmarks.

Landmarks are a sample in hash order, of a stated size; the driver decomposes their kernel matrix, and every event is projected by the kernel between it
and the landmarks (Nystroem's extension), in Arrow batches. If the landmarks are the whole table, that is the exact embedding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import number
from .features import PCA
from .sampling import uniform
from .space import in_parts

#: Landmarks by default; their kernel matrix is decomposed on the driver.
LANDMARKS = 1000


class Landmarks:
    """Common parts: a scaled sample of events, and coordinates of any events from their kernel with it."""

    name = ""

    def __init__(self, features: list[str], k: int = 2, *, landmarks: int = LANDMARKS, scale: bool = True, seed: int = 42, **params) -> None:
        self.features, self.k, self.landmarks, self.scale, self.seed, self.params = features, k, landmarks, scale, seed, params

    def fit(self, df: DataFrame, id_col: str = "event_id") -> Landmarks:
        data = df.select(id_col, *[number(f).alias(f) for f in self.features]).dropna(subset=self.features)
        row = data.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(self.features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(self.features)]).head()
        if row.m0 is None:
            raise ValueError("no events to fit on")
        n = len(self.features)
        self.mean = np.array([row[f"m{i}"] for i in range(n)]) if self.scale else np.zeros(n)
        self.sd = np.array([row[f"s{i}"] or 1.0 for i in range(n)]) if self.scale else np.ones(n)
        taken = uniform(data, self.landmarks, id_col=id_col, seed=self.seed).orderBy(id_col)
        self.points = (np.array([list(r)[1:] for r in taken.collect()], float).reshape(-1, n) - self.mean) / self.sd
        self.decompose()
        return self

    def decompose(self) -> None:
        raise NotImplementedError

    def project(self, z: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features; a row that lacks one has none."""
        out, known = np.full((len(x), self.k), np.nan), np.isfinite(x).all(1)
        z = (x[known] - self.mean) / self.sd
        parts = [self.project(z[s]) for s in in_parts(len(z), len(self.points))]
        if parts:
            out[known] = np.concatenate(parts)
        return out

    def transform(self, df: DataFrame, prefix: str | None = None) -> DataFrame:
        """df with a column for each coordinate."""
        names, features, compute = [f"{prefix or self.name}{j + 1}" for j in range(self.k)], self.features, self.coordinates
        kept = [c for c in df.columns if c not in names]
        data = df.withColumns({f"_e{i}": number(f) for i, f in enumerate(features)})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = compute(pdf[[f"_e{i}" for i in range(len(features))]].to_numpy(float))
                new = {n: [None if np.isnan(v) else v for v in got[:, j]] for j, n in enumerate(names)}
                yield pdf[kept].assign(**new)

        return data.mapInPandas(run, T.StructType([*[f for f in df.schema.fields if f.name not in names], *[T.StructField(n, T.DoubleType()) for n in names]]))

    def column(self, j: int) -> Column:
        """One coordinate as an expression, computed in Arrow batches."""
        compute = self.coordinates

        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(compute(np.column_stack([c.to_numpy(float) for c in columns]))[:, j])

        run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return number(F.pandas_udf(run, "double")(*[number(f) for f in self.features]))

    def state(self) -> dict:
        """What JSON keeps of a fitted embedding."""
        plain = {k: v for k, v in self.__dict__.items() if not isinstance(v, np.ndarray)}
        return {"method": METHOD_OF[type(self)], **plain, "arrays": {k: v.tolist() for k, v in self.__dict__.items() if isinstance(v, np.ndarray)}}

    @staticmethod
    def from_state(state: dict) -> Landmarks:
        out = METHODS[state["method"]](state["features"], state["k"])
        out.__dict__ |= {k: v for k, v in state.items() if k not in ("method", "arrays")} | {k: np.array(v, float) for k, v in state["arrays"].items()}
        return out


def kernel(x: np.ndarray, y: np.ndarray, kind: str = "linear", gamma: float | None = None, degree: int = 3, coef0: float = 1.0) -> np.ndarray:
    """linear, poly, rbf, sigmoid or cosine; gamma is one over the number of features, if it isn't given."""
    gamma = 1 / x.shape[1] if gamma is None else gamma
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
    if kind == "cosine":
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)).T
    dot = x @ y.T
    if kind == "linear":
        return dot
    if kind == "poly":
        return (gamma * dot + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    raise ValueError(f"unknown kernel {kind!r}; known: linear, poly, rbf, sigmoid, cosine")


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each vector's largest entry is positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


class KernelPCA(Landmarks):
    """Principal components in a kernel's space; params are those of `kernel`."""

    name = "KernelPCA"

    def decompose(self) -> None:
        k = kernel(self.points, self.points, **self.params)
        self.row_mean, whole = k.mean(0), k.mean()
        values, vectors = np.linalg.eigh(k - self.row_mean[:, None] - self.row_mean[None] + whole)
        order = np.argsort(-values)[: self.k]
        self.values = np.maximum(values[order], 0)
        safe = np.where(self.values > 1e-12, self.values, np.inf)
        self.weights = _signed(vectors[:, order]) / np.sqrt(safe)

    def project(self, z: np.ndarray) -> np.ndarray:
        k = kernel(z, self.points, **self.params)
        return (k - k.mean(1, keepdims=True) - self.row_mean[None] + self.row_mean.mean()) @ self.weights


class Diffusion(Landmarks):
    """Coordinates of a random walk over landmarks: events that many short steps connect are near each other.

    Parameters: neighbours (a landmark's step reaches about as far as that one), time (steps).
    """

    name = "Diffusion"

    def _affinity(self, x: np.ndarray) -> np.ndarray:
        d = np.maximum((x**2).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * x @ self.points.T, 0)
        own = np.sort(d, axis=1)[:, min(self.params.get("neighbours", 5), d.shape[1] - 1)]
        reach = self.reach if hasattr(self, "reach") else own
        return np.exp(-d / np.maximum(np.sqrt(own[:, None] * reach[None]), 1e-300))

    def decompose(self) -> None:
        d = np.maximum((self.points**2).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * self.points @ self.points.T, 0)
        self.reach = np.sort(d, axis=1)[:, min(self.params.get("neighbours", 5), len(d) - 1)]
        k = self._affinity(self.points)
        self.mass = k.sum(1)
        k = k / self.mass[:, None] / self.mass[None]  # the density of landmarks plays no part
        self.degree = k.sum(1)
        values, vectors = np.linalg.eigh(k / np.sqrt(self.degree)[:, None] / np.sqrt(self.degree)[None])
        order = np.argsort(-values)[1 : self.k + 1]
        self.values = values[order]
        safe = np.where(np.abs(self.values) > 1e-12, self.values, np.inf)
        self.psi = _signed(vectors[:, order] / np.sqrt(self.degree)[:, None])
        self.weights = self.psi / safe * np.abs(self.values) ** self.params.get("time", 1)

    def project(self, z: np.ndarray) -> np.ndarray:
        k = self._affinity(z)
        k = k / np.maximum(k.sum(1, keepdims=True), 1e-300) / self.mass[None]
        return (k / np.maximum(k.sum(1, keepdims=True), 1e-300)) @ self.weights


METHODS = {"kernel_pca": KernelPCA, "diffusion": Diffusion}
METHOD_OF = {v: k for k, v in METHODS.items()}


def reducer(method: str, features: list[str], k: int = 2, **params) -> PCA | Landmarks:
    """An embedding to be fitted: pca, kernel_pca or diffusion."""
    if method == "pca":
        return PCA(features, k, **params)
    if method not in METHODS:
        raise ValueError(f"unknown embedding {method!r}; known: pca, {', '.join(METHODS)}")
    return METHODS[method](features, k, **params)


def reduced(df: DataFrame, features: list[str], method: str = "pca", k: int = 2, fit_on: DataFrame | None = None, id_col: str = "event_id", **params) -> DataFrame:
    """df with the coordinates of an embedding of its events (or of other ones); columns are named for the method, PCA1, KernelPCA1, Diffusion1 and so on."""
    model = reducer(method, features, k, **params)
    given = df if fit_on is None else fit_on
    return (model.fit(given) if method == "pca" else model.fit(given, id_col)).transform(df)


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    """Of an embedding y of a small table x: 1, less what neighbours in y that are far in x cost."""
    n = len(x)
    apart = lambda v: np.argsort(np.argsort(((v[:, None] - v[None]) ** 2).sum(-1) + np.diag(np.full(n, -1.0)), axis=1, kind="stable"), axis=1)
    rx, ry = apart(x), apart(y)
    cost = np.where((ry >= 1) & (ry <= k), np.maximum(rx - k, 0), 0).sum()
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * cost)
