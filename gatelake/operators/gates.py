"""Gates: fitted on data or given by hand, applied to any number of samples as one lazy plan.

fit() runs one or two small aggregates and keeps the shape; predict() only builds Column expressions. NaN and null values are in no child.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import density, geometry, transforms
from ..functions.quantiles import quantiles
from ..functions.transforms import number
from ..session import stored
from . import sampling
from .features import PCA

#: Corners of a gate's polygons that a plan has as expressions; more are tested in Arrow batches.
PLAN_CORNERS = 2000
ONE_AXIS, TWO_AXES = ("+", "-"), ("++", "+-", "-+", "--")


@dataclass
class Child:
    """A named part of a gate: definitions of a threshold gate, or a polygon, with its mean signature."""

    name: str
    definition: str | None = None
    polygon: list[geometry.Point] | None = None
    signature: dict[str, float] = field(default_factory=dict)

    def matches(self, definition: str) -> bool:
        return bool({*(self.definition or "").split(",")} & {*definition.split(",")})


@dataclass
class Gate:
    """Common parts. transform_x and transform_y name the scale in which the shape lives."""

    name: str
    parent: str
    x: str
    y: str | None = None
    transform_x: str | None = None
    transform_y: str | None = None
    transform_params: dict = field(default_factory=dict)
    method: str = "manual"
    params: dict = field(default_factory=dict)
    sample: int | None = None
    #: How a sample for fitting is drawn: method (uniform, density, faithful) and its parameters.
    sampling: dict = field(default_factory=dict)
    #: features to be embedded first, method (pca, kernel_pca, diffusion) and params; x and y are then PCA1 and PCA2, or KernelPCA1... The fitted embedding is kept here.
    embedding: dict = field(default_factory=dict)
    #: Knots by axis that move a sample's landmarks onto a reference's, in gate scale.
    warp: dict = field(default_factory=dict)
    children: list[Child] = field(default_factory=list)

    def raw(self, name: str) -> Column:
        """An axis before its scale: a column, or a component of the embedding."""
        e = self.embedding
        if e.get("method", "pca") != "pca":
            from .embedding import METHODS, Landmarks

            prefix = METHODS[e["method"]].name
            return Landmarks.from_state(e["fitted"]).column(int(name.removeprefix(prefix)) - 1) if name.startswith(prefix) else number(name)
        if not e or not name.startswith("PCA"):
            return number(name)
        j = int(name[3:]) - 1
        parts = [(number(f) - e["mean"][i]) / e["sd"][i] * e["components"][i][j] for i, f in enumerate(e["features"])]
        return sum(parts[1:], parts[0])

    def column(self, axis: str) -> Column:
        name, method = (self.x, self.transform_x) if axis == "x" else (self.y, self.transform_y)
        out = transforms.finite(transforms.make(method, **self.transform_params.get(axis, {})), self.raw(name))
        return transforms.piecewise(out, *self.warp[axis]) if axis in self.warp else out

    def transform_info(self) -> tuple[dict[str, str | None], dict[str, dict]]:
        """Scale and its parameters by axis name."""
        axes = {"x": (self.x, self.transform_x), "y": (self.y, self.transform_y)}
        used = {k: v for k, v in axes.items() if v[0]}
        return {n: m for n, m in used.values()}, {n: self.transform_params.get(k, {}) for k, (n, _) in used.items()}

    def embed(self, df: DataFrame) -> None:
        """Fit the embedding, if there is one and it isn't fitted."""
        if not self.embedding or "components" in self.embedding or "fitted" in self.embedding:
            return
        if (method := self.embedding.get("method", "pca")) != "pca":
            from .embedding import reducer

            id_col = "event_id" if "event_id" in df.columns else df.columns[0]
            self.embedding["fitted"] = reducer(method, list(self.embedding["features"]), 2, **self.embedding.get("params", {})).fit(df, id_col).state()
        else:
            p = PCA(list(self.embedding["features"]), 2).fit(df)
            self.embedding |= {"mean": p.mean.tolist(), "sd": p.sd.tolist(), "components": p.components.tolist()}

    def linear(self, spark: SparkSession, points: list[geometry.Point | tuple[float, None]]) -> list[tuple[float, float | None]]:
        """Points of gate scale on the axes' own scale."""
        x, y = (transforms.make(m, **self.transform_params.get(a, {})).inverse for a, m in (("x", self.transform_x), ("y", self.transform_y)))
        rows = spark.createDataFrame([(i, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(points)], "i int, x double, y double")
        return [(r.x, r.y) for r in rows.select("i", x(F.col("x")).alias("x"), y(F.col("y")).alias("y")).orderBy("i").collect()]

    def scaled(self, df: DataFrame) -> DataFrame:
        """The axes as _x and _y, in gate scale, with missing values left out."""
        out = df.withColumn("_x", self.column("x"))
        out = out.withColumn("_y", self.column("y")) if self.y else out
        return out.where(F.col("_x").isNotNull() & (F.col("_y").isNotNull() if self.y else F.lit(True)))

    def require(self, df: DataFrame) -> None:
        if missing := [c for c in (self.embedding.get("features") or (self.x, self.y)) if c and c not in df.columns]:
            raise ValueError(f"{self.name}: no column {', '.join(missing)}")

    def fitted_on(self, df: DataFrame) -> DataFrame:
        self.require(df)
        self.embed(df)
        id_col = "event_id" if "event_id" in df.columns else df.columns[0]
        how = {"method": "uniform", "size": self.sample} if self.sample else dict(self.sampling)
        method = how.pop("method", None)
        if method is None:
            return df
        if method == "uniform":
            return sampling.uniform(df, how.pop("size"), id_col=id_col, **how)
        axes = [a for a in (self.x, self.y) if a]
        if method == "density":
            return sampling.density_downsample(df, axes, how.pop("size"), id_col=id_col, **how)
        if method == "faithful":
            return sampling.faithful_downsample(df, axes, how.pop("h"), id_col=id_col)
        raise ValueError(f"unknown sampling {method!r}")

    def upsampled(self, df: DataFrame, k: int = 5) -> DataFrame:
        """df with `population`: what most of the k nearest events of the fitting sample are in; '' for none."""
        part = self.fitted_on(df)
        axes = [a for a in (self.x, self.y) if a]
        names = F.array(*[F.when(p, F.lit(n)) for n, p in self.predicates().items()])
        labelled = part.withColumn("population", F.coalesce(F.get(F.filter(names, lambda n: n.isNotNull()), F.lit(0)), F.lit("")))
        return sampling.knn_predict(df, labelled, axes, "population", k, to="population")

    def child(self, name: str) -> Child:
        return next(c for c in self.children if c.name == name)

    def add_child(self, child: Child) -> None:
        if any(c.name == child.name for c in self.children):
            raise ValueError(f"there is a child {child.name!r} already")
        self.check_child(child)
        self.children.append(child)

    def check_child(self, child: Child) -> None:
        """An error if the child doesn't fit the gate."""

    def reset(self) -> None:
        self.children = []

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__, **dataclasses.asdict(self)})

    @staticmethod
    def from_json(text: str) -> Gate:
        said = json.loads(text)
        kind = {k.__name__: k for k in (ThresholdGate, PolygonGate, EllipseGate, BooleanGate)}[said.pop("kind")]
        said["children"] = [Child(**{**c, "polygon": [tuple(p) for p in c["polygon"]] if c["polygon"] else None}) for c in said["children"]]
        return kind(**said)

    def predicates(self) -> dict[str, Column]:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        """df with a row for each child that holds it, in column `population` (threshold children are disjoint, polygons may overlap)."""
        self.require(df)
        names = F.array(*[F.when(p, F.lit(n)) for n, p in self.predicates().items()])
        return df.withColumn("population", F.explode(F.filter(names, lambda n: n.isNotNull())))


@dataclass
class ThresholdGate(Gate):
    """Cuts one or two axes: '+' is >= threshold. Methods: manual (x, y), quantile (q), density."""

    thresholds: tuple[float, float | None] | None = None

    def find(self, df: DataFrame, control: DataFrame | None = None) -> tuple[float, float | None]:
        """Thresholds of the data in gate scale; with control data the greater of both, but the control's where the data have one peak only."""
        if self.method == "manual":
            given = []
            for axis in ("x", "y"):
                if axis == "y" and not self.y:
                    given.append(None)
                    continue
                value = F.lit(float(self.params[axis]))
                scale = transforms.make(self.transform_x if axis == "x" else self.transform_y, **self.transform_params.get(axis, {}))
                given.append(df.sparkSession.range(1).select(transforms.finite(scale, value).alias("v")).head().v)
            return given[0], given[1]
        axes = ["_x", "_y"] if self.y else ["_x"]
        scaled = self.scaled(self.fitted_on(df))
        if self.method == "quantile":
            got = self._quantiles(scaled, axes)
            if control is not None:
                got = [max(a, b) for a, b in zip(got, self._quantiles(self.scaled(self.fitted_on(control)), axes), strict=True)]
        elif self.method == "density":
            got = []
            other = self.scaled(self.fitted_on(control)) if control is not None else None
            for a in axes:
                options = {k: v for k, v in self.params.items() if k in ("least_height", "spacing", "use_inflection", "quantile")}
                cut, peaks = density.threshold(density.kde(scaled, a), **options)
                if other is not None:
                    ctrl = density.threshold(density.kde(other, a), **options)[0]
                    cut = ctrl if peaks == 1 else max(cut, ctrl)
                got.append(cut)
        else:
            raise ValueError(f"unknown method {self.method!r}")
        return got[0], got[1] if self.y else None

    def _quantiles(self, scaled: DataFrame, axes: list[str]) -> list[float]:
        row = quantiles(scaled, axes, [float(self.params.get("q", 0.95))]).head()
        return [row[a][0] for a in axes]

    def fit(self, df: DataFrame, control: DataFrame | None = None) -> ThresholdGate:
        if self.children:
            raise ValueError("the gate has children; reset it first")
        self.thresholds = self.find(df, control)
        self.children = [Child(d, d) for d in (TWO_AXES if self.y else ONE_AXIS)]
        return self

    def check_child(self, child: Child) -> None:
        known = TWO_AXES if self.y else ONE_AXIS
        if not child.definition or not set(child.definition.split(",")) <= set(known):
            raise ValueError(f"{child.name}: a definition is one or more of {', '.join(known)}")

    def to_linear(self, spark: SparkSession) -> tuple[float, float | None]:
        """The thresholds on the axes' own scale."""
        return self.linear(spark, [self.thresholds])[0]

    def fit_predict(self, df: DataFrame, control: DataFrame | None = None) -> DataFrame:
        """Thresholds anew, with the children's names."""
        self.thresholds = self.find(df, control)
        return self.predict(df)

    def label(self, names: dict[str, str]) -> None:
        """Rename children; those that share a name are merged, their definitions joined by commas."""
        merged: dict[str, Child] = {}
        for c in self.children:
            name = names.get(c.name, c.name)
            old = merged.get(name)
            merged[name] = Child(name, f"{old.definition},{c.definition}" if old else c.definition)
        self.children = list(merged.values())

    def definition(self) -> Column:
        """'+' / '-' or the quadrant of each event."""
        x, y = self.thresholds
        return geometry.side(self.column("x"), x) if not self.y else geometry.quadrant(self.column("x"), self.column("y"), x, y)

    def predicates(self) -> dict[str, Column]:
        d = self.definition()
        return {c.name: F.coalesce(d.isin(c.definition.split(",")), F.lit(False)) for c in self.children}

    def edit(self, x: float, y: float | None = None) -> None:
        """New thresholds in gate scale; whatever builds on the gate is recomputed when it is next read."""
        self.thresholds = (x, y)


def clustered(df: DataFrame, columns: list[str], method: str, k: int, seed: int = 42, **params) -> DataFrame:
    """df with `cluster`, by an estimator of Spark ML."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.feature import VectorAssembler

    kinds = {"kmeans": KMeans, "gmm": GaussianMixture, "bisecting_kmeans": BisectingKMeans}
    if method not in kinds:
        raise ValueError(f"unknown clusterer {method!r}; known: {', '.join(kinds)}")
    data = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    model = kinds[method](k=k, seed=seed, featuresCol="_v", predictionCol="cluster", **params).fit(data)
    out = model.transform(data)
    return out.drop("_v", *(c for c in out.columns if c == "probability"))


@dataclass
class PolygonGate(Gate):
    """Polygons in gate scale; overlap is allowed. Methods: manual (x_values, y_values), or a clusterer whose clusters' hulls are the shapes.

    Clusterers: kmeans, gmm, bisecting_kmeans (k, seed), dbscan (eps, least), hdbscan (least, samples), graph (k, seed), in gate scale.
    """

    def shapes(self, df: DataFrame) -> list[list[geometry.Point]]:
        if self.method == "manual":
            points = list(zip(self.params["x_values"], self.params["y_values"], strict=True))
            return [[tuple(map(float, p)) for p in points]]
        scaled = self.scaled(self.fitted_on(df)).select("_x", "_y")
        if self.method in ("dbscan", "hdbscan", "graph"):
            from .clustering import shaped_clusters

            rows = stored(scaled.withColumn("_row", F.monotonically_increasing_id()), "gated")
            labelled = shaped_clusters(rows, ["_x", "_y"], self.method, id_col="_row", **self.params).where("cluster_label >= 0").withColumnRenamed("cluster_label", "cluster")
        else:
            labelled = clustered(scaled, ["_x", "_y"], self.method, int(self.params.get("k", 2)), seed=int(self.params.get("seed", 42)))
        found = group_hulls(labelled.select(F.col("cluster").alias("_g"), "_x", "_y"))
        return [found[g] for g in sorted(found) if found[g]]

    def check_child(self, child: Child) -> None:
        if not child.polygon or len(child.polygon) < 3:
            raise ValueError(f"{child.name}: a polygon has three vertices or more")

    def to_linear(self, spark: SparkSession) -> dict[str, list[geometry.Point]]:
        """The children's vertices on the axes' own scale."""
        return {c.name: self.linear(spark, c.polygon) for c in self.children}

    def fit(self, df: DataFrame, control: DataFrame | None = None) -> PolygonGate:
        if self.children:
            raise ValueError("the gate has children; reset it first")
        found = sorted(self.shapes(df), key=lambda s: tuple(np.mean(s, axis=0)))
        self.children = [Child(chr(65 + i), polygon=s) for i, s in enumerate(found)]
        return self

    def fit_predict(self, df: DataFrame, control: DataFrame | None = None) -> DataFrame:
        """New shapes, matched to the children by least Hausdorff distance; each shape is given once, closest pairs first."""
        shapes, done, used = self.shapes(df), set(), set()
        options = sorted(((geometry.hausdorff(c.polygon, s), i, j) for (i, c), (j, s) in itertools.product(enumerate(self.children), enumerate(shapes))), key=lambda o: o[0])
        for _, i, j in options:
            if i not in done and j not in used:
                self.children[i].polygon = shapes[j]
                done.add(i)
                used.add(j)
        return self.predict(df)

    def label(self, names: dict[str, str], drop: bool = True) -> None:
        """Rename children; those without a new name go, unless drop is off."""
        if len(set(names.values())) < len(names):
            raise ValueError("two children would get one name")
        self.children = [dataclasses.replace(c, name=names.get(c.name, c.name)) for c in self.children if c.name in names or not drop]

    def predicates(self) -> dict[str, Column]:
        return {c.name: geometry.in_polygon(self.column("x"), self.column("y"), c.polygon) for c in self.children}

    def predict(self, df: DataFrame) -> DataFrame:
        if sum(len(c.polygon) for c in self.children) <= PLAN_CORNERS:
            return super().predict(df)
        self.require(df)
        held = geometry.holders(self.column("x"), self.column("y"), {c.name: c.polygon for c in self.children})
        return df.withColumn("population", F.explode(held))

    def edit(self, name: str, polygon: list[geometry.Point]) -> None:
        self.child(name).polygon = polygon


@dataclass
class EllipseGate(PolygonGate):
    """Ellipses as polygons. Methods: manual (centre, width, height, angle), or normal components with a confidence level."""

    def shapes(self, df: DataFrame) -> list[list[geometry.Point]]:
        if self.method == "manual":
            p = self.params
            return [geometry.ellipse_polygon(tuple(p["centre"]), p["width"], p["height"], p["angle"])]
        k, conf = int(self.params.get("k", 1)), float(self.params.get("conf", 0.95))
        scaled = self.scaled(self.fitted_on(df)).select("_x", "_y")
        labelled = scaled.withColumn("cluster", F.lit(0)) if k == 1 else clustered(scaled, ["_x", "_y"], "gmm", k, seed=int(self.params.get("seed", 42)))
        moments = labelled.groupBy("cluster").agg(F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.var_samp("_x").alias("xx"), F.var_samp("_y").alias("yy"), F.covar_samp("_x", "_y").alias("xy")).collect()
        return [geometry.ellipse_polygon((m.x, m.y), *geometry.confidence_ellipse(m.xx, m.yy, m.xy, conf)) for m in moments if m.xx and m.yy]


@dataclass
class BooleanGate(Gate):
    """A population made of others: events in any ('or') or all ('and') of them, or in the first and none of the others ('not').

    It has one child. Its predicate is made of the populations' own, see Strategy.definitions; x and y are the axes it is shown on.
    """

    populations: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame | None = None, control: DataFrame | None = None) -> BooleanGate:
        if self.children:
            raise ValueError("the gate has children; reset it first")
        if self.method not in ("or", "and", "not") or len(self.populations) < 2:
            raise ValueError("a boolean gate is 'or', 'and' or 'not' of two populations or more")
        self.children = [Child("A")]
        return self

    def label(self, names: dict[str, str]) -> None:
        self.children = [dataclasses.replace(c, name=names.get(c.name, c.name)) for c in self.children]

    def combined(self, full: dict[str, Column]) -> dict[str, Column]:
        """The child's predicate, of the whole predicates of the populations."""
        first, *others = [F.coalesce(full[p], F.lit(False)) for p in self.populations]
        out = first
        for o in others:
            out = out | o if self.method == "or" else out & (o if self.method == "and" else ~o)
        return {c.name: out for c in self.children}

    def fit_predict(self, df: DataFrame, membership: DataFrame) -> DataFrame:
        """df's events of the child, for populations that are stored as members; the hull on x and y becomes the child's shape."""
        found = boolean(df, membership, self.method, self.populations)
        if self.y:
            shape = group_hulls(self.scaled(found).select(F.lit(0).alias("_g"), "_x", "_y")).get(0)
            self.children = [dataclasses.replace(c, polygon=shape or None) for c in self.children]
        return found.withColumn("population", F.lit(self.children[0].name))


def group_hulls(points: DataFrame) -> dict:
    """The convex hull of each group of points(_g, _x, _y). Every partition makes hulls of its own, and hulls merge: corners only reach the driver."""
    kind = points.schema["_g"].dataType.simpleString()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for g, own in pdf.groupby("_g"):
                held[g] = _corners(np.vstack([held.get(g, np.zeros((0, 2))), own[["_x", "_y"]].to_numpy(float)]))
        yield pd.DataFrame([(g, float(a), float(b)) for g, ring in held.items() for a, b in ring], columns=["_g", "_x", "_y"])

    got = points.mapInPandas(part, f"_g {kind}, _x double, _y double").toPandas()
    return {g: geometry.convex_hull(own[["_x", "_y"]].to_numpy(float)) for g, own in got.groupby("_g")}


def _corners(points: np.ndarray) -> np.ndarray:
    """The hull's corners; of points on one line the two ends."""
    hull = geometry.convex_hull(points)
    if hull:
        return np.array(hull)
    points = np.unique(points, axis=0)
    return points[[0, -1]] if len(points) > 2 else points


def merge_children(children: list[Child], name: str) -> Child:
    """One child of several: definitions joined, polygons by their common outline, signatures by the mean over those that have the feature."""
    if all(c.definition for c in children):
        definition = ",".join(sorted({d for c in children for d in c.definition.split(",")}))
        shape = None
    else:
        definition, shape = None, children[0].polygon
        for c in children[1:]:
            shape = geometry.union_outline(shape, c.polygon)
    features = sorted({f for c in children for f in c.signature})
    mean = {f: float(np.mean([c.signature[f] for c in children if f in c.signature])) for f in features}
    return Child(name, definition, shape, mean)


def mergeable(left: Gate, right: Gate) -> None:
    """An error unless two gates have the same axes and scales."""
    if (left.x, left.y) != (right.x, right.y) or left.transform_info() != right.transform_info():
        raise ValueError(f"{left.name} and {right.name} differ in axes or scales")


def boolean(df: DataFrame, membership: DataFrame, how: str, populations: list[str]) -> DataFrame:
    """Events in any ('or') or all ('and') of the populations, or in the first and none of the others ('not')."""
    from . import populations as P

    sets = {"or": lambda: P.merged(membership, populations, "A"), "and": lambda: P.intersected(membership, populations, "A"), "not": lambda: P.subtracted(membership, populations[0], populations[1:], "A")}
    return df.join(sets[how](), ["sample_id", "event_id"], "left_semi")


def signatures(df: DataFrame, features: list[str], population: str = "population") -> dict[str, dict[str, float]]:
    """Mean of each feature by population."""
    rows = df.groupBy(population).agg(*[F.avg(number(f)).alias(f) for f in features]).collect()
    return {r[population]: {f: r[f] for f in features if r[f] is not None} for r in rows}


def cost(target: Child, candidate: Child, how: str = "manhattan") -> float:
    """How far a candidate population is from a target: by signatures over shared features, or by shapes."""
    if how == "hausdorff":
        return geometry.hausdorff(target.polygon, candidate.polygon)
    shared = sorted({*target.signature} & {*candidate.signature})
    d = np.array([target.signature[f] - candidate.signature[f] for f in shared])
    return float(np.abs(d).sum() if how == "manhattan" else np.sqrt((d**2).sum()))


def signature_vector(signature: dict[str, float], features: list[str]) -> list[float]:
    return [signature[f] for f in features]


def closest_signature(target: dict[str, float], candidates: DataFrame, features: list[str], how: str = "manhattan", by: str = "population") -> DataFrame:
    """closest: the candidate (a row with features) whose signature is nearest to the target's over the features both have."""
    shared = [f for f in features if f in target]
    parts = [F.abs(F.col(f) - F.lit(float(target[f]))) if how == "manhattan" else (F.col(f) - F.lit(float(target[f]))) ** 2 for f in shared]
    return candidates.agg(F.min_by(by, sum(parts[1:], parts[0])).alias("closest"))


def large_enough(found: DataFrame, least: int = 3) -> DataFrame:
    """population, n of the populations that have at least `least` events."""
    return found.groupBy("population").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def grid_search(gate: Gate, grid: dict[str, list], df: DataFrame, features: list[str], how: str = "manhattan", least: int = 3) -> dict[str, tuple[dict, float]]:
    """For each child the parameters whose refitted population is closest to it, among populations of at least `least` events.

    A candidate's parameters extend the gate's own.
    """
    best: dict[str, tuple[dict, float]] = {}
    for values in itertools.product(*grid.values()):
        params = {**gate.params, **dict(zip(grid, values, strict=True))}
        trial = dataclasses.replace(gate, params=params, children=[dataclasses.replace(c) for c in gate.children])
        found = trial.fit_predict(df)
        sizes = {r.population: r.n for r in large_enough(found, least).collect()}
        means = signatures(found, features)
        for c in gate.children:
            if c.name in sizes:
                new = dataclasses.replace(trial.child(c.name), signature=means[c.name])
                price = cost(c, new, how)
                if c.name not in best or price < best[c.name][1]:
                    best[c.name] = (params, price)
    return best
