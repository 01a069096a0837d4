"""The numbers behind plots: limits, histograms, shapes, layers and scatter tables. Nothing is rendered."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import density, geometry, transforms
from ..functions.quantiles import quantiles
from ..functions.transforms import number
from . import clustering, sampling
from .features import PCA, histogram2d
from .gates import BooleanGate, Gate, ThresholdGate

if TYPE_CHECKING:
    from ..plans.strategy import Strategy

Limits = tuple[float, float]


def axis_limits(df: DataFrame, axes: list[str], *, autoscale: bool = False, positive: tuple[str, ...] = (), share: float = 0.001) -> DataFrame:
    """axis, least, most: the outer quantiles of each axis, or its range with autoscale; of positive values only for the axes in `positive` (log scales)."""
    xs = {a: F.when(number(a) > 0, number(a)) if a in positive else number(a) for a in axes}
    if autoscale:
        row = df.agg(*[F.array(F.min(x), F.max(x)).alias(a) for a, x in xs.items()])
    else:
        row = quantiles(df.select(*[x.alias(a) for a, x in xs.items()]), axes, [share, 1 - share])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a)[0].alias("least"), F.col(a)[1].alias("most")) for a in axes])))


def transformed_limits(limits: DataFrame, methods: dict[str, str | None], params: dict[str, dict] | None = None) -> DataFrame:
    """Limits through the scale of each axis."""
    least, most = F.col("least"), F.col("most")
    for a, m in methods.items():
        scale = transforms.make(m, **(params or {}).get(a, {}))
        least = F.when(F.col("axis") == a, transforms.finite(scale, F.col("least"))).otherwise(least)
        most = F.when(F.col("axis") == a, transforms.finite(scale, F.col("most"))).otherwise(most)
    return limits.select("axis", least.alias("least"), most.alias("most"))


def histogram1d(df: DataFrame, x: str, grid: int = 256, **kwargs) -> DataFrame:
    """x, density: the smooth histogram of one axis."""
    d = density.kde(df, x, grid=grid, **kwargs)
    return df.sparkSession.createDataFrame([(float(a), float(p)) for a, p in zip(d.x, d.p, strict=True)], "x double, density double")


def plot(df: DataFrame, x: str, y: str | None = None, bins: int = 64) -> DataFrame:
    """The data of a plot of one axis (x, density) or two (bx, by, n), between the axes' limits."""
    if y is None:
        return histogram1d(df, x, bins)
    at = {r.axis: (r.least, r.most) for r in axis_limits(df, [x, y]).collect()}
    return histogram2d(df, x, y, bins, at[x], at[y])


def shapes(gate: Gate, df: DataFrame) -> DataFrame:
    """child, i, x, y: the vertices of a gate's shapes in gate scale; of a threshold gate its lines' places (null: no line on that axis)."""
    if isinstance(gate, ThresholdGate):
        rows = [(c.name, 0, *map(lambda v: None if v is None else float(v), gate.thresholds)) for c in gate.children]
    else:
        rows = [(c.name, i, float(a), float(b)) for c in gate.children for i, (a, b) in enumerate(c.polygon or [])]
    return df.sparkSession.createDataFrame(rows, "child string, i int, x double, y double")


def gate_plot(gate: Gate, parent: DataFrame, bins: int = 64) -> tuple[DataFrame, DataFrame]:
    """The parent's histogram on the gate's axes in gate scale, and the children's shapes."""
    scaled = gate.scaled(parent)
    return plot(scaled, "_x", "_y" if gate.y else None, bins), shapes(gate, parent)


def strategy_plots(strategy: Strategy, events: DataFrame, bins: int = 64) -> dict[str, tuple[DataFrame, DataFrame]]:
    """`gate_plot` of every gate that has a shape, on its parent's events."""
    return {g.name: gate_plot(g, strategy.population(events, g.parent), bins) for g in strategy.ordered() if not isinstance(g, BooleanGate)}


def population_histogram(events: DataFrame, x: str, y: str | None = None, *, scale_x: str | None = "logicle", scale_y: str | None = "logicle", bins: int = 64) -> DataFrame:
    """`plot` of a population's events on transformed axes."""
    axes = {x: scale_x} | ({y: scale_y} if y else {})
    return plot(transforms.apply(events, axes), x, y, bins)


def cluster_scatter(events: DataFrame, features: list[str], label: str = clustering.CLUSTER, *, sample: str | None = None, size: int = 10_000, id_col: str = "event_id") -> DataFrame:
    """`scatter` of one sample's events (or all) on their first two components, by cluster."""
    own = events if sample is None else events.where(F.col(clustering.SAMPLE) == sample)
    return scatter(PCA(features, 2).fit(own).transform(own), "PCA1", "PCA2", label, size=size, id_col=id_col)


def population_plot(parent: DataFrame, children: dict[str, DataFrame], x: str, y: str, bins: int = 64) -> tuple[DataFrame, DataFrame]:
    """The parent's histogram, and population, i, x, y: the hull of each child's events on these axes."""
    rows = [(n, i, a, b) for n, df in children.items() for i, (a, b) in enumerate(hulls(df.select(F.lit(0).alias("g"), x, y), "g", x, y).get(0, []))]
    return plot(parent, x, y, bins), parent.sparkSession.createDataFrame(rows, "population string, i int, x double, y double")


def hulls(df: DataFrame, by: str, x: str, y: str) -> dict:
    """The convex hull of each group. Partitions make hulls of their own, which merge, so that no group is gathered."""
    from .gates import group_hulls

    return group_hulls(df.select(F.col(by).alias("_g"), number(x).alias("_x"), number(y).alias("_y")).dropna(subset=["_x", "_y"]))


def overlay(layers: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rows of several data sets with the name of theirs in `layer`."""
    parts = [df.select(*columns, F.lit(n).alias("layer")) for n, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlay_densities(layers: dict[str, DataFrame], x: str, grid: int = 256) -> DataFrame:
    """layer, x, density: smooth histograms of several data sets over one range."""
    parts = {n: density.kde(df, x, grid=grid) for n, df in layers.items()}
    lo, hi = min(float(d.x[0]) for d in parts.values()), max(float(d.x[-1]) for d in parts.values())
    some = next(iter(layers.values()))
    rows = []
    for n, df in layers.items():
        d = density.kde(df, x, grid=grid, lo=lo, hi=hi)
        rows += [(n, float(a), float(p)) for a, p in zip(d.x, d.p, strict=True)]
    return some.sparkSession.createDataFrame(rows, "layer string, x double, density double")


def scatter(df: DataFrame, x: str, y: str, label: str | None = None, *, size: int = 10_000, scale: str | None = None, id_col: str = "event_id", seed: int = 0) -> DataFrame:
    """id, x, y and label of a sample of rows without missing values; numeric labels may be scaled ('zscore', 'minmax') over all rows."""
    label_of = [] if label is None else [F.col(label).alias("label")]
    data = df.select(F.col(id_col), number(x).alias("x"), number(y).alias("y"), *label_of).dropna()
    if scale and label:
        row = data.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s"), F.min("label").alias("lo"), F.max("label").alias("hi")).head()
        shift, by = (row.m, row.s) if scale == "zscore" else (row.lo, row.hi - row.lo)
        data = data.withColumn("label", (F.col("label") - F.lit(float(shift))) / F.lit(float(by) or 1.0))
    return sampling.uniform(data, size, id_col=id_col, seed=seed)


def heatmap(df: DataFrame, features: list[str], index: str, *, how: str = "median", scale: str | None = "minmax") -> DataFrame:
    """index and features: a row of medians (or means) for each index value, columns scaled to 0...1 over the rows ('zscore': to deviations)."""
    table = clustering.summarise(df, features, how, (index,))
    if scale is None:
        return table
    method = {"minmax": "minmax", "zscore": "standard"}[scale]
    return transforms.Scaler(method).fit(table, features).transform(table)


def bubbles(df: DataFrame, features: list[str], *, label: str | None = None, embed: int | None = 2) -> DataFrame:
    """Centroids of each sample's clusters with their share of the sample, an embedding (PCA1...), and the clusters' own label if there is one."""
    table = clustering.summarise(df, features)
    if embed:
        table = PCA(features, embed).fit(table).transform(table)
    keys = [clustering.SAMPLE, clustering.CLUSTER]
    table = table.join(clustering.sizes(df), keys)
    if label:
        table = table.join(df.select(*keys, F.col(label).alias("label")).distinct(), keys)
    return table


def population_overlap(first: list[geometry.Point], second: list[geometry.Point]) -> float:
    """The share of the first shape's area inside the second's outline."""
    import numpy as np

    return geometry.overlap(first, geometry.convex_hull(np.array(second)))


__all__ = ["axis_limits", "bubbles", "cluster_scatter", "gate_plot", "heatmap", "histogram1d", "hulls", "overlay", "overlay_densities", "plot", "population_histogram", "population_overlap", "population_plot", "scatter", "shapes", "strategy_plots", "transformed_limits"]
