"""Strategies fitted anew to every sample, all samples in one plan.

What a gate finds is a table with a row for each sample: thresholds, or polygons, and knots of a registration. The tables are made by grouped aggregates and,
for what numpy does with them, by one task a sample that holds at most density.GRID counts or some hulls' corners. They are joined to the
events by sample, and the gate's predicates read their columns. The number of jobs depends on the gates alone.
"""

from __future__ import annotations

import copy
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import density, geometry
from ..functions.quantiles import quantiles
from ..functions.transforms import number
from ..operators import clustering
from ..operators import gates as G
from ..operators import populations as P
from ..operators.gates import BooleanGate, EllipseGate, Gate, ThresholdGate
from ..session import stored

SAMPLE = "sample_id"
POINTS = "array<struct<x: double, y: double>>"


def covers(strategy, search: bool) -> bool:
    """Whether all of a strategy's gates can be fitted so: without a grid, an embedding to be fitted, or a sample by density."""
    return all(_covered(g, search and g.name in strategy.grids) for g in strategy.gates)


def _covered(g: Gate, searched: bool) -> bool:
    if isinstance(g, BooleanGate) or (g.method == "manual" and not searched):
        return True
    drawn = not g.sampling or g.sampling.get("method") == "uniform"
    embedded = not g.embedding or "components" in g.embedding or "fitted" in g.embedding
    method = g.method in ("quantile", "density") if isinstance(g, ThresholdGate) else int(g.params.get("k", 1)) == 1 if isinstance(g, EllipseGate) else g.method in ("kmeans", *clustering.SHAPED)
    return not searched and drawn and embedded and method


class TooFew(ValueError):
    """Samples in which a gate's parent has too few events."""

    def __init__(self, said: str, samples: list) -> None:
        super().__init__(said)
        self.samples = samples


class Fitted:
    """Populations of a strategy fitted to each sample: `events` with the samples' parameters, and predicates over both."""

    def __init__(self, events: DataFrame, control: DataFrame | None) -> None:
        self.events, self.control = events, control
        self.definitions: dict[str, tuple[str, Column]] = {}
        self.samples = stored(events.select(SAMPLE).distinct(), "samples")

    def join(self, table: DataFrame) -> None:
        """Give events, and controls, the columns of a table with a row for each sample."""
        self.events = self.events.join(table, SAMPLE, "left")
        if self.control is not None:
            self.control = self.control.join(table, SAMPLE, "left")

    def population(self, name: str, control: bool = False) -> DataFrame:
        out = self.control if control else self.events
        while name != P.ROOT:
            name, predicate = self.definitions[name]
            out = out.where(predicate)
        return out

    def membership(self) -> DataFrame:
        return P.gated(self.events, self.definitions)


def fitted(strategy, events: DataFrame, *, reference: DataFrame | None = None, control: DataFrame | None = None, normalise: bool = False, params: dict[str, dict] | None = None) -> Fitted:
    """The strategy fitted to each sample of the events; see Strategy.applied. Control events serve the sample that they name."""
    from .strategy import LEAST_EVENTS, _define

    out = Fitted(events, control)
    for at, g in enumerate(strategy.ordered()):
        gate = copy.deepcopy(g)
        gate.params |= (params or {}).get(g.name, {})
        if isinstance(gate, BooleanGate):
            _define(out.definitions, gate)
            continue
        parent = out.population(g.parent)
        few = out.samples.join(parent.groupBy(SAMPLE).agg(F.count("*").alias("n")), SAMPLE, "left").where(F.coalesce("n", F.lit(0)) < LEAST_EVENTS).select(SAMPLE).collect()
        if few:
            raise TooFew(f"{g.name}: {g.parent} has too few events", sorted(r[0] for r in few))
        if normalise and g.name in strategy.references and reference is not None:
            out.join(_knots(gate, parent, strategy.population(reference, g.parent), strategy.references[g.name]["peaks"], at))
            gate.warp = {a: (F.col(f"_k{at}{a}.x"), F.col(f"_k{at}{a}.y")) for a in ("x", "y") if a == "x" or gate.y}
            gate = _Warped(gate)
            parent = out.population(g.parent)
        if isinstance(g, ThresholdGate):
            found = _thresholds(gate, out, g.parent, at)
        elif g.method != "manual":
            found = _polygons(gate, out, g.parent, at)
        else:
            found = g.predicates() if not isinstance(gate, _Warped) else {c.name: geometry.in_polygon(gate.column("x"), gate.column("y"), c.polygon) for c in g.children}
        if again := sorted(set(found) & {*out.definitions, P.ROOT}):
            raise ValueError(f"{g.name}: there is a population {', '.join(again)} already")
        out.definitions |= {n: (g.parent, p) for n, p in found.items()}
    return out


class _Warped:
    """A gate that sees its axes through knots that are columns."""

    def __init__(self, gate: Gate) -> None:
        self.knots, self.gate = gate.warp, gate
        gate.warp = {}

    def column(self, axis: str) -> Column:
        return piecewise(self.gate.column(axis), *self.knots[axis]) if axis in self.knots else self.gate.column(axis)

    def __getattr__(self, name: str):
        return getattr(self.gate, name)


def piecewise(v: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation between increasing knots in array columns, constant outside."""
    at = F.size(F.filter(xs, lambda k: k <= v))
    i = F.greatest(F.least(at, F.size(xs) - 1), F.lit(1)).cast("int")
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    inside = y0 + (v - x0) * ((y1 - y0) / (x1 - x0))
    last = F.element_at(ys, -1)
    return F.when(v.isNotNull(), F.when((at == 0) | (F.size(xs) == 1), F.get(ys, F.lit(0))).when(at == F.size(xs), last).otherwise(inside))


def _drawn(gate: Gate, df: DataFrame) -> DataFrame:
    """Events for fitting, a sample of each sample if the gate asks for one; with _x and _y."""
    from ..operators import sampling

    gate.require(df)
    how = {"method": "uniform", "size": gate.sample} if gate.sample else dict(gate.sampling)
    if how.pop("method", None):
        df = sampling.uniform(df, how.pop("size"), id_col="event_id", by=[SAMPLE], **how)
    out = df.withColumn("_x", gate.column("x"))
    out = out.withColumn("_y", gate.column("y")) if gate.y else out
    axes = ["_x", "_y"] if gate.y else ["_x"]
    return out.select(SAMPLE, "event_id", *axes).dropna(subset=axes)


def densities(df: DataFrame, axis: str) -> DataFrame:
    """sample_id, lo, hi, h, n, cells: what `density.kde` of each sample needs, its counts at grid points (i, n, w) among it."""
    x = number(axis)
    q = quantiles(df, [axis], [0.25, 0.75], [SAMPLE]).select(SAMPLE, (F.col(axis)[1] - F.col(axis)[0]).alias("iqr"))
    row = df.groupBy(SAMPLE).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd")).join(q, SAMPLE)
    spread = F.least(F.when(F.col("sd") > 0, F.col("sd")), F.when(F.col("iqr") > 0, F.col("iqr") / 1.349))
    h = 0.9 * F.coalesce(spread, F.lit(1.0)) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    ranges = stored(row.select(SAMPLE, "n", h.alias("h"), (F.col("lo") - 3 * h).alias("lo"), (F.col("hi") + 3 * h).alias("hi")), "ranges")
    step = (F.col("hi") - F.col("lo")) / (density.GRID - 1)
    at = (x - F.col("lo")) / step
    cell = F.least(F.floor(at), F.lit(density.GRID - 2)).cast("int")
    counts = df.join(ranges, SAMPLE).groupBy(SAMPLE, cell.alias("i")).agg(F.count("*").alias("c"), F.sum(at - cell).alias("w"))
    return counts.join(ranges, SAMPLE)


def _density(pdf: pd.DataFrame) -> density.Density:
    """A sample's density, of its rows of `densities`."""
    lo, hi, h, n = (float(pdf[c].iloc[0]) for c in ("lo", "hi", "h", "n"))
    counts = np.zeros(density.GRID)
    np.add.at(counts, pdf["i"].to_numpy(), (pdf["c"] - pdf["w"]).to_numpy(float))
    np.add.at(counts, pdf["i"].to_numpy() + 1, pdf["w"].to_numpy(float))
    return density.Density(np.linspace(lo, hi, density.GRID), density.smooth(counts, (hi - lo) / (density.GRID - 1), h), int(n))


def _cuts(gate: Gate, parent: DataFrame) -> DataFrame:
    """sample_id and a struct of cut and number of peaks for each axis, x and y."""
    drawn = _drawn(gate, parent)
    axes = ["x", "y"] if gate.y else ["x"]
    kind = drawn.schema[SAMPLE].dataType.simpleString()
    if gate.method == "quantile":
        got = quantiles(drawn, [f"_{a}" for a in axes], [float(gate.params.get("q", 0.95))], [SAMPLE])
        return got.select(SAMPLE, *[F.struct(F.col(f"_{a}")[0].alias("cut"), F.lit(2).alias("peaks")).alias(a) for a in axes])
    options = {k: v for k, v in gate.params.items() if k in ("least_height", "spacing", "use_inflection", "quantile")}

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        value, peaks = density.threshold(_density(pdf), **options)
        return pd.DataFrame({SAMPLE: [pdf[SAMPLE].iloc[0]], "cut": [value], "peaks": [peaks]})

    out = None
    for a in axes:
        one = densities(drawn, f"_{a}").groupBy(SAMPLE).applyInPandas(cut, f"{SAMPLE} {kind}, cut double, peaks int").select(SAMPLE, F.struct("cut", "peaks").alias(a))
        out = one if out is None else out.join(one, SAMPLE)
    return out


def _thresholds(gate: Gate, out: Fitted, parent: str, at: int) -> dict[str, Column]:
    axes = ["x", "y"] if gate.y else ["x"]
    if gate.method == "manual":
        x, y = gate.thresholds
        cut = {"x": F.lit(x), "y": F.lit(y)}
    else:
        got = _cuts(gate, out.population(parent)).select(SAMPLE, *[F.col(a).alias(f"_own{a}") for a in axes])
        if out.control is not None:
            beside = _cuts(gate, out.population(parent, control=True)).select(SAMPLE, *[F.col(a).alias(f"_ctrl{a}") for a in axes])
            got = got.join(beside, SAMPLE, "left")
            both = {a: F.when(F.col(f"_own{a}.peaks") == 1, F.coalesce(f"_ctrl{a}.cut", f"_own{a}.cut")).otherwise(F.greatest(f"_own{a}.cut", f"_ctrl{a}.cut")) for a in axes}
        else:
            both = {a: F.col(f"_own{a}.cut") for a in axes}
        out.join(stored(got.select(SAMPLE, *[both[a].alias(f"_t{at}{a}") for a in axes]), "thresholds"))
        cut = {a: F.col(f"_t{at}{a}") for a in axes}
    d = geometry.side(gate.column("x"), cut["x"]) if not gate.y else geometry.quadrant(gate.column("x"), gate.column("y"), cut["x"], cut["y"])
    return {c.name: F.coalesce(d.isin(c.definition.split(",")), F.lit(False)) for c in gate.children}


def _knots(gate: Gate, parent: DataFrame, reference: DataFrame, peaks: dict, at: int) -> DataFrame:
    """sample_id and the knots of each axis that move its peaks onto the reference's."""
    target, drawn = gate.scaled(reference), gate.scaled(parent)
    kind = parent.schema[SAMPLE].dataType.simpleString()
    out = None
    for a in ["x", "y"] if gate.y else ["x"]:
        whole = density.kde(target, f"_{a}")

        one = densities(drawn.select(SAMPLE, f"_{a}"), f"_{a}").groupBy(SAMPLE).applyInPandas(_mover(whole, peaks), f"{SAMPLE} {kind}, x array<double>, y array<double>").select(SAMPLE, F.struct("x", "y").alias(f"_k{at}{a}"))
        out = one if out is None else out.join(one, SAMPLE)
    return stored(out, "knots")


def _mover(whole: density.Density, peaks: dict):
    def knots(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = density.warp_knots(whole, _density(pdf), **peaks)
        return pd.DataFrame({SAMPLE: [pdf[SAMPLE].iloc[0]], "x": [xs], "y": [ys]})

    return knots


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """`geometry.in_polygon` with the polygon in a column of points."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % n).alias("q")))

    def crossed(e: Column) -> Column:
        x1, y1, x2, y2 = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        at = (y - y1) * F.try_divide(x2 - x1, y2 - y1) + x1
        return F.coalesce((y >= F.least(y1, y2)) & (y < F.greatest(y1, y2)) & (x < at), F.lit(False))

    def on(e: Column) -> Column:
        x1, y1, x2, y2 = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        return ((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))

    inside = (F.size(F.filter(edges, crossed)) % 2 == 1) & ~F.exists(edges, on)
    return F.coalesce((n >= 3) & x.isNotNull() & y.isNotNull() & inside, F.lit(False))


def _polygons(gate: Gate, out: Fitted, parent: str, at: int) -> dict[str, Column]:
    """Shapes of each sample, matched to the gate's children by least Hausdorff distance; a child without one keeps its own."""
    drawn = _drawn(gate, out.population(parent))
    kind = drawn.schema[SAMPLE].dataType.simpleString()
    old = {c.name: c.polygon for c in gate.children}
    ellipse = isinstance(gate.gate if isinstance(gate, _Warped) else gate, EllipseGate)
    if ellipse:
        conf = float(gate.params.get("conf", 0.95))
        shapes = drawn.groupBy(SAMPLE).agg(F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.var_samp("_x").alias("xx"), F.var_samp("_y").alias("yy"), F.covar_samp("_x", "_y").alias("xy"))

        def own(pdf: pd.DataFrame) -> list[list[geometry.Point]]:
            return [geometry.ellipse_polygon((m.x, m.y), *geometry.confidence_ellipse(m.xx, m.yy, m.xy, conf)) for m in pdf.itertuples() if m.xx and m.yy]
    else:
        if gate.method == "kmeans":
            named = drawn.withColumnsRenamed({"_x": "axis_x", "_y": "axis_y"})
            labelled = clustering.sample_clusters(named, ["axis_x", "axis_y"], int(gate.params.get("k", 2)), seed=int(gate.params.get("seed", 42))).withColumnsRenamed({"axis_x": "_x", "axis_y": "_y"})
        else:
            labelled = clustering.shaped_clusters(drawn, ["_x", "_y"], gate.method, by=SAMPLE, **gate.params).where("cluster_label >= 0")

        def corners(batches):
            """Each partition's hulls: their corners are all that a sample's task gets."""
            held: dict = {}
            for pdf in batches:
                for k, part in pdf.groupby([SAMPLE, "cluster_label"], dropna=False):
                    held[k] = G._corners(np.vstack([held.get(k, np.zeros((0, 2))), part[["_x", "_y"]].to_numpy(float)]))
            yield pd.DataFrame([(*k, float(a), float(b)) for k, ring in held.items() for a, b in ring], columns=[SAMPLE, "cluster_label", "_x", "_y"])

        shapes = labelled.select(SAMPLE, "cluster_label", "_x", "_y").mapInPandas(corners, f"{SAMPLE} {kind}, cluster_label int, _x double, _y double")

        def own(pdf: pd.DataFrame) -> list[list[geometry.Point]]:
            found = [geometry.convex_hull(part[["_x", "_y"]].to_numpy(float)) for _, part in pdf.groupby("cluster_label")]
            return [f for f in found if f]

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        new, given, used = own(pdf), dict(old), set()
        done: set[str] = set()
        for _, name, j in sorted(((geometry.hausdorff(ring, s), n, j) for (n, ring), (j, s) in itertools.product(old.items(), enumerate(new)))):
            if name not in done and j not in used:
                given[name] = new[j]
                done.add(name)
                used.add(j)
        rings = [[{"x": float(a), "y": float(b)} for a, b in given[n]] for n in old]
        return pd.DataFrame({SAMPLE: [pdf[SAMPLE].iloc[0]], "rings": [rings]})

    table = stored(shapes.groupBy(SAMPLE).applyInPandas(matched, f"{SAMPLE} {kind}, rings array<{POINTS}>").withColumnRenamed("rings", f"_r{at}"), "rings")
    out.join(table)
    x, y = gate.column("x"), gate.column("y")
    return {n: F.when(F.col(f"_r{at}").isNull(), geometry.in_polygon(x, y, old[n])).otherwise(in_ring(x, y, F.get(F.col(f"_r{at}"), F.lit(i)))) for i, n in enumerate(old)}
