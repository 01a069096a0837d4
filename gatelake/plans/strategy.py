"""Gating strategies: ordered gates applied to all samples at once as one plan, or fitted anew to a sample."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import density
from ..operators import gates as G
from ..operators import populations as P
from ..operators.gates import BooleanGate, Gate, ThresholdGate
from . import by_sample

#: A gate isn't applied to a parent of fewer events.
LEAST_EVENTS = 4


@dataclass
class Strategy:
    """Gates by name. A gate's children may be the parents of others; the plan follows that order whatever the list's.

    grids: for a gate's name the parameters to be tried (and `cost`); references: the reference sample (and peak options) its parent is registered to.
    """

    name: str
    gates: list[Gate] = field(default_factory=list)
    grids: dict[str, dict] = field(default_factory=dict)
    references: dict[str, dict] = field(default_factory=dict)

    def gate(self, name: str) -> Gate:
        for g in self.gates:
            if g.name == name:
                return g
        raise KeyError(f"no gate {name!r}")

    def add(self, gate: Gate) -> None:
        if any(g.name == gate.name for g in self.gates):
            raise ValueError(f"there is a gate {gate.name!r} already")
        self.gates.append(gate)

    def remove(self, name: str) -> None:
        self.gates.remove(self.gate(name))

    def add_grid(self, gate: str, grid: dict[str, list], cost: str = "manhattan") -> None:
        """Parameters to be searched when the gate is applied to new data; its children need signatures (or shapes, for 'hausdorff')."""
        g = self.gate(gate)
        if isinstance(g, BooleanGate) or g.method == "manual":
            raise ValueError(f"{gate}: there is nothing to search")
        if cost not in ("manhattan", "euclidean", "hausdorff") or (cost == "hausdorff" and isinstance(g, ThresholdGate)):
            raise ValueError(f"{gate}: no cost {cost!r}")
        self.grids[gate] = {"grid": grid, "cost": cost}

    def add_normalisation(self, gate: str, reference: str, **peaks) -> None:
        """Register the gate's parent to that of a reference sample before the gate is applied."""
        self.gate(gate)
        self.references[gate] = {"sample": reference, "peaks": peaks}

    def ordered(self) -> list[Gate]:
        known, left, out = {P.ROOT}, list(self.gates), []
        while left:
            ready = [g for g in left if {g.parent, *getattr(g, "populations", [])} <= known]
            if not ready:
                raise ValueError(f"no parent for {', '.join(g.name for g in left)}")
            for g in ready:
                left.remove(g)
                out.append(g)
                known |= {c.name for c in g.children}
        return out

    def definitions(self) -> dict[str, tuple[str, Column]]:
        """name -> (parent, predicate) of all children."""
        out: dict[str, tuple[str, Column]] = {}
        for g in self.ordered():
            _define(out, g)
        return out

    def tree(self) -> list[tuple[str, str | None]]:
        return P.tree_of(self.definitions())

    def fit(self, events: DataFrame) -> Strategy:
        """Fit gates without children in order, each on its parent's events. A parent with fewer than LEAST_EVENTS events is an error."""
        left, known = list(self.gates), {P.ROOT}
        done = Strategy(self.name)
        while left:
            ready = [g for g in left if {g.parent, *getattr(g, "populations", [])} <= known]
            if not ready:
                raise ValueError(f"no parent for {', '.join(g.name for g in left)}")
            for g in ready:
                left.remove(g)
                if not g.children:
                    g.fit(_enough(g, done.population(events, g.parent)))
                done.gates.append(g)
                known |= {c.name for c in g.children}
        return self

    def preview(self, gate: Gate, events: DataFrame) -> Gate:
        """A fitted copy of a gate whose parent this strategy knows; the strategy and the gate stay as they are."""
        trial = copy.deepcopy(gate)
        return trial.fit(self.population(events, gate.parent))

    def applied(self, events: DataFrame, *, reference: DataFrame | None = None, control: DataFrame | None = None, normalise: bool = False, search: bool = False, params: dict[str, dict] | None = None) -> Applied:
        """The strategy fitted anew to the events (of one sample, or of several taken as one): children keep their names.

        With `normalise`, gates that have a reference see their parent's axes registered to the same population of the reference events; with
        `search`, gates that have a grid take for each child the parameters closest to it; `params` replace a gate's own for this time.
        Control events serve threshold gates.
        """
        out = Applied(self.name)
        for g in self.ordered():
            trial = copy.deepcopy(g)
            trial.params |= (params or {}).get(g.name, {})
            if isinstance(trial, BooleanGate):
                _define(out.definitions, trial)
                out.gates.append(trial)
                continue
            parent = _enough(trial, _population(events, out.definitions, g.parent))
            if normalise and g.name in self.references and reference is not None:
                trial.warp = _landmarks(trial, parent, self.population(reference, g.parent), self.references[g.name]["peaks"])
            features = sorted({f for c in trial.children for f in c.signature})
            if search and g.name in self.grids:
                best = G.grid_search(trial, self.grids[g.name]["grid"], parent, features, self.grids[g.name]["cost"])
                for c in trial.children:
                    chosen = copy.deepcopy(trial)
                    chosen.params |= best.get(c.name, (trial.params, 0.0))[0]
                    chosen.fit_predict(parent)
                    out.definitions[c.name] = (g.parent, chosen.predicates()[c.name])
                out.chosen[g.name] = {k: v[0] for k, v in best.items()}
            else:
                if isinstance(trial, ThresholdGate) and control is not None:
                    trial.fit_predict(parent, _population(control, out.definitions, g.parent))
                elif trial.method != "manual":
                    trial.fit_predict(parent)
                _define(out.definitions, trial)
            out.gates.append(trial)
        return out

    def applied_to_samples(self, events: DataFrame, *, control: DataFrame | None = None, normalise: bool = False, search: bool = False, params: dict[str, dict] | None = None) -> DataFrame:
        """Members of all populations, each sample with gates fitted to itself. References are samples among the events; control events name their sample.

        All samples are one plan (see `by_sample`), unless a gate searches a grid, fits an embedding or mixture, or samples by density: then it is
        one plan a sample.
        """
        refs = {r["sample"] for r in self.references.values()}
        reference = events.where(F.col("sample_id").isin(sorted(refs))) if refs else None
        if by_sample.covers(self, search):
            return by_sample.fitted(self, events, reference=reference, control=control, normalise=normalise, params=params).membership()
        samples = sorted(r.sample_id for r in events.select("sample_id").distinct().collect())  # a row a sample
        out = None
        for s in samples:
            own = events.where(F.col("sample_id") == s)
            beside = control.where(F.col("sample_id") == s) if control is not None else None
            part = self.applied(own, reference=reference, control=beside, normalise=normalise, search=search, params=params).membership(own)
            out = part if out is None else out.unionByName(part)
        return out

    def population(self, events: DataFrame, name: str) -> DataFrame:
        """Events of a population: the conjunction of the predicates along its path, which scans can use."""
        return _population(events, self.definitions(), name)

    def membership(self, events: DataFrame) -> DataFrame:
        return P.gated(events, self.definitions())

    def statistics(self, events: DataFrame) -> DataFrame:
        """Counts and shares of every population in every sample, in one scan for the members and one for the totals."""
        return _statistics(events, self.definitions())

    def gate_stats(self, events: DataFrame, name: str) -> DataFrame:
        """Parent count, child count and percent for one gate."""
        g = self.gate(name)
        return self.statistics(events).where(F.col("population").isin([c.name for c in g.children])).select("sample_id", "population", "n", (100 * F.col("frac_of_parent")).alias("percent_of_parent"))

    def backgate(self, events: DataFrame, parent: str, overlay: str) -> DataFrame:
        """Events of `parent` with `layer`: whether they are in `overlay`, which must be below it."""
        if overlay not in self.downstream(parent):
            raise ValueError(f"{overlay} isn't below {parent}")
        definitions, inside, at = self.definitions(), F.lit(True), overlay
        while at != parent:
            at, predicate = definitions[at]
            inside = inside & predicate
        return self.population(events, parent).withColumn("layer", F.when(inside, overlay).otherwise(parent))

    def downstream(self, population: str) -> list[str]:
        parents = dict(self.tree())
        rank = P.preorder(self.tree())
        return [n for n in rank if P._is_below(n, population, parents)]

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "gates": [json.loads(g.to_json()) for g in self.gates], "grids": self.grids, "references": self.references})

    @classmethod
    def from_json(cls, text: str) -> Strategy:
        said = json.loads(text)
        return cls(said["name"], [Gate.from_json(json.dumps(g)) for g in said["gates"]], said["grids"], said["references"])


@dataclass
class Applied:
    """A strategy as it was fitted to one set of events: the gates, the populations' definitions, and the grid's choices."""

    name: str
    gates: list[Gate] = field(default_factory=list)
    definitions: dict[str, tuple[str, Column]] = field(default_factory=dict)
    chosen: dict[str, dict[str, dict]] = field(default_factory=dict)

    def membership(self, events: DataFrame) -> DataFrame:
        return P.gated(events, self.definitions)

    def statistics(self, events: DataFrame) -> DataFrame:
        return _statistics(events, self.definitions)

    def population(self, events: DataFrame, name: str) -> DataFrame:
        return _population(events, self.definitions, name)


def _define(definitions: dict[str, tuple[str, Column]], gate: Gate) -> None:
    """Add a gate's children."""
    own = gate.combined({n: _whole(definitions, n) for n in gate.populations}) if isinstance(gate, BooleanGate) else gate.predicates()
    if again := sorted(set(own) & {*definitions, P.ROOT}):
        raise ValueError(f"{gate.name}: there is a population {', '.join(again)} already")
    for n, p in own.items():
        definitions[n] = (gate.parent, p)


def _whole(definitions: dict[str, tuple[str, Column]], name: str) -> Column:
    out = F.lit(True)
    while name != P.ROOT:
        name, predicate = definitions[name]
        out = out & predicate
    return out


def _population(events: DataFrame, definitions: dict[str, tuple[str, Column]], name: str) -> DataFrame:
    while name != P.ROOT:
        name, predicate = definitions[name]
        events = events.where(predicate)
    return events


def _statistics(events: DataFrame, definitions: dict[str, tuple[str, Column]]) -> DataFrame:
    tree = events.sparkSession.createDataFrame(P.tree_of(definitions), "population string, parent string")
    return P.stats(P.gated(events, definitions), tree, events.groupBy("sample_id").agg(F.count("*").alias("n")))


def _enough(gate: Gate, parent: DataFrame) -> DataFrame:
    if len(parent.limit(LEAST_EVENTS).collect()) < LEAST_EVENTS:
        raise ValueError(f"{gate.name}: {gate.parent} has too few events")
    return parent


def _landmarks(gate: Gate, parent: DataFrame, reference: DataFrame, peaks: dict) -> dict:
    """Knots that move the parent's peaks onto the reference's, by axis, in gate scale."""
    own, target = gate.scaled(parent), gate.scaled(reference)
    return {a: density.warp_knots(density.kde(target, f"_{a}"), density.kde(own, f"_{a}"), **peaks) for a in ("x", "y") if a == "x" or gate.y}
