"""The object layer: projects and stored populations, strategies, controls, classifiers, and what has no SQL."""

import math
import random

import numpy as np
import pytest
from gatelake.functions import density, distributions, quantiles, transforms
from gatelake.operators import batch, classify, clustering, controls, features, gates, names, sampling, tables
from gatelake.operators import populations as P
from gatelake.plans.strategy import Strategy
from pyspark.sql import functions as F


def frame(spark, rows, columns):
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int | float | np.floating) and not isinstance(v, bool) else v for v in r) for r in rows], columns)


def events(spark, xs, sample="s", columns="xyz"):
    rows = [(sample, i, *map(float, r)) for i, r in enumerate(xs)]
    return spark.createDataFrame(rows, "sample_id string, event_id long, " + ", ".join(f"{c} double" for c in columns[: len(xs[0])]))


# --- quantiles and ranks

@pytest.mark.parametrize("rows", [5, 50, 1_000_000])
def test_quantiles_equal_numpy(spark, rows):
    """By the aggregate and by closing in: ties, one heavy value, nulls, NaN, an empty column, and infinite spread."""
    rng = np.random.default_rng(rows)
    a = np.concatenate([np.full(300, 7.0), rng.normal(0, 1, 200), [1e12, -1e12]])
    b = rng.integers(0, 4, len(a)).astype(float)
    data = [("g" if i % 3 else None, float(x), float(y), None if i % 2 else float("nan")) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(data, "g string, a double, b double, c double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.731, 1.0]
    one = quantiles.quantiles(df, ["a", "b", "c"], probs, rows=rows).head()
    assert one.a == pytest.approx(np.quantile(a, probs)) and one.b == pytest.approx(np.quantile(b, probs)) and one.c is None
    for r in quantiles.quantiles(df, ["a", "b"], probs, ["g"], rows=rows).collect():
        own = [i for i, x in enumerate(data) if x[0] == r.g]
        assert r.a == pytest.approx(np.quantile(a[own], probs)) and r.b == pytest.approx(np.quantile(b[own], probs))
    assert quantiles.quantiles(df.limit(0), ["a"], [0.5], rows=rows).head().a is None


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_running_sums(spark, rows):
    rng = random.Random(rows)
    data = [(g, v, rng.randint(1, 9)) for g in "ab" for v in rng.sample(range(100), 40)]
    df = spark.createDataFrame(data, "g string, v int, k int")
    got = {(r.g, r.v): r.below for r in quantiles.running(df, "v", "k", "below", ["g"], rows=rows).collect()}
    assert got == {(g, v): sum(k for h, w, k in data if h == g and w < v) for g, v, _ in data}
    whole = spark.createDataFrame([(v, 1) for v in range(30)], "v int, k int")
    assert all(r.v == r.below for r in quantiles.running(whole, "v", "k", "below", rows=rows).collect())


def test_first_by_hash_equals_a_window(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(3000)] + [(9999, None)], "event_id long, g string")
    r = F.row_number().over(Window.partitionBy("g").orderBy(sampling.key("event_id", 3), "event_id"))
    want = {x.event_id for x in df.withColumn("r", r).where("r <= 450").collect()}
    assert {x.event_id for x in sampling.uniform(df, 450, by=["g"], seed=3).collect()} == want
    assert sampling.oversample(df, "g").groupBy("g").count().orderBy("g").collect() == [("a", 2400), ("b", 2400)]


@pytest.mark.parametrize(("method", "params"), [("quantile", {"n_quantiles": 9}), ("yeo_johnson", {}), ("box_cox", {})])
def test_scalers_with_an_inverse(spark, method, params):
    df = spark.createDataFrame([(float(v),) for v in np.exp(np.random.default_rng(1).normal(0, 1, 9))], "a double")
    s = transforms.Scaler(method, params).fit(df, ["a"])
    assert [r.a for r in s.inverse(s.transform(df)).collect()] == pytest.approx([r.a for r in df.collect()], rel=1e-6)
    assert s.set_params(n_quantiles=3).stats == {}


# --- gates and strategies

def test_gate_parts(spark):
    g = gates.ThresholdGate("g", "root", "x", "y", "asinh", None, transform_params={"x": {"m": 4.0}})
    assert g.transform_info() == ({"x": "asinh", "y": None}, {"x": {"m": 4.0}, "y": {}})
    with pytest.raises(ValueError, match="definition"):
        g.add_child(gates.Child("bad", "+"))
    g.add_child(gates.Child("a", "++,+-"))
    with pytest.raises(ValueError, match="already"):
        g.add_child(gates.Child("a", "--"))
    g.params = {"x": 50.0, "y": 3.0}
    df = events(spark, [(10, 1), (90, 2), (60, 9)])
    assert [r.population for r in g.fit_predict(df).orderBy("event_id").collect()] == ["a", "a"]
    assert g.to_linear(spark) == pytest.approx((50.0, 3.0))
    p = gates.PolygonGate("p", "root", "x", "y")
    with pytest.raises(ValueError, match="three"):
        p.add_child(gates.Child("c", polygon=[(0, 0), (1, 1)]))
    merged = gates.merge_children([gates.Child("a", polygon=[(0, 0), (2, 0), (2, 2), (0, 2)], signature={"x": 1.0}), gates.Child("b", polygon=[(1, 0), (3, 0), (3, 2), (1, 2)], signature={"x": 3.0, "y": 5.0})], "m")
    assert {tuple(v) for v in merged.polygon} == {(0, 0), (3, 0), (3, 2), (0, 2)} and merged.signature == {"x": 2.0, "y": 5.0}
    with pytest.raises(ValueError, match="differ"):
        gates.mergeable(g, p)


def test_gates_on_an_embedding_and_samples(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (300, 3)) for c in ((0, 0, 0), (6, 6, 6))])
    df = events(spark, x)
    g = gates.ThresholdGate("g", "root", "PCA1", method="quantile", params={"q": 0.5}, embedding={"features": ["x", "y", "z"]}).fit(df)
    again = gates.Gate.from_json(g.to_json())
    sides = {r.event_id: r.population for r in again.predict(df).collect()}
    assert len({sides[i] for i in range(300)}) == len({sides[i] for i in range(300, 600)}) == 1 and sides[0] != sides[599]
    for how in ({"method": "uniform", "size": 200}, {"method": "density", "size": 200, "tree_fraction": 0.5}, {"method": "faithful", "h": 0.2}):
        k = gates.PolygonGate("k", "root", "x", "y", method="kmeans", params={"k": 2}, sampling=how).fit(df)
        up = {r.event_id: r.population for r in k.upsampled(df).collect()}
        assert len(up) == 600 and len({up[i] for i in range(300)} - {""}) == 1 and up[1] != up[400]


def test_polygon_shapes_are_of_all_events(spark):
    """Hulls hold every event of their cluster, and a refit gives shapes and matches of one fit."""
    rng = np.random.default_rng(3)
    df = events(spark, np.concatenate([rng.normal(c, 0.5, (400, 2)) for c in ((0, 0), (9, 9))])).repartition(6)
    g = gates.PolygonGate("g", "root", "x", "y", method="kmeans", params={"k": 2}).fit(df)
    inside = g.predict(df).count()
    assert inside == 800 - sum(len(c.polygon) for c in g.children)  # corners are on the edge
    calls = []
    own = type(g).shapes
    try:
        type(g).shapes = lambda self, d: (calls.append(1), own(self, d))[1]
        g.fit_predict(df)
    finally:
        type(g).shapes = own
    assert calls == [1]


def test_boolean_gate_on_stored_members(spark):
    df = events(spark, [(i, i % 5) for i in range(40)])
    members = P.gated(df, {"a": ("root", F.col("x") >= 10), "b": ("root", F.col("y") >= 2)})
    for how, want in (("or", lambda a, b: a or b), ("and", lambda a, b: a and b), ("not", lambda a, b: a and not b)):
        g = gates.BooleanGate("g", "root", "x", "y", method=how, populations=["a", "b"]).fit()
        g.label({"A": "c"})
        got = g.fit_predict(df, members)
        assert sorted(r.event_id for r in got.collect()) == [i for i in range(40) if want(i >= 10, i % 5 >= 2)] and g.children[0].polygon
    with pytest.raises(ValueError, match="two populations"):
        gates.BooleanGate("g", "root", "x", method="or", populations=["a"]).fit()


def test_strategy_applied_anew(spark):
    rng = np.random.default_rng(4)
    learned = events(spark, np.column_stack([np.concatenate([rng.normal(0, 1, 400), rng.normal(8, 1, 400)]), rng.normal(0, 1, 800)]), "a")
    shifted = events(spark, np.column_stack([np.concatenate([rng.normal(3, 1, 400), rng.normal(11, 1, 400)]), rng.normal(0, 1, 800)]), "b")
    g = gates.ThresholdGate("cut", "root", "x", params={"x": 4.0}).fit(learned)
    g.label({"+": "hi", "-": "lo"})
    s = Strategy("s", [g, gates.ThresholdGate("next", "hi", "y", method="quantile", params={"q": 0.5})]).fit(learned)
    s.gate("next").label({"+": "up", "-": "down"})
    s.add_normalisation("cut", "a")
    plain = {r.population: r.n for r in s.applied(shifted).statistics(shifted).collect()}
    fixed = s.applied(shifted, reference=learned, normalise=True)
    moved = {r.population: r.n for r in fixed.statistics(shifted).collect()}
    assert plain["hi"] > 450 and abs(moved["hi"] - 400) <= 8 and abs(moved["up"] - moved["hi"] / 2) <= 1
    assert s.gate("cut").warp == {} and s.gate("cut").thresholds == (4.0, None)
    both = s.applied_to_samples(learned.unionByName(shifted), normalise=True).groupBy("sample_id", "population").count()
    assert {r["count"] for r in both.where("sample_id = 'b' AND population = 'hi'").collect()} == {moved["hi"]}
    assert s.applied(shifted, params={"next": {"q": 0.9}}).population(shifted, "up").count() < 100
    with pytest.raises(ValueError, match="nothing to search"):
        s.add_grid("cut", {"x": [1]})
    with pytest.raises(ValueError, match="cost"):
        s.add_grid("next", {"q": [0.1]}, "hausdorff")
    with pytest.raises(ValueError, match="too few"):
        s.applied(shifted.limit(3))
    again = gates.ThresholdGate("again", "root", "x", params={"x": 0.0}, thresholds=(0.0, None), children=[gates.Child("hi", "+")])
    with pytest.raises(ValueError, match="already"):
        Strategy("t", [g, again]).definitions()
    trial = s.preview(gates.ThresholdGate("t", "hi", "y", params={"x": 0.0}), learned)
    assert trial.children and len(s.gates) == 2
    with pytest.raises(ValueError, match="isn't below"):
        s.backgate(learned, "lo", "hi")


def test_names_with_quotes_in_a_tree(spark):
    tree = spark.createDataFrame([("root", None), ("a'b", "root"), ("c", "a'b")], "population string, parent string")
    assert [(r.population, r.depth) for r in P.descendants(tree, "a'b").collect()] == [("c", 1)]
    assert {r.population for r in P.without(tree, ["a'b"]).collect()} == {"root"} and not [t for t in spark.catalog.listTables() if t.name.startswith("_tree")]


def test_control_thresholds(spark):
    rng = np.random.default_rng(5)
    df = events(spark, rng.normal(0, 1, (500, 1)))
    control = events(spark, rng.normal(2, 1, (500, 1)))
    g = gates.ThresholdGate("g", "root", "x", method="quantile", params={"q": 0.9})
    assert g.find(df, control)[0] == pytest.approx(g.find(control)[0]) and g.find(control, df) == g.find(control)
    d = gates.ThresholdGate("d", "root", "x", method="density")
    assert d.find(df, control)[0] == pytest.approx(d.find(control)[0])  # one peak: the control decides


def test_control_population(spark):
    rng = np.random.default_rng(6)
    make = lambda n: np.column_stack([np.concatenate([rng.normal(2, 0.5, n), rng.normal(9, 0.5, n)]), rng.normal(0, 1, 2 * n), np.arange(2 * n)])
    primary = events(spark, make(200)).withColumnRenamed("z", "Time")
    control = events(spark, make(150), "c").withColumnRenamed("z", "Time")
    assert controls.shared_features(primary, control) == ["x", "y"]
    members = primary.where("x > 5").select("event_id")
    found = controls.control_population(primary, control, members, transform=None)
    assert sorted(r.event_id for r in found.collect()) == list(range(150, 300)) and found.columns == control.columns
    scores = controls.evaluate(primary, members, ["x", "y"], kind="decision_tree", folds=2, permutations=2)
    assert scores["score"] > 0.95 > scores["permuted"] and scores["p"] == pytest.approx(1 / 3)


# --- projects

@pytest.fixture
def project(spark, tmp_path):
    from gatelake.sources.project import Project

    return Project(spark, f"file://{tmp_path}/p")


PANEL = {"channels": {"FL1": {"regex": "fl-?1"}, "FL2": {"regex": "fl-?2"}}, "markers": {"CD4": {"regex": "cd4"}}, "mappings": [["FL1", "CD4"], ["FL2", ""]]}


def test_ingest(spark, tmp_path, project):
    from gatelake.sources import fcs

    e = project.add_experiment("e", PANEL)
    data = np.arange(60, dtype=np.float32).reshape(20, 3)[:, :2]
    fcs.write(str(tmp_path / "a.fcs"), data, [("fl-1", "cd4"), ("FL2", "")], {"SPILL": "2,fl-1,FL2,1,0.5,0,1"})
    s = e.add_fcs("a", str(tmp_path / "a.fcs"), controls={"FMO": str(tmp_path / "a.fcs")}, notes="n")
    rows = s.data().orderBy("event_id").collect()
    assert rows[1].FL1 == 3.0 and rows[1].FL2 == pytest.approx(4 - 0.5 * 3) and "CD4" in s.data(prefer="markers").columns
    assert s.data("FMO").count() == 20 and s.data(size=5).count() == 5 and s.record().compensated
    s.add_control("other", s.data().limit(3).drop("sample_id"))
    assert s.record().controls == ["FMO", "other"] and s.data("other").count() == 3
    with pytest.raises(ValueError, match="already"):
        s.add_control("other", s.data())
    with pytest.raises(KeyError):
        s.data("none")
    with pytest.raises(KeyError):
        e.sample("nobody")
    df = spark.createDataFrame([(1.0,)], "fl1 double")
    with pytest.raises(ValueError, match="missing channels: FL2"):
        e.add_dataframes("b", df, [("fl1", "cd4")])
    assert e.add_dataframes("b", df, [("fl1", "cd4")], missing="warn").data().columns == ["FL1", "event_id", "sample_id"]
    with pytest.raises(ValueError, match="not a pair"):
        e.add_dataframes("c", df, [("fl2", "cd4")], missing="warn")


def test_panels(spark):
    n = spark.createDataFrame([("FL1", "fl-?1", None, "false", "channel"), ("CD4", "cd4", "T4, t4", "true", "marker")], "name string, regex string, permutations string, case string, kind string")
    m = spark.createDataFrame([("FL1", "CD4")], "channel string, marker string")
    p = names.Panel.from_tables(n, m)
    assert p.check() == [] and p.markers[0].case_sensitive and names.Panel.from_dict(p.to_dict()) == p
    with pytest.raises(ValueError, match="marker"):
        names.Panel.from_tables(n, m.drop("marker"))
    assert names.channel_map(None, "x") == {"channel": "", "marker": "x"}


def test_stored_populations(spark, project):
    e = project.add_experiment("e", PANEL)
    s = project.add_sample("e", "a/1", events(spark, [(i, i % 4) for i in range(40)]).drop("sample_id"), subject_id="p")
    project.add_subject("p", age=30)
    cut = gates.ThresholdGate("cut", "root", "x", params={"x": 10.0}, thresholds=(10.0, None), children=[gates.Child("+", "+"), gates.Child("-", "-")])
    s.save({**Strategy("s", [cut]).definitions(), "odd %/=": ("+", F.col("y") % 2 == 1)})
    assert s.list_populations() == ["root", "+", "-", "odd %/="] and s.downstream("root") == ["+", "odd %/=", "-"] and s.children("+") == ["odd %/="]
    assert s.members("odd %/=").count() == 15 and s.members("nothing") is None and s.population("odd %/=").frac_of_parent == pytest.approx(0.5)
    assert s.population_stats("odd %/=") == {"population": "odd %/=", "n": 15, "frac_of_parent": 0.5, "frac_of_root": 0.375} and s.population_stats("none")["n"] == 0
    s.add_population("low", "-", s.data().where("x < 4").select("event_id"), "cluster", {"x": 1.0})
    s.add_population("mid", "-", s.data().where("x BETWEEN 3 AND 6").select("event_id"), "cluster", {"x": 5.0, "y": 2.0})
    with pytest.raises(ValueError, match="already"):
        s.add_population("low", "-", s.members("low"))
    with pytest.raises(ValueError, match="hasn't"):
        s.add_population("wrong", "-", s.members("+"))
    s.merge(["low", "mid"], "both")
    assert s.members("both").count() == 7 and s.population("both").signature == {"x": 3.0, "y": 2.0}
    s.subtract("-", ["both"], "rest")
    assert sorted(r.event_id for r in s.members("rest").collect()) == [7, 8, 9]
    s.update_population("low", s.data().where("x < 2").select("event_id"))
    assert s.population("low").n == 2 and s.print_tree().startswith("root\n    +\n        odd")
    labels = {r.event_id: r.population_label for r in s.load_population("root", transform=None, label=True).collect()}
    assert labels[20] == "+" and labels[21] == "odd %/=" and labels[8] == "rest"
    assert s.load_population("low", features=["x"]).count() == 2
    assert e.population("low", fields=["age"]).select("subject_id", "age").distinct().collect() == [("p", "30")]
    assert {r.population: r.n for r in e.statistics().collect()}["both"] == 7
    assert e.merge_populations({"m": ["low", "mid"], "none": ["low", "absent"]}) == {"m": [], "none": ["a/1"]}
    assert s.delete_populations(["-"]) == ["-", "both", "low", "m", "mid"] and s.members("both") is None
    with pytest.raises(ValueError, match="root"):
        s.delete_populations(["root"])
    pool = e.reference_sample("ref", size=5)
    assert pool.data().count() == 5 and e.list_samples() == ["a/1", "ref"]
    assert e.save_corrected(e.project.events("e").where("sample_id = 'a/1'").select("sample_id", "event_id", "x")) == ["Corrected_a/1"]
    strategy = Strategy("s", [cut])
    e.save_strategy(strategy)
    e.save_strategy(strategy)
    assert e.strategy("s").to_json() == strategy.to_json() and project.table("strategies").count() == 1
    assert s.delete_populations(["rest"]) == ["rest"]
    e.delete_strategy("s")
    assert s.list_populations() == ["root"] and project.table("strategies").count() == 0
    e.delete_all_populations()
    s.delete()
    assert "a/1" not in e.list_samples()


def test_strategies_on_stored_samples(spark, project):
    rng = np.random.default_rng(13)
    e = project.add_experiment("e", PANEL)
    blobs = lambda n: events(spark, np.column_stack([np.concatenate([rng.normal(2, 0.5, n), rng.normal(9, 0.5, n)]), rng.normal(0, 1, 2 * n)])).drop("sample_id")
    for s in ("01", "2"):
        e.project.add_sample("e", s, blobs(60), controls={"FMO": blobs(40)})
    project.add_sample("e", "tiny", blobs(1))
    g = gates.ThresholdGate("cut", "root", "x", method="quantile", params={"q": 0.5}, thresholds=(5.0, None), children=[gates.Child("hi", "+"), gates.Child("lo", "-")])
    strategy = Strategy("s", [g])
    assert list(e.apply(strategy)) == ["tiny"]
    assert {(r.sample_id, r.n) for r in e.statistics().where("population = 'hi'").collect()} == {("01", 60), ("2", 60), ("tiny", 0)}
    assert "already" in e.apply(strategy, ["2"])["2"]
    found = e.control_population("hi", "FMO", features=["x", "y"], transform=None)
    assert {r.sample_id: r["count"] for r in found.groupBy("sample_id").count().collect()} == {"01": 40, "2": 40}
    df = e.sample("2").data()
    plots = tables.strategy_plots(strategy, df, 16)
    assert list(plots) == ["cut"] and plots["cut"][1].count() == 2
    assert tables.population_histogram(df, "x", "y", scale_x="asinh", scale_y=None, bins=8).agg(F.sum("n")).head()[0] >= 110
    assert tables.cluster_scatter(df.withColumn("cluster_label", F.lit(1)), ["x", "y"], size=9).count() == 9


def test_writers_lose_nothing(spark, project):
    """A change made to an older state is made again to the new one; what both may not do is an error."""
    change, once = project._change, []

    def raced(table, f):
        def slow(rows):
            if not once:
                once.append(1)
                change("subjects", lambda t: t.unionByName(spark.createDataFrame([("b", "{}")], t.schema)))  # another writer is first
            return f(rows)

        change(table, slow)

    project._change = raced
    project.add_subject("a")
    assert project.list_subjects() == ["a", "b"] and len(project._versions("subjects")) == 2
    with pytest.raises(ValueError, match="exists"):
        project.add_subject("b")
    project._change = change
    for i in range(14):
        project.add_subject(f"s{i}")
    assert len(project.list_subjects()) == 16 and len(project._versions("subjects")) <= 10
    assert not project._published("subjects", project._versions("subjects")[-1], "tables/other")
    assert len(project.list_subjects()) == 16


def test_a_change_that_is_cut_short_leaves_the_old_state(spark, project):
    e = project.add_experiment("e", {"channels": {"x": {"regex": "^x$"}}, "mappings": [["x", ""]]})
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "event_id long, x double")
    s = project.add_sample("e", "s", df)
    s.add_population("p", "root", df.where("x >= 5"))

    def members():
        return sorted(r.event_id for r in e.project.membership("e").where("population = 'p'").collect())

    class Cut(Exception):
        pass

    def cut(*_):
        raise Cut

    for step in ("_change", "_published"):
        setattr(project, step, cut)
        for f in (lambda: s.update_population("p", df.where("x >= 15")), lambda: s.delete_populations(["p"]), lambda: s.add_population("q", "p", df.where("x >= 15")), lambda: project.add_sample("e", "t", df)):
            with pytest.raises(Cut):
                f()
            assert members() == list(range(5, 20)) == sorted(r.event_id for r in s.members("p").collect())
            assert s.list_populations() == ["root", "p"] and e.list_samples() == ["s"]
        delattr(project, step)
    s.update_population("p", df.where("x >= 15"))
    assert members() == list(range(15, 20)) and s.population("p").n == 5
    with pytest.raises(ValueError, match="hasn't"):
        s.add_population("q", "p", df.where("x >= 14"))
    stale = s.population("p").members
    s.update_population("p", df.where("x >= 16"))
    with pytest.raises(ValueError, match="another writer"):
        s._store("p", "root", df, "gate", None, stale)
    assert members() == list(range(16, 20))
    project.add_sample("e", "t", df)
    assert e.list_samples() == ["s", "t"] and e.sample("t").data().count() == 20


# --- clusters, batches, features

def test_silhouette_and_graph_meta(spark):
    rng = np.random.default_rng(7)
    rows = [(s, f"{s}{k}", *map(float, rng.normal(c, 0.3, 2))) for s in "abcd" for k, c in enumerate([(0, 0), (9, 9), (0, 9)]) for _ in range(12)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, sample_id string, cluster_label string, x double, y double").withColumn("cluster_label", F.substring("cluster_label", 2, 1).cast("int"))
    meta = clustering.graph_meta_clusters(df.withColumn("meta_label", F.lit(None).cast("int")), ["x", "y"], k=3)
    assert meta.select("cluster_label", "meta_label").distinct().count() == 3
    empty = clustering.reset(meta)
    assert empty.where("cluster_label IS NOT NULL OR meta_label IS NOT NULL").isEmpty() and empty.schema["cluster_label"].dataType == meta.schema["cluster_label"].dataType
    assert clustering.silhouette(df, ["x", "y"]) > 0.9
    assert clustering.without_null_features(df.withColumn("n", F.when(F.col("x") > 1, F.col("x"))), ["x", "n", "y"]) == ["x", "y"]
    own = clustering.per_sample(df.drop("cluster_label"), lambda part: clustering.graph_clusters(part, ["x", "y"], k=5))
    assert own.groupBy("sample_id").agg(F.count_distinct("cluster_label").alias("k")).where("k < 3").isEmpty()
    x = np.array([[0.0], [1.0], [2.2], [9.0]])
    assert clustering.agglomerate(x, 2, linkage="single").tolist() == clustering.agglomerate(x, 2, linkage="complete").tolist() == [0, 0, 0, 1]
    fitted = clustering.Consensus(2, 5, resamples=5, share=0.8).fit(np.concatenate([rng.normal(c, 0.1, (15, 1)) for c in (0, 5, 10)]))
    assert len(set(fitted.predict_data(np.array([[0.0], [0.1], [5.0], [10.0], [10.1]])).tolist())) == min(fitted.k, 5)


def test_som_sees_all_events(spark):
    rng = np.random.default_rng(8)
    df = events(spark, np.concatenate([rng.normal(c, 0.3, (200, 2)) for c in ((0, 0), (9, 9), (0, 9))]))
    som = clustering.SOM(["x", "y"], (4, 4), rounds=8).fit(df).meta_cluster(3)
    got = {r.event_id: r.cluster_label for r in som.predict(df).collect()}
    assert [len({got[i] for i in range(a, a + 200)}) for a in (0, 200, 400)] == [1, 1, 1] and len(set(got.values())) == 3


def test_densities_and_landmarks(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, 2000), rng.normal(6, 1, 2000)])
    df = events(spark, x[:, None])
    h = density.cross_validated(df, "x", float(x.min()), float(x.max()), float(x.std()))
    assert 0.05 < h < 1.5
    d = density.kde(df, "x", bandwidth="cross_validated")
    assert len(density.find_peaks(d.p, 0.2)) == 2
    centres, marks = density.cluster_landmarks({"a": [0.0, 6.0], "b": [0.5, 6.4, 20.0]}, 3)
    alone = density.pure_groups(marks)
    assert len(alone) == 1 and density.nearest_landmarks(marks, centres)[next(g for s, p, g in marks if p == 0.0)] == {"a": 0.0, "b": 0.5}
    other = density.kde(events(spark, (x + 1.5)[:, None]), "x")
    xs, ys = density.warp_knots(d, other)
    assert np.interp(7.5, xs, ys) == pytest.approx(6, abs=0.4)


def test_densities_of_groups_equal_those_one_by_one(spark):
    rng = np.random.default_rng(14)
    df = events(spark, rng.normal(0, 1, (300, 1)), "a").unionByName(events(spark, rng.normal(2, 2, (100, 1)), "b"))
    both = density.kde_by(df, "x", "sample_id", -4.0, 8.0, grid=64)
    for s, d in both.items():
        one = density.kde(df.where(F.col("sample_id") == s), "x", grid=64, lo=-4.0, hi=8.0)
        assert np.allclose(d.p, one.p) and np.allclose(d.x, one.x) and d.n == one.n


def test_batch_tables(spark):
    rng = np.random.default_rng(10)
    df = events(spark, rng.normal(0, 1, (200, 2)), "a").unionByName(events(spark, rng.normal(1, 1, (200, 2)), "b").withColumn("event_id", F.col("event_id") + 1000))
    m = batch.marker_variance(df, "a", ["x"], grid=64).toPandas()
    mean = lambda s: np.average(m[m.sample_id == s].x, weights=m[m.sample_id == s].density)
    assert mean("b") - mean("a") > 0.5
    seen = batch.dim_reduction_grid(df, "a", ["x", "y"])
    assert abs(seen.where("is_reference").agg(F.avg("PCA1")).head()[0]) < 1e-9
    both = batch.lisi_distribution(df, df, ["x", "y"]).groupBy("data").count().collect()
    assert sorted(map(tuple, both)) == [("After", 400), ("Before", 400)]
    assert batch.summed_density(df, ["x", "y"], 32).groupBy("sample_id").count().count() == 2


@pytest.mark.parametrize(("x", "w", "p"), [([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.79, 0.0067), ([1.0, 2.0, 3.0], 1.0, 1.0), ([1.0, 2.0, 3.0, 10.0], 0.8071, 0.115)])
def test_shapiro(spark, x, w, p):
    """The published example of the test, and very small samples with the published weights."""
    got = features.shapiro(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
    assert got["W"] == pytest.approx(w, abs=0.012) and got["p"] == pytest.approx(p, abs=0.02)


def test_normality(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.normal(0, 1, 400), rng.exponential(1, 400), strict=True)], "a double, b double")
    for how in ("shapiro", "jarque_bera"):
        assert [r["normal"] for r in features.normality(df, ["a", "b"], how)] == [True, False]
    with pytest.raises(ValueError, match="3 to"):
        features.shapiro(df.limit(2), "a")
    assert distributions.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_plot_tables(spark):
    df = events(spark, [(i, i * i, i % 3) for i in range(200)])
    assert tables.plot(df, "x", "y", 8).agg(F.sum("n")).head()[0] >= 198 and tables.plot(df, "x").columns == ["x", "density"]
    g = gates.ThresholdGate("g", "root", "x", params={"x": 5.0}).fit(df)
    histogram, shapes = tables.gate_plot(g, df)
    assert histogram.columns == ["x", "density"] and [(r.child, r.x) for r in shapes.orderBy("child").collect()] == [("+", 5.0), ("-", 5.0)]
    _, outline = tables.population_plot(df, {"hi": df.where("x > 100")}, "x", "y")
    assert outline.where("population = 'hi'").count() == 99
    some = tables.scatter(df, "x", "y", "z", size=20, scale="minmax")
    assert some.count() == 20 and some.agg(F.max("label")).head()[0] <= 1
    assert tables.overlay_densities({"a": df, "b": df.where("x > 50")}, "x", 16).groupBy("layer").count().collect()[0][1] == 16


# --- classifiers

def test_classifier_is_kept_whole(spark, tmp_path):
    rng = np.random.default_rng(12)
    df = events(spark, rng.normal(5, 3, (300, 2))).withColumn("label", (F.col("x") > F.col("y")).cast("int"))
    c = classify.CellClassifier(["x", "y"])
    with pytest.raises(ValueError, match="isn't fitted"):
        c.predict(df)
    c.fit(df).save(f"file://{tmp_path}/c")
    again = classify.CellClassifier.load(f"file://{tmp_path}/c")
    pick = lambda m: [(r.event_id, r.predicted, round(r.score, 9)) for r in m.predict(df).orderBy("event_id").collect()]
    assert pick(again) == pick(c) and again.scaler.stats == c.scaler.stats
    assert {r["data"] for r in c.performance(df, df)} == {"train", "test"}
    assert not hasattr(c.set_params(regParam=0.1), "model") and c.downsample(df, "uniform", 10).count() == 10


def test_classifier_against_a_gated_sample(spark):
    df = events(spark, [(i, i % 7) for i in range(100)])
    definitions = {"a": ("root", F.col("x") >= 50), "b": ("a", F.col("x") >= 80)}
    members, tree = P.gated(df, definitions), P.tree_of(definitions)
    c = classify.CellClassifier(["x"], kind="decision_tree", scale=None)
    rows = c.training_data(df, members, tree, ["a", "b"])
    assert {r.label: r["count"] for r in rows.groupBy("label").count().collect()} == {0: 50, 1: 30, 2: 20}
    scores, done = c.fit(rows).validate(df, members, tree, ["a", "b"])
    assert scores["balanced_accuracy"] > 0.95 and done.count() == 100 and "x <=" in c.rules()
    assert [d for d, _ in c.prune(rows, rows, [1, 3], "accuracy")] == [1, 3]
    with pytest.raises(ValueError, match="no population"):
        c.training_data(df, members, tree, ["c"])
    with pytest.raises(ValueError, match="not below"):
        c.training_data(df, members, tree, ["a"], "b")


def test_residuals(spark):
    df = events(spark, [(i, 2 * i + 1) for i in range(100)])
    got = classify.residuals(df, ["x"], "y", 1e-6)
    assert 30 < got.count() < 70 and got.agg(F.max(F.abs("residual"))).head()[0] < 0.1


def test_logger(tmp_path):
    from gatelake.session import logger

    log = logger("gatelake.test", path=str(tmp_path / "log"))
    log.info("hello")
    assert logger("gatelake.test") is log and "hello" in (tmp_path / "log").read_text()
    assert math.isfinite(log.level)
