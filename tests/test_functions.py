import math

import numpy as np
import pytest
from gatelake.functions import density, distributions, geometry, transforms
from gatelake.operators import clustering, features, gates, names, sampling
from gatelake.operators import populations as P
from gatelake.plans.strategy import Strategy
from pyspark.sql import functions as F


def points(spark, xs, **more):
    rows = [("s", i, *map(float, r)) for i, r in enumerate(xs)]
    return spark.createDataFrame(rows, "sample_id string, event_id long, " + ", ".join(f"{c} double" for c in "xyz"[: len(xs[0])]))


@pytest.mark.parametrize("scale", [transforms.logicle(), transforms.hyperlog(), transforms.asinh(), transforms.log(), transforms.log(2), transforms.log(10), transforms.log("natural")])
def test_transforms_invert(spark, scale):
    values = [-1000.0, -3.5, 0.0, 0.1, 1.0, 77.0, 262144.0]
    values = [v for v in values if v > 0 or not scale.positive]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", scale.inverse(scale.forward(F.col("x"))).alias("y")).collect()
    assert all(math.isclose(r.x, r.y, rel_tol=1e-6, abs_tol=1e-6) for r in got)


def test_biexponential_constants():
    for k in (transforms.logicle_constants(), transforms.hyperlog_constants()):
        value = lambda y: k["A"] * math.exp(k["b"] * y) + (-k["C"] * math.exp(-k["d"] * y) if "d" in k else k["C"] * y) - k["F"]  # noqa: E731, B023
        assert value(1.0) == pytest.approx(262144) and value(k["x1"]) == pytest.approx(0, abs=1e-9)


def test_missing_values_are_in_no_child(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")
    got = [r.s for r in df.select(geometry.side("x", 3).alias("s")).collect()]
    assert got == ["-", None, None, "+"]


def test_clamping_needs_a_positive_value(spark):
    with pytest.raises(ValueError, match="x"):
        transforms.clamp_to_positive(spark.createDataFrame([(-1.0,), (0.0,)], "x double"), ["x"])


@pytest.mark.parametrize("method", ["standard", "minmax", "robust", "maxabs"])
def test_scalers_invert_and_survive_constants(spark, method):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (9.0, 3.0)], "a double, b double")
    s = transforms.Scaler(method).fit(df, ["a", "b"])
    assert [tuple(r) for r in s.inverse(s.transform(df)).collect()] == [pytest.approx(tuple(r)) for r in df.collect()]


def test_polygon_is_strict(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = points(spark, [(2, 2), (0, 2), (4, 4), (2, 0), (5, 1), (3.9, 0.1)])
    assert [r.event_id for r in df.where(geometry.in_polygon("x", "y", square)).collect()] == [0, 5]


def test_rectangles_overlap():
    a, b = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (8, 0), (8, 4), (2, 4)]
    far = [(9, 9), (10, 9), (10, 10), (9, 10)]
    assert geometry.overlap(a, b) == pytest.approx(0.5) and geometry.overlap(a, far) == 0 and geometry.overlap(a, b, 0.6) == 0


def test_ellipse(spark):
    df = points(spark, [(5, 5), (9, 6), (5, 9)])
    assert [r.event_id for r in df.where(geometry.in_ellipse("x", "y", (5, 5), 10, 5, 15)).collect()] == [0, 1]


@pytest.mark.parametrize("conf", [0.95, 0.8, 0.5])
def test_confidence_ellipse_holds_its_share(conf):
    rng = np.random.default_rng(0)
    x = rng.multivariate_normal([0, 0], [[4, 1.5], [1.5, 2]], 4000)
    w, h, angle = geometry.confidence_ellipse(*np.var(x, axis=0, ddof=1), np.cov(x.T)[0, 1], conf)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    u, v = x[:, 0] * c + x[:, 1] * s, x[:, 1] * c - x[:, 0] * s
    assert ((2 * u / w) ** 2 + (2 * v / h) ** 2 <= 1).mean() == pytest.approx(conf, abs=0.03)


def test_hull():
    assert geometry.convex_hull(np.array([(0, 0), (1, 1), (2, 2)])) == []
    assert set(geometry.convex_hull(np.array([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]))) == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_density_threshold_of_a_mixture(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(0.2, 1, 500), rng.normal(2.5, 0.2, 250), rng.normal(6.5, 0.5, 500)])
    g = gates.ThresholdGate("g", "root", "x", method="density").fit(points(spark, x[:, None]))
    assert round(g.thresholds[0]) in (4, 5) and [c.name for c in g.children] == ["+", "-"]
    with pytest.raises(ValueError, match="children"):
        g.fit(points(spark, x[:, None]))


def test_polygon_gate_matches_children(spark):
    rng = np.random.default_rng(1)
    blob = lambda c, n: rng.normal(c, 0.5, (n, 2))
    first = points(spark, np.concatenate([blob((1, 1), 300), blob((8, 8), 300)]))
    g = gates.PolygonGate("g", "root", "x", "y", method="kmeans", params={"k": 2}).fit(first)
    g.label({"A": "low", "B": "high"})
    again = points(spark, np.concatenate([blob((8.2, 8), 200), blob((1.2, 1), 400)]))
    sizes = {r.population: r.n for r in g.fit_predict(again).groupBy("population").agg(F.count("*").alias("n")).collect()}
    assert sizes["low"] > 380 and 180 < sizes["high"] <= 200


def test_many_polygons_are_one_small_plan(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rings = [geometry.convex_hull(rng.normal(c, 0.4, (12, 2))) for c in rng.uniform(0, 10, (60, 2))] + [[(1.0, 1.0), (4.0, 1.0), (2.0, 2.0), (4.0, 3.0), (1.0, 3.0)], [(float(i), float(j)) for i, j in ((5, 5), (6, 5), (6, 6), (5, 6), (5, 5))]]
    df = points(spark, np.concatenate([rng.uniform(0, 10, (500, 2)), np.array(rings[0]), [(5.0, 5.5), (5.5, 5.5), (2.0, 2.0), (1.5, 2.0), (np.nan, 2.0), (5.5, np.inf)]])).repartition(3)
    g = gates.PolygonGate("g", "root", "x", "y", children=[gates.Child(f"p{i}", polygon=[tuple(map(float, p)) for p in r]) for i, r in enumerate(rings)])
    found = []
    for most in (10**6, 10):
        monkeypatch.setattr(gates, "PLAN_CORNERS", most)
        found.append(sorted((r.event_id, r.population) for r in g.predict(df).collect()))
    assert found[0] == found[1] and len(found[0]) > 100
    plan = g.predict(df)._jdf.queryExecution().logical().toString()
    assert "CASE WHEN" in plan and plan.count("CASE WHEN") < 10  # only those of missing values


def test_gates_and_strategies_keep_through_json(spark):
    df = points(spark, [(i % 10, i % 7) for i in range(100)])
    a = gates.ThresholdGate("a", "root", "x", method="quantile", params={"q": 0.5}).fit(df)
    a.label({"+": "hi", "-": "lo"})
    b = gates.PolygonGate("b", "hi", "x", "y", params={"x_values": [0, 20, 20, 0], "y_values": [-1, -1, 3, 3]}).fit(df)
    s = Strategy("s", [b, a])
    again = Strategy.from_json(s.to_json())
    assert sorted(map(tuple, again.statistics(df).collect())) == sorted(map(tuple, s.statistics(df).collect()))
    assert s.downstream("root") == ["hi", "A", "lo"] and s.population(df, "A").count() == again.population(df, "A").count() > 0


def test_orphans_are_an_error(spark):
    with pytest.raises(ValueError, match="no parent"):
        P.gated(points(spark, [(1, 2)]), {"a": ("nowhere", F.lit(True))})


def test_grid_search_picks_the_closest(spark):
    df = points(spark, [(i, 0) for i in range(100)])
    g = gates.ThresholdGate("g", "root", "x", method="quantile", params={"q": 0.5}).fit(df)
    target = gates.signatures(g.predict(df), ["x"])
    for c in g.children:
        c.signature = target[c.name]
    best = gates.grid_search(g, {"q": [0.1, 0.5, 0.9]}, df, ["x"])
    assert {k: v[0]["q"] for k, v in best.items()} == {"+": 0.5, "-": 0.5}


def test_uniform_samples(spark):
    df = points(spark, [(i, 0) for i in range(50)])
    assert sampling.uniform(df, 20).count() == 20 and sampling.uniform(df, 99).count() == 50
    assert sampling.uniform(df, 20, seed=1).collect() == sampling.uniform(df.repartition(7), 20, seed=1).collect()
    with pytest.raises(TypeError):
        sampling.uniform(df, "20")


def test_knn_restores_blobs(spark):
    rng = np.random.default_rng(0)
    xs = np.concatenate([rng.normal(c, 0.3, (200, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    df = points(spark, xs).withColumn("label", (F.col("event_id") / 200).cast("int"))
    done = sampling.knn_predict(df, sampling.uniform(df, 0.5), ["x", "y"], "label", 5)
    assert done.where("label != predicted").count() == 0


@pytest.mark.parametrize(("got", "want"), [(distributions.t_p(2.0, 10), 0.0733880), (distributions.f_p(3.0, 2, 20), 1.3**-10), (distributions.chi2_p(5.0, 3), 0.1717971), (2 * distributions.normal_sf(1.96), 0.0499958)])
def test_tail_probabilities(got, want):
    assert got == pytest.approx(want, abs=2e-6)


def test_studentised_range_at_the_tables_critical_value():
    assert distributions.studentised_range_p(3.578, 3, 20) == pytest.approx(0.05, abs=5e-4)


def test_adjustments():
    assert distributions.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert distributions.benjamini_hochberg([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.04, 0.04])


def test_names():
    from gatelake.operators.names import Panel

    p = Panel.from_dict({"channels": {"FL1": {"regex": "fl-?1"}}, "markers": {"CD4": {"regex": "cd4"}}, "mappings": [["FL1", "CD4"], ["FL2", "CD8"]]})
    assert p.check() == ["undefined channel FL2", "undefined marker CD8"]
    assert names.column_names(["a", "b"], ["x", ""]) == ["x", "b"]
    assert names.spill_matrix("2,a,b,1,0.1,0.2,1") == (["a", "b"], [[1.0, 0.1], [0.2, 1.0]])


def test_standardise(spark):
    p = names.Panel([names.NameRule("FL1", "fl-?1")], [names.NameRule("CD4", "cd4", "T4")], [("FL1", "CD4")])
    df = spark.createDataFrame([("fl-1", "cd4"), ("FL1", ""), (None, "T4")], "channel string, marker string")
    assert {tuple(r) for r in names.standardise(df, p).collect()} == {("FL1", "CD4")}
    with pytest.raises(Exception, match="both missing"):
        names.standardise(spark.createDataFrame([(" ", None)], "channel string, marker string"), p).collect()


def test_fcs_round_trip(spark, tmp_path):
    from gatelake.sources import fcs

    rng = np.random.default_rng(0)
    data = rng.normal(0, 100, (20000, 3)).astype(np.float32)
    fcs.write(str(tmp_path / "a.fcs"), data, [("FL_1", "CD4"), ("FL2", ""), ("Time", "t/x")], {"$DATE": "01-JAN-2020", "SPILL": "2,FL1,FL2,1,0.1,0.2,1"})
    fcs.write(str(tmp_path / "b_comp.FCS"), data[:5], [("x", "")] * 3)
    (tmp_path / "bad.fcs").write_bytes(b"nothing here" * 10)
    fcs.register(spark)
    meta = spark.read.format("fcs").option("part", "meta").load(str(tmp_path)).collect()
    assert len(meta) == 1 and meta[0].n_events == 20000 and [tuple(c) for c in meta[0].channels] == [("FL-1", "CD4"), ("FL2", ""), ("Time", "t/x")]
    got = spark.read.format("fcs").load(str(tmp_path)).orderBy("event_id").toPandas()
    assert np.array_equal(np.stack(got["values"]), data)


def test_project(spark, tmp_path):
    from gatelake.sources.project import Project

    p = Project(spark, f"file://{tmp_path}/p")
    p.add_experiment("e", {"channels": {"x": {"regex": "x"}}, "mappings": [["x", ""]]})
    with pytest.raises(ValueError, match="exists"):
        p.add_experiment("e", {})
    p.add_subject("s1", age=40, site={"name": "north"})
    df = points(spark, [(1, 2), (3, 4)]).drop("sample_id")
    p.add_sample("e", "a", df, subject_id="s1", controls={"FMO": df.limit(1)}, spill=(["x", "y"], [[1.0, 0.5], [0.0, 1.0]]))
    p.add_sample("e", "b", df)
    assert p.list_samples("e") == ["a", "b"] and p.subject("s1")["age"] == 40
    assert p.events("e").where("sample_id = 'a'").orderBy("event_id").select("x", "y").collect()[0].asDict() == {"x": 1.0, "y": 1.5}
    assert [r.sample_id for r in p.samples_by_subject("e", F.get_json_object("attrs", "$.site.name") == "north").collect()] == ["a"]
    assert {r.control: r.n for r in p.control_counts("e").collect()} == {"FMO": 1, "total": 2}
    p.remove_sample("e", "a")
    assert p.list_samples("e") == ["b"] and p.events("e").count() == 2


def test_harmony_mixes_samples(spark):
    from gatelake.operators import batch

    rng = np.random.default_rng(0)
    blobs = [(0, 0), (10, 0), (0, 10)]
    rows = [(s, k * 300 + i, *map(float, rng.normal(0, 0.5, 2) + blobs[i % 3] + shift)) for k, (s, shift) in enumerate([("a", 0), ("b", 1.2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id string, event_id long, x double, y double")
    fixed = batch.Harmony(["x", "y"], clusters=4, rounds=8).run(df)
    score = lambda d: batch.lisi(d, ["x", "y"]).agg(F.avg("lisi").alias("v")).head().v
    assert score(fixed) > score(df) + 0.2


@pytest.mark.parametrize(("n", "block"), [(6000, 400), (300, 4096), (20, 4096), (0, 4096)])
def test_lisi_of_all_events(spark, monkeypatch, n, block):
    """Every event has a row, and neighbours are sought among all."""
    from gatelake.operators import batch

    monkeypatch.setattr(batch, "BLOCK_ROWS", block)
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, 2))
    x[: n // 10] = x[:1]  # one very common place
    label = rng.choice(["a", "b", "c"], n)
    df = spark.createDataFrame([(str(s), i, *map(float, r)) for i, (s, r) in enumerate(zip(label, x, strict=True))] + [("a", n, None, 0.0)], "sample_id string, event_id long, x double, y double")
    got = batch.lisi(df, ["x", "y"]).toPandas().set_index("event_id").lisi
    assert sorted(got.index) == list(range(n))
    tie = dict(df.select("event_id", F.xxhash64("event_id")).collect())
    tie = np.array([tie[i] for i in range(n)])
    for i in range(0, n, max(1, n // 500)):
        near = label[np.lexsort((tie, ((x - x[i]) ** 2).sum(1)))[:30]]
        assert got[i] == pytest.approx(1 / sum((near == c).mean() ** 2 for c in "abc"))


def test_consensus_and_louvain_find_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (20, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    truth = np.repeat([0, 1, 2], 20)
    same = lambda lab: ((lab[:, None] == lab[None]) == (truth[:, None] == truth[None])).all()
    assert same(clustering.agglomerate(x, 3))
    near = clustering.knn_graph(x, 8)
    assert same(clustering.louvain({(min(i, j), max(i, j)): 1.0 for i, r in enumerate(near.tolist()) for j in r}, 60))


def test_rank_tests_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 20, 60), rng.integers(3, 23, 50)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert features.mann_whitney(df, "g", "v")["U"] == pytest.approx(u)
    assert features.kruskal(df, "g", "v")["p"] < 0.05 and features.t_test(df, "g", "v")["p"] < 0.05


def test_stream_gives_the_same_gates(spark, tmp_path, sf):
    from gatelake.streaming import gate_counts

    src = spark.read.parquet(f"{sf}/events.parquet")
    g = gates.ThresholdGate("g", "root", "value", params={"x": 100}).fit(src)
    src.write.parquet(str(tmp_path / "in"))
    stream = gate_counts(g.predict(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM counts").head().n == src.count()
