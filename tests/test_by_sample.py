"""Strategies fitted to every sample in one plan, against each sample fitted by itself."""

import numpy as np
import pytest
from gatelake.operators import gates
from gatelake.plans import by_sample
from gatelake.plans.strategy import Strategy
from pyspark.sql import functions as F


def samples(spark, n=5, shift=1.5):
    rng = np.random.default_rng(21)
    rows = []
    for s in range(n):
        a = np.concatenate([rng.normal(s * shift, 1, (150, 3)), rng.normal(8 + s * shift, 1, (150, 3))])
        rows += [(len(rows) + i, f"s{s}", *map(float, v)) for i, v in enumerate(a)]
    rows += [(10**6 + s, f"s{s}", None, 1.0, 2.0) for s in range(n)]
    return spark.createDataFrame(rows, "event_id long, sample_id string, x double, y double, z double").repartition(4).persist()


def one_by_one(s, df, **how):
    out = set()
    for r in df.select("sample_id").distinct().collect():
        own = df.where(F.col("sample_id") == r.sample_id)
        here = {k: v.where(F.col("sample_id") == r.sample_id) if k == "control" else v for k, v in how.items()}
        out |= {(r.sample_id, m.event_id, m.population) for m in s.applied(own, **here).membership(own).collect()}
    return out


def at_once(s, df, **how):
    assert by_sample.covers(s, how.get("search", False))
    return {(m.sample_id, m.event_id, m.population) for m in s.applied_to_samples(df, **how).collect()}


def strategy(df, *more):
    first = df.where("sample_id = 's0'")
    cut = gates.ThresholdGate("cut", "root", "x", method="density").fit(first)
    cut.label({"+": "hi", "-": "lo"})
    quarter = gates.ThresholdGate("quarter", "hi", "y", "z", method="quantile", params={"q": 0.3}).fit(first)
    quarter.label({"++": "pp", "+-": "rest", "-+": "rest", "--": "rest"})
    both = gates.BooleanGate("both", "root", "x", "y", method="or", populations=["lo", "pp"], children=[gates.Child("either")])
    return Strategy("s", [both, quarter, cut, *more])


def test_thresholds(spark):
    df = samples(spark)
    s = strategy(df)
    got = at_once(s, df)
    assert got == one_by_one(s, df) and {p for _, _, p in got} == {"hi", "lo", "pp", "rest", "either"}
    assert at_once(s, df, params={"quarter": {"q": 0.8}}) == one_by_one(s, df, params={"quarter": {"q": 0.8}}) != got


def test_controls(spark):
    df = samples(spark)
    control = df.withColumns({"x": F.col("x") + 0.7, "y": F.col("y") * 1.1})
    s = strategy(df)
    assert at_once(s, df, control=control) == one_by_one(s, df, control=control) != at_once(s, df)


@pytest.mark.parametrize(("method", "params"), [("dbscan", {"eps": 0.7, "least": 4}), ("hdbscan", {"least": 20})])
def test_polygons(spark, method, params):
    df = samples(spark, 3)
    shape = gates.PolygonGate("shape", "hi", "y", "z", method=method, params=params)
    shape.children = [gates.Child("first", polygon=[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]), gates.Child("second", polygon=[(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)])]
    s = strategy(df, shape)
    got = at_once(s, df)
    assert got == one_by_one(s, df) and sum(p in ("first", "second") for _, _, p in got) > 5


def test_ellipses_and_kmeans(spark):
    df = samples(spark, 3)
    ring = gates.EllipseGate("ring", "hi", "y", "z", method="gmm", params={"k": 1, "conf": 0.8}).fit(df)
    ring.label({"A": "round"})
    s = strategy(df, ring)
    got = at_once(s, df)
    assert got == one_by_one(s, df) and 200 < sum(p == "round" for _, _, p in got) < 450
    halves = gates.PolygonGate("halves", "root", "x", "y", method="kmeans", params={"k": 2})
    halves.children = [gates.Child("low", polygon=[(-3.0, -3.0), (3.0, -3.0), (0.0, 3.0)]), gates.Child("high", polygon=[(6.0, 6.0), (12.0, 6.0), (9.0, 12.0)])]
    found = at_once(Strategy("k", [halves]), df)
    counts = {(s, p): sum(1 for a, _, b in found if (a, b) == (s, p)) for s, p in {(a, b) for a, _, b in found}}
    assert set(counts) == {(f"s{i}", p) for i in range(3) for p in ("low", "high")} and all(135 <= n <= 150 for n in counts.values())


def test_registration(spark):
    df = samples(spark)
    s = strategy(df)
    fixed = gates.ThresholdGate("fixed", "root", "x", params={"x": 4.0}).fit(df)
    fixed.label({"+": "up", "-": "down"})
    s.add(fixed)
    s.add_normalisation("fixed", "s0")
    s.add_normalisation("quarter", "s0")
    got = at_once(s, df, normalise=True)
    assert got == one_by_one(s, df, normalise=True, reference=df.where("sample_id = 's0'"))
    assert all(abs(sum(a == f"s{i}" and p == "up" for a, _, p in got) - 150) <= 25 for i in range(5))


def test_jobs_do_not_grow_with_samples(spark):
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (3, 12):
        df = samples(spark, n)
        df.count()
        s = strategy(df.where("sample_id IN ('s0', 's1')"))
        spark.sparkContext.setJobGroup(f"samples {n}", "")
        s.applied_to_samples(df).count()
        counts.append(len(tracker.getJobIdsForGroup(f"samples {n}")))
        spark.sparkContext.setJobGroup("", "")
    assert abs(counts[0] - counts[1]) <= 2


def test_what_is_not_covered(spark):
    df = samples(spark, 2)
    s = strategy(df)
    s.gate("quarter").sampling = {"method": "faithful", "h": 0.5}
    assert not by_sample.covers(s, False) and s.applied_to_samples(df).count() > 0
    with pytest.raises(ValueError, match="too few"):
        strategy(df).applied_to_samples(df.unionByName(df.limit(2).withColumn("sample_id", F.lit("tiny"))))
