"""Sets of event numbers against Python's sets."""

import random

import pytest
from gatelake.operators import idsets
from gatelake.operators import populations as P
from gatelake.sources.project import Project
from pyspark.sql import functions as F

EXTREME = [0, 1, -1, 63, 64, -64, -65, 2**40, -(2**40), 2**63 - 1, -(2**63)]


def table(spark, sets):
    return spark.createDataFrame([(s, p, i) for (s, p), ids in sets.items() for i in ids], "sample_id string, population string, event_id long")


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(5)
    return {(s, p): [*rng.choices(range(-100, 300), k=k), *rng.sample(EXTREME, 6), *([7] * 3)] for s, k in (("a", 150), ("b", 3), ("c", 400)) for p in "xyz"} | {("d", "x"): [5]}


HOW = {"any": ("or", ["x", "y", "z"]), "all": ("and", ["x", "y", "z"]), "rest": ("not", ["x", "y", "z"]), "one": ("not", ["z"]), "odd": ("and", ["x", "none"])}


def brute(sets, s, how, parts):
    first, *more = [set(sets.get((s, p), ())) for p in parts]
    return {"or": first.union, "and": first.intersection, "not": first.difference}[how](*more)


def test_sets_equal_brute_force(spark, sets):
    got = idsets.combined(table(spark, sets), HOW).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(s, i, name) for name, (how, parts) in HOW.items() for s in "abcd" for i in brute(sets, s, how, parts)}
    sizes = {(r.sample_id, r.population): r.n for r in idsets.sizes(table(spark, sets), HOW).collect()}
    assert sizes == {(s, name): len(brute(sets, s, how, parts)) for name, (how, parts) in HOW.items() for s in "abcd"}


def test_packing_round_trip(spark, sets):
    packed = idsets.packed(table(spark, sets))
    assert {tuple(r) for r in idsets.unpacked(packed).collect()} == {(s, i, p) for (s, p), ids in sets.items() for i in ids}
    dense = spark.range(0, 6400).selectExpr("id AS event_id", "'s' AS sample_id", "'p' AS population")
    assert idsets.packed(dense).count() == 100


def test_nesting(spark, sets):
    tree = spark.createDataFrame([("x", "root"), ("y", "x"), ("z", "y"), ("none", "x")], "population string, parent string")
    got = {(r.sample_id, r.population): (r.n, r.n_outside) for r in idsets.outside(table(spark, sets), tree).collect()}
    assert got == {(s, p): (len(set(sets[s, p])), len(set(sets[s, p]) - set(sets[s, q]))) for s in "abc" for p, q in (("y", "x"), ("z", "y"))}


def test_odd_tables(spark):
    empty = table(spark, {})
    assert idsets.combined(empty, HOW).count() == 0 and idsets.sizes(empty, HOW).count() == 0
    assert [tuple(r) for r in idsets.sizes(empty.drop("sample_id"), {"a": ("or", ["x"])}, ()).collect()] == [("a", 0)]
    nulls = spark.createDataFrame([("s", "x", None), ("s", "x", 3), ("s", "x", 3), (None, "x", 4), ("s", None, 5)], "sample_id string, population string, event_id int")
    made = P.merged(nulls.withColumn("word", F.lit(1)).withColumn("bits", F.lit("b")), ["x"], "m")
    assert dict(made.dtypes)["event_id"] == "int" and {tuple(r) for r in made.collect()} == {("s", 3, "m"), (None, 4, "m")}
    with pytest.raises(TypeError, match="whole numbers"):
        P.merged(spark.createDataFrame([("s", "x", "e")], "sample_id string, population string, event_id string"), ["x"], "m")


def test_no_join_and_one_shuffle(spark, sets):
    plan = P.subtracted(table(spark, sets), "x", ["y", "z"], "m")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_merges_over_an_experiment(spark, tmp_path):
    p = Project(spark, f"file://{tmp_path}/p")
    e = p.add_experiment("e", {"channels": {"x": {"regex": "^x$"}}, "mappings": [["x", ""]]})
    for k in range(4):
        s = p.add_sample("e", f"s/{k}", spark.range(100).selectExpr("id AS event_id", "id * 1.0D AS x"))
        s.add_population("a", "root", s.data().where(f"x < {10 * k}").select("event_id"), "cluster", {"x": 1.0} if k else None)
        s.add_population("b", "root", s.data().where("x BETWEEN 5 AND 20").select("event_id"), "cluster", {"x": 4.0, "y": 2.0})
        if k != 2:
            s.add_population("in", "b" if k < 3 else "a", s.data().where("x BETWEEN 6 AND 8").select("event_id"), "cluster")
    p.sample = lambda i: e.sample(f"s/{i}")
    before = p._versions("populations")[-1]
    left = e.merge_populations({"m": ["a", "b"], "n": ["m", "a"], "in2": ["in", "a"], "a": ["m", "b"], "b": ["b", "a"], "one": ["a"]})
    everyone = [f"s/{k}" for k in range(4)]
    assert left == {"m": [], "n": [], "in2": everyone, "a": everyone, "b": everyone, "one": everyone} and p._versions("populations")[-1] - before <= 2
    for k in range(4):
        want = set(range(10 * k)) | set(range(5, 21))
        for name in ("m", "n"):
            row = p.sample(k).population(name)
            assert {r.event_id for r in p.sample(k).members(name).collect()} == want and (row.n, row.source, row.parent) == (len(want), "merged", "root")
            assert row.frac_of_root == row.frac_of_parent == pytest.approx(len(want) / 100)
        assert p.sample(k).population("m").signature == ({"x": 2.5, "y": 2.0} if k else {"x": 4.0, "y": 2.0})
    assert e.misplaced().count() == 0
    p.sample(0).update_population("b", p.sample(0).data().where("x BETWEEN 7 AND 30").select("event_id"))
    assert [tuple(r) for r in e.misplaced().collect()] == [("s/0", "in", 3, 1)]
