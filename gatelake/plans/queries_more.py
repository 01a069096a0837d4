"""Further queries: checks, ranges, signatures, tests and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, transforms
from ..operators import classify, clustering, features, gates, names, sampling, tables
from ..operators import populations as P
from .queries_events import _POPS_SQL, _pops
from .queries_samples import _labelled, _one
from .registry import cells, query, r6, table
from .strategy import Strategy


@query("SELECT event_id, round(log2(value), 6) AS y2, round(ln(value), 6) AS ye FROM events")
def xf_log_bases(spark, sf):
    x = transforms.number("value")
    return table(spark, sf, "events").select("event_id", r6(transforms.log(2).forward(x), "y2"), r6(transforms.log("natural").forward(x), "ye"))


@query("SELECT event_id, round(pow(2.0::DOUBLE, log2(value)), 6) AS v FROM events")
def xf_log_round_trip(spark, sf):
    s = transforms.log(2)
    return table(spark, sf, "events").select("event_id", r6(s.inverse(s.forward(F.col("value"))), "v"))


@query("WITH {CELLS} SELECT round(min(c0), 6) AS least, round(max(c0), 6) AS most FROM cells WHERE c0 > 0")
def positive_range(spark, sf):
    return transforms.positive_range(cells(spark, sf), "c0").select(r6("min", "least"), r6("max", "most"))


@query("WITH {CELLS} SELECT event_id, round(CASE WHEN c0 >= 0 THEN (pow(c0 + 1, 0.5::DOUBLE) - 1) / 0.5 ELSE -(pow(1 - c0, 1.5::DOUBLE) - 1) / 1.5 END, 6) AS y FROM cells")
def power_transform(spark, sf):
    return cells(spark, sf).select("event_id", r6(transforms.yeo_johnson(F.col("c0"), 0.5), "y"))


@query("SELECT event_id, round((pow(value, 0.3::DOUBLE) - 1) / 0.3, 6) AS y FROM events")
def box_cox_transform(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(transforms.box_cox(F.col("value"), 0.3), "y"))


@query("""WITH {CELLS}, q AS (SELECT quantile_cont(c0, [0, 0.25, 0.5, 0.75, 1]) AS q FROM cells) SELECT event_id, round(CASE WHEN c0 <= q[1] THEN 0 WHEN c0 < q[2] THEN 0.25 * (c0 - q[1]) / (q[2] - q[1])
    WHEN c0 < q[3] THEN 0.25 + 0.25 * (c0 - q[2]) / (q[3] - q[2]) WHEN c0 < q[4] THEN 0.5 + 0.25 * (c0 - q[3]) / (q[4] - q[3]) WHEN c0 < q[5] THEN 0.75 + 0.25 * (c0 - q[4]) / (q[5] - q[4]) ELSE 1 END, 6) AS c0 FROM cells, q""")
def scale_quantile(spark, sf):
    df = cells(spark, sf)
    return transforms.Scaler("quantile", {"n_quantiles": 5}).fit(df, ["c0"]).transform(df).select("event_id", r6("c0"))


@query("WITH {CELLS} SELECT event_id, round(c0 / (abs(c0) + abs(c1)), 6) AS c0 FROM cells")
def normalise_l1_rows(spark, sf):
    return transforms.normalise_rows(cells(spark, sf), ["c0", "c1"], "l1").select("event_id", r6("c0"))


@query("WITH {CELLS} SELECT event_id, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM cells")
def normalise_round_trip(spark, sf):
    df = transforms.normalise_rows(cells(spark, sf), ["c0", "c1"])
    return transforms.denormalise_rows(df, ["c0", "c1"]).select("event_id", r6("c0"), r6("c1"))


@query("SELECT 'value' AS feature, count(*) FILTER (WHERE value IS NULL) AS n_null FROM events UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL OR CAST(json_extract_string(props, '$.k') AS INT) > 90) FROM events")
def null_features(spark, sf):
    e = table(spark, sf, "events").select("value", F.when(F.get_json_object("props", "$.k").cast("int") <= 90, F.col("props")).alias("props"))
    return clustering.null_counts(e, ["value", "props"])


@query("WITH {CELLS} SELECT round(quantile_cont(c0, 0.001), 6) AS x0, round(quantile_cont(c0, 0.999), 6) AS x1, round(quantile_cont(c1, 0.001), 6) AS y0, round(quantile_cont(c1, 0.999), 6) AS y1 FROM cells")
def axis_limits(spark, sf):
    at = {r.axis: r for r in tables.axis_limits(cells(spark, sf), ["c0", "c1"]).collect()}
    return _one(spark, {"x0": at["c0"].least, "x1": at["c0"].most, "y0": at["c1"].least, "y1": at["c1"].most})


@query(f"WITH {_POPS_SQL} SELECT sample_id, population, n::BIGINT AS n, round(100 * n / sum(n) OVER (PARTITION BY sample_id), 6) AS percent_of_parent FROM (SELECT s.sample_id, p.population, count(c.event_id) AS n FROM (SELECT DISTINCT sample_id FROM cells) s CROSS JOIN (VALUES ('+'), ('-')) p(population) LEFT JOIN cells c ON c.sample_id = s.sample_id AND (CASE WHEN c0 >= 50 THEN '+' ELSE '-' END) = p.population GROUP BY ALL)")
def gate_stats(spark, sf):
    df = cells(spark, sf)
    g = gates.ThresholdGate("cut", "root", "c0", params={"x": 50}).fit(df)
    return Strategy("s", [g]).gate_stats(df, "cut").select("sample_id", "population", "n", r6("percent_of_parent"))


@query("WITH {CELLS}, m AS (SELECT CASE WHEN c0 >= 0 THEN '+' ELSE '-' END AS population, avg(c1) AS c1, avg(c2) AS c2 FROM cells GROUP BY ALL) SELECT population, round(abs(c1 - 10) + abs(c2 + 10), 6) AS cost FROM m")
def signature_cost(spark, sf):
    df = cells(spark, sf)
    found = gates.ThresholdGate("g", "root", "c0", params={"x": 0}).fit(df).predict(df)
    target = gates.Child("t", signature={"c1": 10.0, "c2": -10.0, "other": 3.0})
    rows = [(n, round(gates.cost(target, gates.Child(n, signature=s)), 6)) for n, s in gates.signatures(found, ["c1", "c2"]).items()]
    return spark.createDataFrame(rows, "population string, cost double")


@query("WITH {CELLS}, m AS (SELECT sample_id, avg(c0) AS c0, avg(c1) AS c1 FROM cells GROUP BY ALL), t AS (SELECT * FROM m WHERE sample_id = '0') SELECT arg_min(m.sample_id, abs(m.c0 - t.c0) + abs(m.c1 - t.c1)) AS closest FROM m, t WHERE m.sample_id != '0'")
def closest_signature(spark, sf):
    m = clustering.summarise(cells(spark, sf), ["c0", "c1"], "mean", ("sample_id",))
    target = m.where("sample_id = '0'").drop("sample_id").head().asDict()
    return gates.closest_signature(target, m.where("sample_id != '0'"), ["c0", "c1"], by="sample_id")


@query("WITH {CELLS} SELECT event_id, sample_id FROM cells WHERE c0 >= 0 AND c1 >= 0 AND c3 >= 0")
def backgate(spark, sf):
    """Events of a descendant over its ancestor's axes."""
    df, _, m = _pops(spark, sf)
    return P.load(P.load(df, m, "hi"), m, "deep").select("event_id", "sample_id")


@query("WITH {CELLS} SELECT event_id, 'a' AS layer FROM cells WHERE sample_id = '0' UNION ALL SELECT event_id, 'b' FROM cells WHERE sample_id = '1'")
def overlay_samples(spark, sf):
    df = cells(spark, sf)
    return tables.overlay({"a": df.where("sample_id = '0'"), "b": df.where("sample_id = '1'")}, ["event_id"])


@query("SELECT event_id, CASE WHEN value >= 100 THEN 'P' ELSE 'N' END AS label FROM events")
def meta_mask(spark, sf):
    from ..operators.batch import meta_mask as mask

    return mask(table(spark, sf, "events"), F.col("value") >= 100, "label").select("event_id", "label")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%')")
def name_search(spark, sf):
    rule = names.NameRule("a", "A", case_sensitive=True)
    n = table(spark, sf, "nation").where(rule.matches(F.col("n_name"))).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT p_partkey, nullif(trim(p_brand), '') AS brand, coalesce(nullif(trim(p_type), ''), p_name) AS shown FROM part")
def preferred_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.blank_to_null("p_brand").alias("brand"), F.coalesce(names.blank_to_null("p_type"), F.col("p_name")).alias("shown"))


@query("WITH {CELLS} SELECT event_id, (event_id // 64)::BIGINT AS chunk FROM cells")
def chunks(spark, sf):
    return names.chunks(cells(spark, sf), 64).select("event_id", "chunk")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_round_trip(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "struct<k:int>").alias("p"))
    return e.select("event_id", F.from_json(F.to_json("p"), "struct<k:int>").getField("k").alias("k"))


# --- tests

_CLICK_VIEW = "WITH e AS (SELECT event_type, value FROM events WHERE event_type IN ('click', 'view')), "


@query("WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type), w AS (SELECT *, n / v AS w FROM g), t AS (SELECT sum(w) AS s, sum(w * m) / sum(w) AS mu, count(*) AS k FROM w), l AS (SELECT sum(pow(1 - w / s, 2) / (n - 1)) AS l FROM w, t) SELECT round((sum(w * pow(m - mu, 2)) / (any_value(k) - 1)) / (1 + 2 * (any_value(k) - 2) / (pow(any_value(k), 2) - 1) * any_value(l)), 6) AS f, round((pow(any_value(k), 2) - 1) / (3 * any_value(l)), 4) AS df2 FROM w, t, l")
def welch_anova_f(spark, sf):
    a = features.welch_anova(table(spark, sf, "events"), "event_type", "value")
    return spark.createDataFrame([(round(a["F"], 6), round(a["df2"], 4))], "f double, df2 double")


@query("WITH d AS (SELECT event_type, abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY event_type)) AS d FROM events), g AS (SELECT event_type, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM d GROUP BY event_type), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g) SELECT round((sum(g.n * pow(g.m - t.m, 2)) / (any_value(t.k) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - any_value(t.k))), 6) AS f FROM g, t")
def levene_f(spark, sf):
    return _one(spark, {"f": features.levene(table(spark, sf, "events"), "event_type", "value")["F"]})


@query("WITH m AS (SELECT count(*) AS n, avg(value) AS a, stddev_pop(value) AS s, avg(pow(value, 2)) AS m2, avg(pow(value, 3)) AS m3, avg(pow(value, 4)) AS m4 FROM events), z AS (SELECT n, (m3 - 3 * a * m2 + 2 * pow(a, 3)) / pow(s, 3) AS sk, (m4 - 4 * a * m3 + 6 * a * a * m2 - 3 * pow(a, 4)) / pow(s, 4) - 3 AS ku FROM m) SELECT round(n / 6 * (sk * sk + ku * ku / 4), 3) AS jb FROM z")
def jarque_bera(spark, sf):
    return spark.createDataFrame([(round(features.jarque_bera(table(spark, sf, "events"), "value")["JB"], 3),)], "jb double")


@query("WITH {CELLS}, d AS (SELECT c0 - c1 AS d FROM cells WHERE c0 != c1), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d) SELECT round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 6) AS w FROM r")
def wilcoxon_w(spark, sf):
    return _one(spark, {"w": features.wilcoxon(cells(spark, sf), "c0", "c1")["W"]})


@query("WITH {CELLS}, k AS (SELECT 0.5 + (c0 < c0)::INT + (c1 < c0)::INT + (c2 < c0)::INT + 0.5 * (1 + (c1 = c0)::INT + (c2 = c0)::INT) AS a, 0.5 + (c0 < c1)::INT + (c2 < c1)::INT + 0.5 * (1 + (c0 = c1)::INT + (c2 = c1)::INT) AS b, 0.5 + (c0 < c2)::INT + (c1 < c2)::INT + 0.5 * (1 + (c0 = c2)::INT + (c1 = c2)::INT) AS c FROM cells), s AS (SELECT count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(a * a + b * b + c * c) AS q FROM k) SELECT round(((pow(a - 2 * n, 2) + pow(b - 2 * n, 2) + pow(c - 2 * n, 2)) / n) / ((q - n * 12) / (n * 2)), 6) AS q FROM s")
def friedman_q(spark, sf):
    return _one(spark, {"q": features.friedman(cells(spark, sf), "event_id", ["c0", "c1", "c2"])["Q"]})


@query("WITH {CELLS} SELECT round(avg(c0 - c1) / (stddev_samp(c0 - c1) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM cells")
def paired_t(spark, sf):
    t = features.paired_t_test(cells(spark, sf), "c0", "c1")
    return _one(spark, {"t": t["t"], "df": t["df"]})


@query("WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type), t AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS p FROM g) SELECT a.g AS a, b.g AS b, round(abs(a.m - b.m) / sqrt((p / a.n + p / b.n) / 2), 6) AS q FROM g a JOIN g b ON a.g < b.g, t")
def post_hoc_pairs(spark, sf):
    rows = features.post_hoc(table(spark, sf, "events"), "event_type", "value")
    return spark.createDataFrame([(r["a"], r["b"], round(r["q"], 6)) for r in rows], "a string, b string, q double")


@query()
def adjusted_tests(spark, sf):
    rows = features.by_variable(features.kruskal, cells(spark, sf), "sample_id", ["c0", "c1", "c2"])
    return spark.createDataFrame([(r["variable"], round(r["H"], 6), round(r["p_adjusted"], 6)) for r in rows], "variable string, h double, p_adjusted double")


# --- shapes, models

@query("""WITH {CELLS}, e AS (SELECT a.sample_id, a.c0 AS ax, a.c1 AS ay, b.c0 AS bx, b.c1 AS yb FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND (a.c0 != b.c0 OR a.c1 != b.c1) JOIN cells c ON c.sample_id = a.sample_id
    GROUP BY ALL HAVING min((b.c0 - a.c0) * (c.c1 - a.c1) - (b.c1 - a.c1) * (c.c0 - a.c0)) >= 0) SELECT sample_id, round(sum(ax * yb - bx * ay) / 2, 4) AS area FROM e GROUP BY sample_id""")
def hull_area(spark, sf):
    """The hull of each sample's events, from each partition's hull: hulls merge, so no sample is gathered whole."""
    corners = tables.hulls(cells(spark, sf), "sample_id", "c0", "c1")
    return spark.createDataFrame([(s, round(geometry.area(ring), 4)) for s, ring in corners.items()], "sample_id string, area double")


#: The box around a sample's events, its corners, and for each sample the corners of its own box and of the first sample's (side 0 and 1).
_BOXES_SQL = """boxes AS (SELECT sample_id, min(c0) AS x0, max(c0) AS x1, min(c1) AS y0, max(c1) AS y1 FROM cells GROUP BY ALL),
    corners AS (SELECT sample_id, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM boxes),
    both_of AS (SELECT sample_id, 0 AS side, x, y FROM corners WHERE sample_id != '0' UNION ALL SELECT s.sample_id, 1, c.x, c.y FROM boxes s, corners c WHERE s.sample_id != '0' AND c.sample_id = '0')"""


def boxes(spark, sf) -> dict[str, list[tuple[float, float]]]:
    """The box around the events of each sample, as a polygon."""
    rows = cells(spark, sf).groupBy("sample_id").agg(F.min("c0").alias("x0"), F.max("c0").alias("x1"), F.min("c1").alias("y0"), F.max("c1").alias("y1")).collect()
    return {r.sample_id: [(r.x0, r.y0), (r.x1, r.y0), (r.x1, r.y1), (r.x0, r.y1)] for r in rows}


@query(f"""WITH {{CELLS}}, {_BOXES_SQL}, o AS (SELECT b.sample_id, (b.x1 - b.x0) * (b.y1 - b.y0) AS own, greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) AS common FROM boxes b, boxes r WHERE r.sample_id = '0' AND b.sample_id != '0'),
    near AS (SELECT a.sample_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM both_of a JOIN both_of b ON b.sample_id = a.sample_id AND b.side != a.side GROUP BY a.sample_id, a.side, a.x, a.y),
    h AS (SELECT sample_id, max(d) AS hausdorff FROM near GROUP BY ALL),
    e AS (SELECT a.sample_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM both_of a JOIN both_of b ON a.sample_id = b.sample_id AND (a.x != b.x OR a.y != b.y) JOIN both_of c ON c.sample_id = a.sample_id GROUP BY ALL HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0),
    u AS (SELECT sample_id, sum(ax * yb - bx * ay) / 2 AS outline FROM e GROUP BY ALL)
    SELECT sample_id, round(common / own, 6) AS overlap, round(hausdorff, 4) AS hausdorff, CASE WHEN common > 0 THEN round(outline, 3) END AS outline FROM o JOIN h USING (sample_id) JOIN u USING (sample_id)""")
def polygon_relations(spark, sf):
    """Overlap, Hausdorff distance and area of the joint outline of each sample's box and the first sample's."""
    found = boxes(spark, sf)
    first, rows = found.pop("0"), []
    for s, box in found.items():
        shared = geometry.overlap(box, first)
        rows.append((s, round(shared, 6), round(geometry.hausdorff(box, first), 4), round(geometry.area(geometry.union_outline(box, first)), 3) if shared > 0 else None))
    return spark.createDataFrame(rows, "sample_id string, overlap double, hausdorff double, outline double")


@query("""WITH {CELLS}, m AS (SELECT avg(c0) AS mx, avg(c1) AS my, var_samp(c0) AS xx, var_samp(c1) AS yy, covar_samp(c0, c1) AS xy FROM cells),
    e AS (SELECT mx, my, (xx + yy) / 2 AS mean, sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS half, xx, xy, -2 * ln(0.2::DOUBLE) AS size FROM m),
    f AS (SELECT mx, my, sqrt((mean + half) * size) AS a, sqrt((mean - half) * size) AS b, atan2(mean + half - xx, xy) AS t FROM e),
    v AS (SELECT i, mx + a * cos(2 * pi() * i / 64) * cos(t) - b * sin(2 * pi() * i / 64) * sin(t) AS x, my + a * cos(2 * pi() * i / 64) * sin(t) + b * sin(2 * pi() * i / 64) * cos(t) AS y FROM f, range(64) r(i)),
    s AS (SELECT p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM v p JOIN v q ON q.i = (p.i + 1) % 64),
    k AS (SELECT event_id, sample_id, count(*) FILTER (WHERE c1 >= least(y1, y2) AND c1 < greatest(y1, y2) AND c0 < (c1 - y1) * (x2 - x1) / (y2 - y1) + x1) AS n FROM cells, s GROUP BY ALL)
    SELECT sample_id, 'A' AS population, count(*) AS n FROM k WHERE n % 2 = 1 GROUP BY sample_id""")
def ellipse_gate_confidence(spark, sf):
    df = cells(spark, sf)
    g = gates.EllipseGate("g", "root", "c0", "c1", method="normal", params={"k": 1, "conf": 0.8}).fit(df)
    return g.predict(df).groupBy("sample_id", "population").agg(F.count("*").alias("n"))


@query("""WITH {CELLS}, cuts AS (SELECT 0.3::DOUBLE AS q, quantile_cont(c0, 0.3) AS t FROM cells UNION ALL SELECT 0.5, quantile_cont(c0, 0.5) FROM cells UNION ALL SELECT 0.7, quantile_cont(c0, 0.7) FROM cells),
    f AS (SELECT q, CASE WHEN c0 >= t THEN '+' ELSE '-' END AS child, avg(c0) AS x, avg(c1) AS y FROM cells, cuts GROUP BY ALL), c AS (SELECT f.child, f.q, abs(f.x - g.x) + abs(f.y - g.y) AS cost FROM f JOIN f g ON g.child = f.child AND g.q = 0.5)
    SELECT child, arg_min(q, cost) AS q, round(min(cost), 6) AS cost FROM c GROUP BY child""")
def hyperparameter_gate(spark, sf):
    df = cells(spark, sf)
    g = gates.ThresholdGate("g", "root", "c0", method="quantile", params={"q": 0.5}).fit(df)
    for c, s in gates.signatures(g.predict(df), ["c0", "c1"]).items():
        g.child(c).signature = s
    best = gates.grid_search(g, {"q": [0.3, 0.5, 0.7]}, df, ["c0", "c1"])
    return spark.createDataFrame([(k, p["q"], round(c, 6)) for k, (p, c) in best.items()], "child string, q double, cost double")


@query()
def decision_tree_depths(spark, sf):
    train, test = classify.split(_labelled(spark, sf), 0.5)
    rows = classify.CellClassifier(["c0", "c1"], kind="decision_tree", scale=None).prune(train, test, [1, 3])
    return spark.createDataFrame([(depth, round(score, 6)) for depth, score in rows], "depth int, accuracy double")


@query()
def learning_curve(spark, sf):
    train, test = classify.split(_labelled(spark, sf), 0.3)
    rows = classify.CellClassifier(["c0", "c1"]).learning_curve(train, test, (0.3, 1.0))
    return spark.createDataFrame([(float(a), round(float(b), 6)) for a, b in rows], "share double, balanced_accuracy double")


@query()
def tuned_classifier(spark, sf):
    params, score = classify.CellClassifier(["c0", "c1"]).tune(_labelled(spark, sf), {"regParam": [0.0, 0.5]}, 2)
    return spark.createDataFrame([(float(params["regParam"]), round(float(score), 6))], "reg double, balanced_accuracy double")


@query("WITH {CELLS} SELECT 'reference' AS sample_id, sample_id AS original, event_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5(event_id::VARCHAR || ':0'), event_id) AS r FROM cells) WHERE r <= 20")
def reference_sample_pool(spark, sf):
    """A pool of at most 20 events of each sample, as one new sample."""
    return sampling.uniform(cells(spark, sf), 20, by=["sample_id"]).withColumn("original", F.col("sample_id")).withColumn("sample_id", F.lit("reference")).select("sample_id", "original", "event_id")


@query()
def scree(spark, sf):
    p = features.PCA([f"c{i}" for i in range(6)], 3).fit(cells(spark, sf))
    return spark.createDataFrame([(i, round(float(r), 6)) for i, r in enumerate(p.ratio)], "component int, ratio double")


@query()
def clusters_as_populations(spark, sf):
    k = clustering.global_clusters(cells(spark, sf), ["c0", "c1"], "bisecting_kmeans", 3)
    return clustering.as_populations(k, "cluster_label").groupBy("sample_id", "population").agg(F.count("*").alias("n"))


