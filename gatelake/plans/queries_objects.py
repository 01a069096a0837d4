"""Queries on strategies, stored populations, controls and the numbers behind plots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, transforms
from ..operators import batch, classify, clustering, controls, embedding, features, gates, idsets, names, sampling, tables
from ..operators import populations as P
from ..session import scratch
from ..sources.project import Project
from .queries_events import _POPS_SQL, POLYGON, _lit, _polygon_sql, _pops
from .queries_more import boxes
from .queries_samples import _clustered, _labelled, _one
from .registry import cells, query, r6, table
from .strategy import Strategy


def _small() -> Strategy:
    """hi and lo by c0, of hi the polygon 'in' over c1 and c2, and two boolean gates."""
    cut = gates.ThresholdGate("cut", "root", "c0", params={"x": 0.0}, thresholds=(0.0, None), children=[gates.Child("hi", "+"), gates.Child("lo", "-")])
    side = gates.ThresholdGate("side", "root", "c3", params={"x": 100.0}, thresholds=(100.0, None), children=[gates.Child("right", "+"), gates.Child("left", "-")])
    shape = gates.PolygonGate("shape", "hi", "c1", "c2", children=[gates.Child("in", polygon=POLYGON)])
    both = gates.BooleanGate("both", "root", "c0", "c3", method="and", populations=["hi", "right"], children=[gates.Child("hi_right")])
    rest = gates.BooleanGate("rest", "hi", "c1", "c2", method="not", populations=["hi", "in", "right"], children=[gates.Child("hi_rest")])
    return Strategy("small", [rest, shape, both, side, cut])


_IN = _polygon_sql("c1", "c2", POLYGON)
_SMALL_SQL = f"""{{CELLS}}, f AS (SELECT *, c0 >= 0 AS hi, c3 >= 100 AS rt, c0 >= 0 AND {_IN} AS inside FROM cells),
    m AS (SELECT sample_id, event_id, unnest([CASE WHEN hi THEN 'hi' END, CASE WHEN NOT hi THEN 'lo' END, CASE WHEN rt THEN 'right' END, CASE WHEN NOT rt THEN 'left' END,
        CASE WHEN inside THEN 'in' END, CASE WHEN hi AND rt THEN 'hi_right' END, CASE WHEN hi AND NOT inside AND NOT rt THEN 'hi_rest' END]) AS population FROM f),
    members AS (SELECT * FROM m WHERE population IS NOT NULL)"""


@query(f"WITH {_SMALL_SQL} SELECT sample_id, population, count(*) AS n FROM members GROUP BY ALL")
def strategy_boolean(spark, sf):
    """Boolean gates are gates of the strategy, kept through JSON."""
    s = Strategy.from_json(_small().to_json())
    return s.statistics(cells(spark, sf)).where("n > 0 AND population != 'root'").select("sample_id", "population", "n")


@query(f"""WITH {_SMALL_SQL}, s AS (SELECT * FROM members WHERE sample_id IN ('0', '1')), t AS (SELECT sample_id, count(*) AS n FROM cells WHERE sample_id IN ('0', '1') GROUP BY ALL),
    tree(population, parent) AS (VALUES ('hi', 'root'), ('lo', 'root'), ('right', 'root'), ('in', 'hi'), ('hi_right', 'root'), ('sides', 'root'), ('hi_only', 'root')),
    x AS (SELECT * FROM s WHERE population NOT IN ('left', 'hi_rest') UNION SELECT sample_id, event_id, 'sides' FROM s WHERE population IN ('lo', 'right')
          UNION SELECT sample_id, event_id, 'hi_only' FROM (SELECT sample_id, event_id FROM s WHERE population = 'hi' EXCEPT SELECT sample_id, event_id FROM s WHERE population IN ('in', 'right'))),
    n AS (SELECT sample_id, population, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT t.sample_id, population, parent, t.n AS total, coalesce(n.n, 0) AS n FROM t CROSS JOIN tree LEFT JOIN n USING (sample_id, population))
    SELECT g.sample_id, g.population, g.parent, g.n::BIGINT AS n, round(coalesce(g.n / nullif(CASE WHEN g.parent = 'root' THEN g.total ELSE p.n END, 0), 0), 6) AS frac_of_parent, round(g.n / g.total, 6) AS frac_of_root
    FROM g LEFT JOIN g p ON p.sample_id = g.sample_id AND p.population = g.parent""")
def population_store(spark, sf):
    """Populations of two samples written to a project, merged, subtracted, deleted and read back."""
    p = Project(spark, scratch(spark, "project"))
    e = p.add_experiment("e", {"channels": {f"c{i}": {"regex": f"^c{i}$"} for i in range(6)}, "mappings": [[f"c{i}", ""] for i in range(6)]})
    df = cells(spark, sf)
    for s in ("0", "1"):
        own = p.add_sample("e", s, df.where(F.col("sample_id") == s).drop("sample_id"))
        own.save(_small().definitions())
        own.delete_populations(["hi_rest"])
        own.merge(["lo", "right"], "sides")
        own.subtract("hi", ["in", "right"], "hi_only")
        own.delete_populations(["left"])
    return e.statistics().where("population != 'root'").select("sample_id", "population", "parent", "n", r6("frac_of_parent"), r6("frac_of_root"))


_SETS = {"any": ("or", ["in", "right", "lo"]), "all": ("and", ["hi", "right", "in"]), "rest": ("not", ["hi", "in", "right"])}
_SETS_SQL = """x AS (SELECT sample_id, event_id, 'any' AS population FROM members WHERE population IN ('in', 'right', 'lo') GROUP BY ALL
    UNION ALL SELECT sample_id, event_id, 'all' FROM members WHERE population IN ('hi', 'right', 'in') GROUP BY sample_id, event_id HAVING count(DISTINCT population) = 3
    UNION ALL SELECT sample_id, event_id, 'rest' FROM (SELECT sample_id, event_id FROM members WHERE population = 'hi' EXCEPT SELECT sample_id, event_id FROM members WHERE population IN ('in', 'right')))"""


@query(f"WITH {_SMALL_SQL}, {_SETS_SQL} SELECT sample_id, population, event_id FROM x")
def population_sets(spark, sf):
    """Unions, intersections and differences of stored populations of all samples, from one aggregate of 64-bit words."""
    return idsets.combined(_small().membership(cells(spark, sf)), _SETS).select("sample_id", "population", "event_id")


@query(f"WITH {_SMALL_SQL}, {_SETS_SQL}, s AS (SELECT DISTINCT sample_id FROM members), p(population) AS (VALUES ('any'), ('all'), ('rest')) SELECT sample_id, population, count(event_id)::BIGINT AS n FROM s CROSS JOIN p LEFT JOIN x USING (sample_id, population) GROUP BY ALL")
def population_set_sizes(spark, sf):
    """Sizes of the same sets by counting bits; no set is unpacked."""
    return idsets.sizes(_small().membership(cells(spark, sf)), _SETS).select("sample_id", "population", "n")


@query(f"""WITH {_SMALL_SQL}, tree(population, parent) AS (VALUES ('in', 'hi'), ('right', 'hi'), ('hi_right', 'right'))
    SELECT m.sample_id, m.population, count(*) AS n, count(*) FILTER (WHERE p.event_id IS NULL) AS n_outside FROM members m JOIN tree t USING (population) LEFT JOIN members p ON p.sample_id = m.sample_id AND p.population = t.parent AND p.event_id = m.event_id GROUP BY ALL""")
def population_nesting(spark, sf):
    """How many members of each population its parent lacks, for all samples and populations at once."""
    tree = spark.createDataFrame([("in", "hi"), ("right", "hi"), ("hi_right", "right")], "population string, parent string")
    return idsets.outside(_small().membership(cells(spark, sf)), tree).select("sample_id", "population", "n", "n_outside")


@query(f"""WITH {_SMALL_SQL}, t AS (SELECT sample_id, count(*) AS total FROM cells GROUP BY ALL), x AS (SELECT sample_id, event_id, 'sides' AS population FROM members WHERE population IN ('lo', 'right') UNION SELECT sample_id, event_id, 'most' FROM members WHERE population IN ('lo', 'right', 'hi_right'))
    SELECT sample_id, population, count(*) AS n, round(count(*) / any_value(total), 6) AS frac_of_parent FROM x JOIN t USING (sample_id) GROUP BY ALL""")
def experiment_merge(spark, sf):
    """Populations of every sample of an experiment merged, then merged again: a change for each new population, not for each sample."""
    p = Project(spark, scratch(spark, "project"))
    e = p.add_experiment("e", {"channels": {f"c{i}": {"regex": f"^c{i}$"} for i in range(6)}, "mappings": [[f"c{i}", ""] for i in range(6)]})
    df = cells(spark, sf)
    for s in sorted(r.sample_id for r in df.select("sample_id").distinct().collect()):
        p.add_sample("e", s, df.where(F.col("sample_id") == s).drop("sample_id"))
    e.apply(_small())
    e.merge_populations({"sides": ["lo", "right"], "most": ["sides", "hi_right"]})
    return p.table("populations").where(F.col("source") == "merged").select("sample_id", "population", "n", r6("frac_of_parent"))


@query("""WITH {CELLS}, a AS (SELECT * FROM cells WHERE sample_id IN ('0', '1', '2', '3')), b AS (SELECT * FROM cells WHERE sample_id NOT IN ('0', '1', '2', '3')),
    t AS (SELECT quantile_cont(c0, 0.5) AS t FROM a), target AS (SELECT CASE WHEN c0 >= t THEN '+' ELSE '-' END AS child, avg(c0) AS x, avg(c1) AS y FROM a, t GROUP BY ALL),
    q AS (SELECT unnest([0.3, 0.5, 0.7]) AS q), cuts AS (SELECT 0.3 AS q, quantile_cont(c0, 0.3) AS t FROM b UNION ALL SELECT 0.5, quantile_cont(c0, 0.5) FROM b UNION ALL SELECT 0.7, quantile_cont(c0, 0.7) FROM b),
    found AS (SELECT q, t, CASE WHEN c0 >= t THEN '+' ELSE '-' END AS child, avg(c0) AS x, avg(c1) AS y FROM b, cuts GROUP BY ALL),
    best AS (SELECT child, arg_min(f.t, abs(f.x - target.x) + abs(f.y - target.y)) AS t FROM found f JOIN target USING (child) GROUP BY child)
    SELECT b.sample_id, child AS population, count(*) AS n FROM b JOIN best ON CASE WHEN child = '+' THEN c0 >= t ELSE c0 < t END GROUP BY ALL""")
def strategy_search(spark, sf):
    """A grid in the strategy: for each child the quantile whose population is closest to the signature learned on other samples."""
    df = cells(spark, sf)
    learned, new = df.where(F.col("sample_id").isin("0", "1", "2", "3")), df.where(~F.col("sample_id").isin("0", "1", "2", "3"))
    g = gates.ThresholdGate("g", "root", "c0", method="quantile", params={"q": 0.5}).fit(learned)
    for c, signature in gates.signatures(g.predict(learned), ["c0", "c1"]).items():
        g.child(c).signature = signature
    s = Strategy("s", [g])
    s.add_grid("g", {"q": [0.3, 0.5, 0.7]})
    return s.applied(new, search=True).membership(new).groupBy("sample_id", "population").agg(F.count("*").alias("n"))


@query("""WITH {CELLS}, w AS (SELECT sample_id, event_id, CASE WHEN c0 <= -1000 THEN -1000 WHEN c0 < 0 THEN -1000 + (c0 + 1000) * 1.5 WHEN c0 < 1000 THEN 500 + c0 * 0.5 ELSE 1000 END AS x FROM cells)
    SELECT event_id, CASE WHEN x >= 600 THEN '+' ELSE '-' END AS population FROM w""")
def gate_warped(spark, sf):
    """A gate that sees its axis registered to a reference: a piecewise-linear expression in front of the threshold."""
    df = cells(spark, sf)
    g = gates.ThresholdGate("g", "root", "c0", params={"x": 600.0}, warp={"x": ([-1000.0, 0.0, 1000.0], [-1000.0, 500.0, 1000.0])}).fit(df)
    return gates.Gate.from_json(g.to_json()).predict(df).select("event_id", "population")


@query()
def strategy_normalised(spark, sf):
    """Each sample registered to the first one before its gate is applied, all in one plan."""
    df = cells(spark, sf)
    g = gates.ThresholdGate("g", "root", "c0", params={"x": 0.0}).fit(df)
    s = Strategy("s", [g])
    s.add_normalisation("g", "0")
    return s.applied_to_samples(df, normalise=True).groupBy("sample_id", "population").agg(F.count("*").alias("n"))


@query("""WITH {CELLS}, a AS (SELECT sample_id, quantile_cont(c0, 0.3) AS t FROM cells GROUP BY sample_id), hi AS (SELECT cells.* FROM cells JOIN a USING (sample_id) WHERE c0 >= t),
    b AS (SELECT sample_id, quantile_cont(c1, 0.5) AS u, quantile_cont(c2, 0.5) AS v FROM hi GROUP BY sample_id), pp AS (SELECT hi.* FROM hi JOIN b USING (sample_id) WHERE c1 >= u AND c2 >= v)
    SELECT sample_id, 'hi' AS population, count(*) AS n FROM hi GROUP BY ALL UNION ALL SELECT sample_id, 'pp', count(*) FROM pp GROUP BY ALL
    UNION ALL SELECT sample_id, 'not_pp', count(*) FROM (SELECT sample_id, event_id FROM hi EXCEPT SELECT sample_id, event_id FROM pp) GROUP BY ALL""")
def strategy_chain_per_sample(spark, sf):
    """A chain of gates, each fitted to every sample's own parent population, and a boolean gate over them, in one plan."""
    df = cells(spark, sf)
    first = gates.ThresholdGate("a", "root", "c0", method="quantile", params={"q": 0.3}, thresholds=(0.0, None), children=[gates.Child("hi", "+")])
    second = gates.ThresholdGate("b", "hi", "c1", "c2", method="quantile", params={"q": 0.5}, thresholds=(0.0, 0.0), children=[gates.Child("pp", "++")])
    rest = gates.BooleanGate("c", "hi", "c1", "c2", method="not", populations=["hi", "pp"], children=[gates.Child("not_pp")])
    return Strategy("s", [rest, second, first]).applied_to_samples(df).groupBy("sample_id", "population").agg(F.count("*").alias("n"))


@query("""WITH {CELLS}, q AS (SELECT sample_id, greatest(quantile_cont(c0, 0.7), quantile_cont(c0 + 100 * c1 / (1 + abs(c1)), 0.7)) AS t FROM cells GROUP BY sample_id)
    SELECT sample_id, count(*) AS n FROM cells JOIN q USING (sample_id) WHERE c0 >= t GROUP BY ALL""")
def strategy_controls_per_sample(spark, sf):
    """Every sample's threshold is the greater of its own and its control's."""
    df = cells(spark, sf)
    control = df.withColumn("c0", F.col("c0") + 100 * F.col("c1") / (1 + F.abs("c1")))
    g = gates.ThresholdGate("g", "root", "c0", method="quantile", params={"q": 0.7}, thresholds=(0.0, None), children=[gates.Child("hi", "+")])
    return Strategy("s", [g]).applied_to_samples(df, control=control).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("""WITH {CELLS}, q AS (SELECT sample_id, quantile_cont(c0, 0.7) AS t FROM cells GROUP BY sample_id) SELECT sample_id, CASE WHEN c0 >= t THEN '+' ELSE '-' END AS population, count(*) AS n FROM cells JOIN q USING (sample_id) GROUP BY ALL""")
def strategy_per_sample(spark, sf):
    """Gates fitted anew to every sample."""
    df = cells(spark, sf)
    g = gates.ThresholdGate("g", "root", "c0", method="quantile", params={"q": 0.7}).fit(df)
    return Strategy("s", [g]).applied_to_samples(df).groupBy("sample_id", "population").agg(F.count("*").alias("n"))


@query("WITH {CELLS}, q AS (SELECT event_id, asinh(c0 / 262144.0::DOUBLE * sinh(4.5::DOUBLE * ln(10::DOUBLE))) / (4.5::DOUBLE * ln(10::DOUBLE)) AS y FROM cells), t AS (SELECT quantile_cont(y, 0.6) AS t FROM q) SELECT round(sinh(t * 4.5::DOUBLE * ln(10::DOUBLE)) * 262144.0::DOUBLE / sinh(4.5::DOUBLE * ln(10::DOUBLE)), 4) AS x FROM t")
def gate_linear_threshold(spark, sf):
    """A threshold of a transformed axis, back on the axis' own scale."""
    g = gates.ThresholdGate("g", "root", "c0", transform_x="asinh", method="quantile", params={"q": 0.6}).fit(cells(spark, sf))
    return spark.createDataFrame([(round(g.to_linear(spark)[0], 4),)], "x double")


@query("WITH {CELLS} SELECT event_id, CASE WHEN c0 >= 0 AND c1 >= 0 AND c3 >= 0 THEN 'deep' ELSE 'hi' END AS layer FROM cells WHERE c0 >= 0")
def backgate_layers(spark, sf):
    cut = gates.ThresholdGate("a", "root", "c0", thresholds=(0.0, None), children=[gates.Child("hi", "+")])
    next_ = gates.ThresholdGate("b", "hi", "c1", thresholds=(0.0, None), children=[gates.Child("hihi", "+")])
    last = gates.ThresholdGate("c", "hihi", "c3", thresholds=(0.0, None), children=[gates.Child("deep", "+")])
    return Strategy("s", [cut, next_, last]).backgate(cells(spark, sf), "hi", "deep").select("event_id", "layer")


@query("WITH {CELLS} SELECT 'c0' AS axis, round(min(c0), 6) AS least, round(max(c0), 6) AS most FROM cells WHERE c0 > 0 UNION ALL SELECT 'c1', round(min(c1), 6), round(max(c1), 6) FROM cells")
def axis_limits_auto(spark, sf):
    return tables.axis_limits(cells(spark, sf), ["c0", "c1"], autoscale=True, positive=("c0",)).select("axis", r6("least"), r6("most"))


@query("WITH {CELLS}, l AS (SELECT 'c0' AS axis, min(c0) AS a, max(c0) AS b FROM cells WHERE c0 > 0) SELECT axis, round(log10(a), 6) AS least, round(log10(b), 6) AS most FROM l")
def axis_limits_transformed(spark, sf):
    limits = tables.axis_limits(cells(spark, sf), ["c0"], autoscale=True, positive=("c0",))
    return tables.transformed_limits(limits, {"c0": "log"}, {"c0": {"base": 10}}).select("axis", r6("least"), r6("most"))


@query(f"WITH {{CELLS}}, k AS (SELECT *, (event_id % 4)::INT AS cluster_label FROM cells), m AS (SELECT cluster_label, quantile_cont(c0, 0.5) AS a, quantile_cont(c1, 0.5) AS b FROM k GROUP BY ALL) SELECT cluster_label, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 6) AS c0, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS c1 FROM m")
def cluster_heatmap(spark, sf):
    return tables.heatmap(_clustered(spark, sf), ["c0", "c1"], "cluster_label").select("cluster_label", r6("c0"), r6("c1"))


@query("WITH {CELLS}, k AS (SELECT *, (event_id % 4)::INT AS cluster_label FROM cells), m AS (SELECT sample_id, cluster_label, quantile_cont(c0, 0.5) AS c0, count(*) AS n FROM k GROUP BY ALL) SELECT sample_id, cluster_label, round(c0, 6) AS c0, n, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM m")
def cluster_bubbles(spark, sf):
    return tables.bubbles(_clustered(spark, sf), ["c0"], embed=None).select("sample_id", "cluster_label", r6("c0"), "n", r6("share"))


@query("WITH {CELLS}, s AS (SELECT avg(c2) AS m, stddev_pop(c2) AS d FROM cells) SELECT event_id, round(c0, 6) AS x, round(c1, 6) AS y, round((c2 - m) / d, 6) AS label FROM cells, s ORDER BY md5(event_id::VARCHAR || ':0'), event_id LIMIT 100")
def scatter_table(spark, sf):
    return tables.scatter(cells(spark, sf), "c0", "c1", "c2", size=100, scale="zscore").select("event_id", r6("x"), r6("y"), r6("label"))


@query("WITH {CELLS}, k AS (SELECT *, (event_id % 3)::INT AS cluster_label FROM cells), d AS (SELECT a.event_id, a.cluster_label AS own, b.cluster_label AS other, sum(pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2)) AS s, count(*) AS n FROM k a, k b GROUP BY ALL), e AS (SELECT event_id, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own != other THEN s / n END) AS b FROM d GROUP BY event_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM e")
def silhouette(spark, sf):
    k = cells(spark, sf).withColumn("cluster_label", (F.col("event_id") % 3).cast("int"))
    return _one(spark, {"silhouette": clustering.silhouette(k, ["c0", "c1"])})


@query("WITH {CELLS}, m AS (SELECT sample_id, avg(c0) AS x, avg(c1) AS y, var_samp(c0) AS xx, var_samp(c1) AS yy, covar_samp(c0, c1) AS xy FROM cells GROUP BY sample_id) SELECT sample_id, round(6 * sqrt((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy)), 4) AS width, round(6 * sqrt((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy)), 4) AS height FROM m")
def component_ellipses(spark, sf):
    """Ellipses around each sample's scores; two features that are only centred keep their covariance's axes."""
    df = cells(spark, sf)
    p = features.PCA(["c0", "c1"], 2, scale=False).fit(df)
    return p.ellipses(df, "sample_id").select("sample_id", F.round("width", 4).alias("width"), F.round("height", 4).alias("height"))


@query(f"WITH {_POPS_SQL}, l AS (SELECT c.event_id, coalesce(max(CASE m.population WHEN 'deep' THEN 2 END), 0) AS label FROM cells c JOIN members h ON h.event_id = c.event_id AND h.sample_id = c.sample_id AND h.population = 'hi' LEFT JOIN members m ON m.event_id = c.event_id AND m.sample_id = c.sample_id AND m.population IN ('deep', 'hihi') GROUP BY ALL) SELECT label::INT AS label, count(*) AS n FROM l GROUP BY ALL")
def classifier_training_labels(spark, sf):
    """Labels below a root population, checked against the tree."""
    df, d, m = _pops(spark, sf)
    rows = classify.CellClassifier(["c0"]).training_data(df, m, P.tree_of(d), ["hihi", "deep"], "hi")
    return rows.withColumn("label", F.when(F.col("label") == 2, 2).otherwise(0)).groupBy("label").agg(F.count("*").alias("n"))


@query("WITH {CELLS}, l AS (SELECT event_id, (c0 + c1 >= 0)::INT AS label FROM cells), n AS (SELECT label, count(*) AS n FROM l GROUP BY ALL) SELECT label, least((SELECT max(n) FROM n), 1000000)::BIGINT AS n FROM n")
def control_training_rows(spark, sf):
    """Training rows of a control's classifier: both classes of equal size."""
    df = _labelled(spark, sf)
    rows = controls.training_rows(df.drop("label"), df.where("label = 1").select("event_id"), ["c0", "c1"], size=1_000_000)
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query()
def control_population(spark, sf):
    """A population of the primary staining, found in a control (here other samples)."""
    df = _labelled(spark, sf)
    primary, control = df.where("CAST(sample_id AS INT) < 5"), df.where("CAST(sample_id AS INT) >= 5")
    found = controls.control_population(primary, control.drop("label"), primary.where("label = 1").select("event_id"), features=["c0", "c1"], transform=None)
    return found.groupBy("sample_id").agg(F.count("*").alias("n"))


@query("WITH {CELLS}, a AS (SELECT 'hihi' AS population, avg(c0) AS c0 FROM cells) SELECT 'both' AS name, '++,+-' AS definition, round((SELECT avg(c0) FROM cells WHERE c1 >= 0) / 2 + (SELECT avg(c0) FROM cells WHERE c1 < 0) / 2, 6) AS c0 FROM a")
def merged_child(spark, sf):
    df = cells(spark, sf)
    means = gates.signatures(gates.ThresholdGate("g", "root", "c1", params={"x": 0}).fit(df).predict(df), ["c0"])
    child = gates.merge_children([gates.Child("a", "++", signature=means["+"]), gates.Child("b", "+-", signature=means["-"])], "both")
    return spark.createDataFrame([(child.name, child.definition, round(child.signature["c0"], 6))], "name string, definition string, c0 double")


_MARKER = """x AS (SELECT sample_id, 'COL' AS marker, COL AS v FROM cells), s AS (SELECT sample_id, count(*) AS n, min(v) AS a, max(v) AS b, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349) * pow(count(*), -0.2) AS h FROM x GROUP BY ALL),
    g AS (SELECT a - 3 * h AS lo, (b - a + 6 * h) / 63 AS step FROM s WHERE sample_id = '0'), near AS (SELECT sample_id, least(floor((v - lo) / step), 62) AS i, (v - lo) / step AS p FROM x, g WHERE v BETWEEN lo AND lo + 63 * step),
    bins AS (SELECT sample_id, i, sum(c) AS c FROM (SELECT sample_id, i, 1 - (p - i) AS c FROM near UNION ALL SELECT sample_id, i + 1, p - i FROM near) GROUP BY ALL)
    SELECT s.sample_id, 'COL' AS marker, j::INT AS j, round(10000 * sum(c * exp(-0.5 * pow((j - i) * step / h, 2))) / sum(c) / (any_value(h) * sqrt(2 * pi())), 5) AS density FROM s JOIN bins USING (sample_id), g, range(64) r(j) GROUP BY ALL"""


@query("WITH {CELLS}, m AS (WITH " + _MARKER.replace("COL", "c0") + "), k AS (WITH " + _MARKER.replace("COL", "c1") + ") SELECT * FROM m UNION ALL SELECT * FROM k")
def marker_densities(spark, sf):
    """Each marker's density in every sample at 64 points of the reference's range, times 10000."""
    got = batch.marker_variance(cells(spark, sf), "0", ["c0", "c1"], grid=64)
    place = F.row_number().over(Window.partitionBy("marker", "sample_id").orderBy("x")) - 1
    return got.select("sample_id", "marker", place.alias("j"), F.round(10000 * F.col("density"), 5).alias("density"))


_GRID_SQL = "r AS (SELECT min(c0) AS a, max(c0) AS b, min(c1) AS c, max(c1) AS d FROM cells), g AS (SELECT i, j, a + i * (b - a) / 11 AS x, c + j * (d - c) / 11 AS y FROM r, range(12) p(i), range(12) q(j))"


@query(f"WITH {{CELLS}}, {_GRID_SQL} SELECT sample_id, i::INT AS i, j::INT AS j, round(1e6 * avg(exp(-0.5 * (pow((c0 - x) / 400, 2) + pow((c1 - y) / 400, 2)))) / (2 * pi() * 400 * 400), 5) AS density FROM cells, g GROUP BY ALL")
def kernel_density_grid(spark, sf):
    """Two-dimensional kernel densities of every sample at the points of a grid; all events count at every point. Times a million."""
    df = cells(spark, sf)
    r = df.agg(F.min("c0").alias("a"), F.max("c0").alias("b"), F.min("c1").alias("c"), F.max("c1").alias("d")).head()
    found = batch.kernel_densities(df, ["c0", "c1"], [r.a, r.c], [r.b, r.d], 12, 400.0)
    return spark.createDataFrame([(s, i, j, round(1e6 * float(d[i, j]), 5)) for s, d in found.items() for i in range(12) for j in range(12)], "sample_id string, i int, j int, density double")


@query()
def similarity_by_kernel_density(spark, sf):
    """Divergences of all samples' kernel densities in the reference sample's kernel components."""
    m = batch.similarity_matrix(cells(spark, sf), "0", ["c0", "c1", "c2"], bins=32, kernel=True, reducer="kernel_pca", reducer_params={"kind": "rbf"})
    return spark.createDataFrame([(str(a), str(b), round(float(m.loc[a, b]), 6)) for a in m.index for b in m.columns], "a string, b string, jsd double")


@query()
def kernel_pca_space(spark, sf):
    """Every event in the kernel components of a landmark sample."""
    return embedding.reduced(cells(spark, sf), ["c0", "c1", "c2"], "kernel_pca", kind="rbf").select("event_id", r6("KernelPCA1"), r6("KernelPCA2"))


@query()
def diffusion_map(spark, sf):
    return embedding.reduced(cells(spark, sf), ["c0", "c1", "c2"], "diffusion", time=2).select("event_id", r6("Diffusion1"), r6("Diffusion2"))


@query("""WITH {CELLS}, m AS (SELECT avg(c0) AS a, avg(c1) AS b, stddev_pop(c0) AS p, stddev_pop(c1) AS q, sign(covar_pop(c0, c1)) AS s FROM cells WHERE sample_id = '0')
    SELECT event_id, sample_id = '0' AS is_reference, round(abs((c0 - a) / p + s * (c1 - b) / q) / sqrt(2::DOUBLE), 6) AS first, round(abs((c0 - a) / p - s * (c1 - b) / q) / sqrt(2::DOUBLE), 6) AS second FROM cells, m""")
def reference_space(spark, sf):
    """Every sample in the space of the reference sample's components: of two standardised features these are their sum and difference, so their sizes are known."""
    seen = batch.dim_reduction_grid(cells(spark, sf), "0", ["c0", "c1"])
    return seen.select("event_id", "is_reference", r6(F.abs("PCA1"), "first"), r6(F.abs("PCA2"), "second"))


@query()
def lisi_before_after(spark, sf):
    df = cells(spark, sf)
    fixed = batch.Harmony(["c0", "c1"], clusters=4, rounds=2).run(df)
    return batch.lisi_distribution(df, fixed, ["c0", "c1"]).groupBy("data").agg(F.count("*").alias("n"), r6(F.avg("lisi"), "mean"))


@query("SELECT event_id, (event_id // 64)::BIGINT AS chunk FROM events")
def chunks_of_events(spark, sf):
    return names.chunks(table(spark, sf, "events"), 64).select("event_id", "chunk")


@query("SELECT o.o_orderkey, o.o_orderstatus IS NOT DISTINCT FROM 'O' AS same FROM orders o")
def matched_pairs(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", names.matched(F.col("o_orderstatus"), F.lit(None).cast("string"), F.lit("O"), F.lit("")).alias("same"))


@query("WITH {CELLS}, n AS (SELECT max(abs(c0)) AS a, max(abs(c1)) AS b FROM cells) SELECT event_id, round(c0 / a, 6) AS n0, round(c1 / b, 6) AS n1, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM cells, n")
def normalise_columns_round_trip(spark, sf):
    """Normalised columns, and what comes back of them."""
    df = cells(spark, sf)
    norms = transforms.column_norms(df, ["c0", "c1"])
    there = transforms.normalise_columns(df, ["c0", "c1"]).withColumns({"n0": F.col("c0"), "n1": F.col("c1")})
    return transforms.denormalise_columns(there, norms).select("event_id", r6("n0"), r6("n1"), r6("c0"), r6("c1"))


@query("WITH {CELLS} SELECT event_id, round(CASE WHEN c0 >= 0 THEN (pow(c0 + 1, 0.7::DOUBLE) - 1) / 0.7 ELSE -(pow(1 - c0, 1.3::DOUBLE) - 1) / 1.3 END, 4) AS y0, round(c0, 4) AS c0 FROM cells")
def scale_power_round_trip(spark, sf):
    """Scaled values, and what comes back of them."""
    s = transforms.Scaler("yeo_johnson", stats={"c0": {"lambda": 0.7}})
    return s.inverse(s.transform(cells(spark, sf)).withColumn("y0", F.col("c0"))).select("event_id", F.round("y0", 4).alias("y0"), F.round("c0", 4).alias("c0"))


@query("WITH {CELLS}, t AS (SELECT quantile_cont(c0, 0.5) AS t FROM cells) SELECT event_id FROM cells, t WHERE c0 >= t")
def preview_gate(spark, sf):
    """A gate fitted on trial to all events; the strategy and the gate stay as they are."""
    df, s, gate = cells(spark, sf), Strategy("s", []), gates.ThresholdGate("g", "root", "c0", method="quantile", params={"q": 0.5})
    before = gate.to_json()
    trial = s.preview(gate, df)
    if s.gates or gate.to_json() != before:
        raise AssertionError("a preview has changed the strategy or the gate")
    return trial.predict(df).where("population = '+'").select("event_id")


@query("WITH {CELLS}, l AS (SELECT event_id, c0, c1, row_number() OVER (ORDER BY md5(event_id::VARCHAR || ':0'), event_id) AS r FROM cells) SELECT event_id FROM l WHERE r <= 60 AND c0 >= (SELECT quantile_cont(c0, 0.5) FROM l WHERE r <= 60)")
def gate_downsampled(spark, sf):
    """A gate fitted on a sample of 60 events."""
    df = cells(spark, sf)
    g = gates.ThresholdGate("g", "root", "c0", method="quantile", params={"q": 0.5}, sampling={"method": "uniform", "size": 60}).fit(df)
    return g.predict(sampling.uniform(df, 60)).where("population = '+'").select("event_id")


@query("WITH {CELLS}, p AS (SELECT event_id, CASE WHEN c1 >= 0 THEN 'up' ELSE 'down' END AS layer FROM cells WHERE c0 > 0) SELECT layer, count(*) AS n FROM p GROUP BY ALL")
def overlay_counts(spark, sf):
    df = cells(spark, sf).where("c0 > 0")
    return tables.overlay({"up": df.where("c1 >= 0"), "down": df.where("c1 < 0")}, ["event_id"]).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"SELECT 'A' AS child, unnest(range({len(POLYGON)}))::INT AS i, unnest([{', '.join(_lit(x) for x, _ in POLYGON)}]) AS x, unnest([{', '.join(_lit(y) for _, y in POLYGON)}]) AS y")
def gate_shapes(spark, sf):
    df = cells(spark, sf)
    g = gates.PolygonGate("g", "root", "c0", "c1", params={"x_values": [p[0] for p in POLYGON], "y_values": [p[1] for p in POLYGON]}).fit(df)
    return tables.shapes(g, df)


@query("WITH {CELLS} SELECT sample_id, round((max(c0) - min(c0)) * (max(c1) - min(c1)), 3) AS area FROM cells GROUP BY ALL")
def polygon_area(spark, sf):
    """The area of the box around each sample's events."""
    return spark.createDataFrame([(s, round(geometry.area(box), 3)) for s, box in boxes(spark, sf).items()], "sample_id string, area double")
