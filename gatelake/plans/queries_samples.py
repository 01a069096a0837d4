"""Queries on samples: summaries, features, tests, names, metadata, clusters, batches, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import density
from ..operators import batch, classify, clustering, features, gates, names, sampling
from ..operators import populations as P
from ..sources.project import control_counts as counts_of_controls
from ..sources.project import samples_of_subjects, with_subject
from .registry import CHANNELS, cells, query, r6, table

COLS = [f"c{i}" for i in range(CHANNELS)]


def _one(spark, row: dict):
    """A result of a test as a row; statistics only have six decimals that two engines share."""
    return spark.createDataFrame([tuple(round(float(v), 6) for v in row.values())], ", ".join(f"{k} double" for k in row))


# --- names and metadata

@query("""WITH p AS (SELECT p_partkey, p_brand, p_type FROM part), m AS (SELECT p_partkey, p_type, (regexp_matches(p_type, 'steel', 'i'))::INT AS s, (regexp_matches(p_type, 'brass', 'i'))::INT AS b, (regexp_matches(p_type, '^promo', 'i'))::INT AS x FROM p)
    SELECT p_partkey, s + b + x AS name_matches, CASE WHEN s + b + x = 1 THEN CASE WHEN s = 1 THEN 'Steel' WHEN b = 1 THEN 'Brass' ELSE 'Promo' END END AS name FROM m""")
def normalise_names_regex(spark, sf):
    rules = [names.NameRule("Steel", "steel"), names.NameRule("Brass", "brass"), names.NameRule("Promo", "^promo")]
    return names.normalise(table(spark, sf, "part"), "p_type", rules, "name").select("p_partkey", "name_matches", "name")


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE trim(p_name) != '' GROUP BY p_name HAVING count(*) > 1")
def duplicate_mappings(spark, sf):
    return names.duplicates(table(spark, sf, "part").select(F.col("p_name").alias("name")), "name")


@query("SELECT c_custkey AS channel FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_channels_anti(spark, sf):
    expected, found = table(spark, sf, "customer").select(F.col("c_custkey").alias("channel")), table(spark, sf, "orders").select(F.col("o_custkey").alias("channel"))
    return names.missing_channels(expected, found)


@query("SELECT DISTINCT o_orderstatus AS channel, o_orderpriority AS marker FROM orders WHERE (o_orderstatus, o_orderpriority) IN (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 400000)")
def pairing_semi(spark, sf):
    o = table(spark, sf, "orders")
    pairs = lambda df: df.select(F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("marker")).distinct()
    return names.paired(pairs(o), pairs(o.where("o_totalprice > 400000")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_meta_field(spark, sf):
    return features.meta_field(table(spark, sf, "events"), "props", "$.k", "k").select("event_id", F.col("k").cast("int").alias("k"))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def subject_lookup(spark, sf):
    return with_subject(table(spark, sf, "orders"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", ["c_mktsegment"]).select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
def samples_by_subject(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    subjects = n.join(r, n.n_regionkey == r.r_regionkey).withColumnRenamed("n_nationkey", "c_nationkey")
    return samples_of_subjects(table(spark, sf, "customer"), subjects, F.col("r_name") == "EUROPE", "c_nationkey").select("c_custkey")


@query("SELECT event_type AS control, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM events")
def control_counts(spark, sf):
    e = table(spark, sf, "events")
    return counts_of_controls(e.select(F.col("event_type").alias("control")), e.count())


# --- summaries

_CLUSTERED = "{CELLS}, k AS (SELECT *, (event_id % 4)::INT AS cluster_label FROM cells)"


def _clustered(spark, sf):
    return cells(spark, sf).withColumn("cluster_label", (F.col("event_id") % 4).cast("int"))


@query(f"WITH {_CLUSTERED} SELECT sample_id, cluster_label, round(quantile_cont(c0, 0.5), 6) AS c0, round(quantile_cont(c1, 0.5), 6) AS c1 FROM k GROUP BY ALL")
def cluster_summary_median(spark, sf):
    return clustering.summarise(_clustered(spark, sf), ["c0", "c1"]).select("sample_id", "cluster_label", r6("c0"), r6("c1"))


@query(f"WITH {_CLUSTERED}, s AS (SELECT sample_id, cluster_label, avg(c0) AS c0 FROM k GROUP BY ALL) SELECT sample_id, cluster_label, round((c0 - avg(c0) OVER ()) / stddev_pop(c0) OVER (), 6) AS c0 FROM s")
def cluster_summary_mean_scaled(spark, sf):
    from ..functions.transforms import Scaler

    s = clustering.summarise(_clustered(spark, sf), ["c0"], "mean")
    return Scaler().fit(s, ["c0"]).transform(s).select("sample_id", "cluster_label", r6("c0"))


@query(f"WITH {_CLUSTERED}, n AS (SELECT sample_id, cluster_label, count(*) AS n FROM k GROUP BY ALL) SELECT sample_id, cluster_label, n, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM n")
def cluster_sizes(spark, sf):
    return clustering.sizes(_clustered(spark, sf)).select("sample_id", "cluster_label", "n", r6("share"))


@query(f"WITH {_CLUSTERED} SELECT event_id, CASE WHEN cluster_label < 2 THEN 0 ELSE 1 END AS meta_label FROM k")
def meta_label_join(spark, sf):
    k = _clustered(spark, sf).withColumn("meta_label", F.lit(None).cast("int"))
    meta = k.select("sample_id", "cluster_label").distinct().withColumn("meta_label", F.when(F.col("cluster_label") < 2, 0).otherwise(1))
    return clustering.assign_meta(k, meta).select("event_id", "meta_label")


@query(f"WITH {_CLUSTERED} SELECT event_id, CASE cluster_label WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE cluster_label::VARCHAR END AS cluster_label FROM k")
def cluster_rename(spark, sf):
    return clustering.rename(_clustered(spark, sf), {0: "a", 1: "b"}, "cluster_label").select("event_id", "cluster_label")


@query("WITH v AS (SELECT var_samp(l_quantity) AS q, var_samp(l_extendedprice) AS e, var_samp(l_discount) AS d, var_samp(l_tax) AS t FROM lineitem) SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS variable, round(unnest([q, e, d, t]), 4) AS variance FROM v")
def sort_variance(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return features.variance_order(li, []).select("variable", F.round("variance", 4).alias("variance"))


_DESC_SQL = """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd, quantile_cont(l_quantity, 0.5) AS median, exp(avg(ln(l_quantity))) AS gmean,
    avg(pow(l_quantity, 2)) AS m2, avg(pow(l_quantity, 3)) AS m3, avg(pow(l_quantity, 4)) AS m4 FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, round(mean, 6) AS mean, round(sd, 6) AS "SD", round(median, 6) AS median, round(sd / mean, 6) AS "CV",
      round((m3 - 3 * mean * m2 + 2 * pow(mean, 3)) / pow(sd, 3), 6) AS skew, round((m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * pow(mean, 4)) / pow(sd, 4) - 3, 6) AS kurtosis, round(gmean, 6) AS gmean FROM m"""


@query(_DESC_SQL)
def channel_desc_stats(spark, sf):
    d = features.describe(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    return d.select("l_returnflag", *[r6(c) for c in features.DESCRIBE])


def _stats(spark, sf):
    df = cells(spark, sf)
    d = {"hi": ("root", F.col("c0") >= 0), "hihi": ("hi", F.col("c1") >= 0), "lo": ("root", F.col("c0") < 300)}
    tree = spark.createDataFrame(P.tree_of(d), "population string, parent string")
    return P.stats(P.gated(df, d), tree, df.groupBy("sample_id").agg(F.count("*").alias("n")))


_COUNTS = "{CELLS}, n AS (SELECT sample_id, count(*) AS root, count(*) FILTER (WHERE c0 >= 0) AS hi, count(*) FILTER (WHERE c0 >= 0 AND c1 >= 0) AS hihi, count(*) FILTER (WHERE c0 < 300) AS lo FROM cells GROUP BY sample_id)"


@query(f"WITH {_COUNTS} SELECT sample_id, 'hihi:lo' AS ratio, round(hihi / nullif(lo, 0), 6) AS value FROM n")
def pop_ratios(spark, sf):
    return features.ratios(_stats(spark, sf), "hihi", "lo").select("sample_id", "ratio", r6("value"))


@query(f"""WITH {_COUNTS} SELECT sample_id, hi AS "hi_N", round(hi / root, 6) AS "hi_FOR", round(hi / root, 6) AS "hi_FOP", hihi AS "hihi_N", round(hihi / root, 6) AS "hihi_FOR", round(coalesce(hihi / nullif(hi, 0), 0), 6) AS "hihi_FOP" FROM n""")
def feature_pivot(spark, sf):
    t = features.feature_table(_stats(spark, sf), ["hi", "hihi"])
    return t.select("sample_id", *[r6(c) if c.endswith(("FOR", "FOP")) else c for c in t.columns if c != "sample_id"])


@query("WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY ALL) SELECT toxic, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n")
def class_weights(spark, sf):
    return classify.class_weights(table(spark, sf, "labels"), "toxic").select("toxic", "n", r6("weight"))


@query("WITH n AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL) SELECT quality, toxic, n, round(n / sum(n) OVER (PARTITION BY quality), 6) AS share FROM n")
def confusion_matrix(spark, sf):
    return classify.confusion(table(spark, sf, "labels"), "quality", "toxic").select("quality", "toxic", "n", r6("share"))


_SCORES = """WITH c AS (SELECT unnest([0, 1]) AS k), s AS (SELECT k, count(*) FILTER (WHERE quality = k AND toxic = k) AS tp, count(*) FILTER (WHERE quality = k) AS actual, count(*) FILTER (WHERE toxic = k) AS said FROM labels, c GROUP BY k)"""


@query(f"{_SCORES} SELECT round(avg(tp / actual), 6) AS balanced_accuracy, round(sum(2 * tp / (actual + said) * actual) / sum(actual), 6) AS f1_weighted FROM s")
def classifier_scores(spark, sf):
    return _one(spark, classify.metrics(table(spark, sf, "labels"), "quality", "toxic", ("balanced_accuracy", "f1_weighted")))


@query("""WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT count(*) AS n, sum(quality) AS p, sum(r * quality) AS s FROM r) SELECT round((s - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM s""")
def roc_auc(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return _one(spark, {"auc": classify.roc_auc(d, "quality", "n_chars")})


@query("WITH {CELLS} " + " UNION ALL ".join(f"SELECT 'c{i}' AS feature_a, 'c{j}' AS feature_b, round(corr(c{i}, c{j}), 6) AS r FROM cells" for i in range(3) for j in range(i, 3)))
def corr_pearson(spark, sf):
    return features.correlation(cells(spark, sf), ["c0", "c1", "c2"]).select("feature_a", "feature_b", r6("r"))


@query("WITH {CELLS}, k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY c{i}) + (count(*) OVER (PARTITION BY c{i}) - 1) / 2 AS r{i}" for i in range(3)) + " FROM cells) " + " UNION ALL ".join(f"SELECT 'c{i}' AS feature_a, 'c{j}' AS feature_b, round(corr(r{i}, r{j}), 6) AS r FROM k" for i in range(3) for j in range(i, 3)))
def corr_spearman(spark, sf):
    return features.correlation(cells(spark, sf), ["c0", "c1", "c2"], "spearman").select("feature_a", "feature_b", r6("r"))


# --- tests

_GROUPS = "g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g)"


@query(f"WITH {_GROUPS} SELECT round((sum(g.n * pow(g.m - t.m, 2)) / (any_value(t.k) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - any_value(t.k))), 6) AS f, (any_value(t.k) - 1)::DOUBLE AS df1, (any_value(t.n) - any_value(t.k))::DOUBLE AS df2 FROM g, t")
def anova_f(spark, sf):
    a = features.anova(table(spark, sf, "events"), "event_type", "value")
    return _one(spark, {"f": a["F"], "df1": a["df1"], "df2": a["df2"]})


@query("WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type), a AS (SELECT * FROM g WHERE event_type = 'click'), b AS (SELECT * FROM g WHERE event_type = 'view') SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 6) AS df FROM a, b")
def welch_t(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    t = features.t_test(e, "event_type", "value")
    return _one(spark, {"t": t["t"], "df": t["df"]})


_RANKS = "r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM e), ties AS (SELECT sum(k * k * k - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM e GROUP BY value))"


@query(f"WITH e AS (SELECT event_type, value FROM events), {_RANKS}, g AS (SELECT event_type, count(*) AS k, sum(r) AS s FROM r GROUP BY event_type) SELECT round((12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / k) - 3 * (any_value(n) + 1)) / (1 - any_value(t) / (pow(any_value(n), 3) - any_value(n))), 6) AS h FROM g, n, ties")
def kruskal_h(spark, sf):
    return _one(spark, {"h": features.kruskal(table(spark, sf, "events"), "event_type", "value")["H"]})


@query(f"WITH e AS (SELECT event_type, value FROM events WHERE event_type IN ('click', 'view')), {_RANKS} SELECT round(sum(r) - count(*) * (count(*) + 1) / 2, 6) AS u FROM r WHERE event_type = 'click'")
def mannwhitney_u(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    return _one(spark, {"u": features.mann_whitney(e, "event_type", "value")["U"]})


@query("SELECT event_type, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max FROM events GROUP BY event_type")
def box_plot_table(spark, sf):
    return features.five_numbers(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", *[r6(c) for c in ("min", "q1", "median", "q3", "max")])


@query("""WITH {CELLS}, b AS (SELECT 1 + floor((c0 + 2000) / 100.0)::BIGINT AS bx, 1 + floor((c1 + 2000) / 100.0)::BIGINT AS "by" FROM cells WHERE c0 >= (-2000) AND c0 < 2000 AND c1 >= (-2000) AND c1 < 2000) SELECT bx, "by", count(*) AS n FROM b GROUP BY ALL""")
def hist2d(spark, sf):
    return features.histogram2d(cells(spark, sf), "c0", "c1", 40, (-2000, 2000), (-2000, 2000))


@query("WITH q AS (SELECT quantile_cont(value, [" + ", ".join(f"{(i + 0.5) / 20}" for i in range(20)) + "]) AS q FROM events) SELECT (generate_subscripts(q, 1) - 1)::INT AS i, round(unnest(q), 6) AS quantile FROM q")
def qq_plot_table(spark, sf):
    return features.qq_table(table(spark, sf, "events"), "value", 20).select("i", r6("quantile"))


# --- batches

_COV = "{CELLS}, v AS (SELECT sample_id, [" + ", ".join(f"covar_samp(c{i}, c{j})" for i in range(3) for j in range(3)) + "] AS cov FROM cells GROUP BY sample_id), d AS (SELECT a.sample_id AS a, b.sample_id AS b, sqrt(list_sum(list_transform(range(1, 10), lambda i: pow(a.cov[i] - b.cov[i], 2)))) AS distance FROM v a, v b)"


@query(f"WITH {_COV} SELECT a, b, round(distance, 4) AS distance FROM d")
def cov_distances(spark, sf):
    return batch.covariance_distances(cells(spark, sf), ["c0", "c1", "c2"]).select("a", "b", F.round("distance", 4).alias("distance"))


@query(f"WITH {_COV} SELECT a AS sample_id, round(avg(distance), 4) AS mean_distance FROM d GROUP BY a ORDER BY avg(distance), a LIMIT 1")
def cov_reference_sample(spark, sf):
    return batch.reference_sample(cells(spark, sf), ["c0", "c1", "c2"]).select("sample_id", F.round("mean_distance", 4).alias("mean_distance"))


@query("""WITH {CELLS}, h AS (SELECT sample_id, least(floor((c0 + 2000) / 500.0), 7) AS b, count(*) AS n FROM cells WHERE c0 BETWEEN (-2000) AND 2000 GROUP BY ALL),
    t AS (SELECT sample_id, sum(n) AS n FROM h GROUP BY ALL), g AS (SELECT t.sample_id, b, coalesce(h.n, 0) / t.n AS p FROM t CROSS JOIN range(8) r(b) LEFT JOIN h USING (sample_id, b))
    SELECT x.sample_id AS a, y.sample_id AS b, round(sqrt(greatest(sum(CASE WHEN x.p > 0 THEN x.p * ln(x.p / ((x.p + y.p) / 2)) ELSE 0 END + CASE WHEN y.p > 0 THEN y.p * ln(y.p / ((x.p + y.p) / 2)) ELSE 0 END) / 2, 0)), 5) AS jsd
    FROM g x JOIN g y ON x.b = y.b GROUP BY ALL""")
def jsd_pairs(spark, sf):
    return batch.divergences(cells(spark, sf), "c0", -2000, 2000, 8).select("a", "b", F.round("jsd", 5).alias("jsd"))


_CLUSTER_MOMENTS = "{CELLS}, m AS (SELECT sample_id, count(*) AS n, avg(c0) AS m0, avg(c1) AS m1, var_pop(c0) + var_pop(c1) AS v FROM cells GROUP BY ALL)"


@query(f"WITH {_CLUSTER_MOMENTS}, o AS (SELECT sum(n * m0) / sum(n) AS o0, sum(n * m1) / sum(n) AS o1, sum(n) AS total, count(*) AS k FROM m) SELECT round((sum(n * (pow(m0 - o0, 2) + pow(m1 - o1, 2))) / (any_value(k) - 1)) / (sum(n * v) / (any_value(total) - any_value(k))), 6) AS calinski_harabasz FROM m, o")
def calinski_harabasz(spark, sf):
    return _one(spark, {"calinski_harabasz": clustering.performance(cells(spark, sf), ["c0", "c1"], "sample_id")["calinski_harabasz"]})


@query(f"WITH {_CLUSTER_MOMENTS}, s AS (SELECT sample_id, m0, m1, avg(sqrt(pow(c0 - m0, 2) + pow(c1 - m1, 2))) AS s FROM cells JOIN m USING (sample_id) GROUP BY ALL), p AS (SELECT a.sample_id, max((a.s + b.s) / sqrt(pow(a.m0 - b.m0, 2) + pow(a.m1 - b.m1, 2))) AS r FROM s a JOIN s b ON a.sample_id != b.sample_id GROUP BY a.sample_id) SELECT round(avg(r), 4) AS davies_bouldin FROM p")
def davies_bouldin(spark, sf):
    value = clustering.performance(cells(spark, sf), ["c0", "c1"], "sample_id")["davies_bouldin"]
    return spark.createDataFrame([(round(value, 4),)], "davies_bouldin double")


# --- iterative operators: compared with independent implementations in tests

@query()
def gate_density_1d(spark, sf):
    df = table(spark, sf, "events")
    g = gates.ThresholdGate("g", "root", "value", method="density").fit(df)
    return g.predict(df).groupBy("population").agg(F.count("*").alias("n"))


@query()
def gate_density_2d(spark, sf):
    df = cells(spark, sf)
    g = gates.ThresholdGate("g", "root", "c0", "c1", method="density").fit(df)
    return g.predict(df).groupBy("sample_id", "population").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
    h AS (SELECT *, 0.9 * least(sd, iqr / 1.349) * pow(n, -0.2::DOUBLE) AS h FROM s), g AS (SELECT lo - 3 * h AS a, h, n, (hi - lo + 6 * h) / 255 AS step FROM h),
    b AS (SELECT least(floor((value - a) / step), 254) AS c, (value - a) / step AS p FROM events, g), k AS (SELECT c AS i, sum(1 - (p - c)) AS w FROM b GROUP BY c UNION ALL SELECT c + 1, sum(p - c) FROM b GROUP BY c),
    w AS (SELECT i, sum(w) AS w FROM k GROUP BY i)
    SELECT round(a + r.i * step, 6) AS x, round(sum(w * exp(-0.5 * pow((r.i - w.i) * step / h, 2))) / (h * sqrt(2 * pi())) / n, 8) AS density FROM range(256) r(i), w, g GROUP BY r.i, a, step, h, n""")
def kde_density(spark, sf):
    d = density.kde(table(spark, sf, "events"), "value", grid=256)
    return spark.createDataFrame([(round(float(x), 6), round(float(p), 8)) for x, p in zip(d.x, d.p, strict=True)], "x double, density double")


@query()
def gmm_gate(spark, sf):
    df = cells(spark, sf)
    g = gates.EllipseGate("g", "root", "c0", "c1", method="gmm", params={"k": 2, "conf": 0.9}).fit(df)
    return g.predict(df).groupBy("population").agg(F.count("*").alias("n"))


@query()
def polygon_kmeans_gate(spark, sf):
    df = cells(spark, sf)
    g = gates.PolygonGate("g", "root", "c0", "c1", method="kmeans", params={"k": 3}).fit(df)
    return g.predict(df).groupBy("population").agg(F.count("*").alias("n"))


@query()
def kmeans_clusters(spark, sf):
    return clustering.global_clusters(cells(spark, sf), COLS, "kmeans", 5).groupBy("cluster_label").agg(F.count("*").alias("n"))


_ROUNDS = 5
_LLOYD = "{CELLS}, p AS (SELECT sample_id, event_id, c0 AS x, c1 AS y FROM cells), z0 AS (SELECT sample_id, c, x, y FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5(event_id::VARCHAR || ':42'), event_id) - 1 AS c FROM p) WHERE c < 3)" + "".join(
    f", a{i} AS (SELECT p.sample_id, p.event_id, p.x, p.y, arg_min(z.c, pow(p.x - z.x, 2) + pow(p.y - z.y, 2)) AS c FROM p JOIN z{i} z USING (sample_id) GROUP BY ALL), z{i + 1} AS (SELECT z.sample_id, z.c, coalesce(avg(a.x), any_value(z.x)) AS x, coalesce(avg(a.y), any_value(z.y)) AS y FROM z{i} z LEFT JOIN a{i} a USING (sample_id, c) GROUP BY ALL)" for i in range(_ROUNDS))


@query(f"WITH {_LLOYD}, f AS (SELECT p.sample_id, p.event_id, arg_min(z.c, pow(p.x - z.x, 2) + pow(p.y - z.y, 2))::INT AS cluster_label FROM p JOIN z{_ROUNDS} z USING (sample_id) GROUP BY ALL), n AS (SELECT sample_id, cluster_label, count(*) AS n FROM f GROUP BY ALL) SELECT sample_id, cluster_label, n, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM n")
def kmeans_per_sample(spark, sf):
    return clustering.sizes(clustering.sample_clusters(cells(spark, sf), ["c0", "c1"], 3, rounds=_ROUNDS)).select("sample_id", "cluster_label", "n", r6("share"))


@query()
def consensus_meta(spark, sf):
    k = _clustered(spark, sf).withColumn("meta_label", F.lit(None).cast("int"))
    return clustering.meta_clusters(k, COLS).groupBy("meta_label").agg(F.count("*").alias("n"))


@query()
def som_labels(spark, sf):
    df = cells(spark, sf)
    return clustering.SOM(COLS, (5, 5)).fit(df).meta_cluster(4).predict(df).groupBy("sample_id", "cluster_label").agg(F.count("*").alias("n"))


@query()
def graph_communities(spark, sf):
    return clustering.graph_clusters(cells(spark, sf), COLS, 15).groupBy("cluster_label").agg(F.count("*").alias("n"))


@query()
def pca_embed(spark, sf):
    df = cells(spark, sf)
    return features.PCA(COLS, 2).fit(df).transform(df).select("event_id", r6("PCA1"), r6("PCA2"))


@query()
def sample_similarity(spark, sf):
    m = batch.similarity_matrix(cells(spark, sf), "0", COLS)
    groups = clustering.linkage_groups(m.to_numpy(), [str(x) for x in m.index], 3)
    return spark.createDataFrame(groups, "sample_id string, group int")


@query()
def harmony_correct(spark, sf):
    return batch.Harmony(COLS, clusters=5, rounds=3).run(cells(spark, sf)).select("event_id", "sample_id", r6("c0"))


@query("""WITH {CELLS}, d AS (SELECT a.event_id, b.sample_id, row_number() OVER (PARTITION BY a.event_id ORDER BY pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2)) AS r FROM cells a, cells b),
    n AS (SELECT event_id, sample_id, count(*) AS n FROM d WHERE r <= 30 GROUP BY ALL), t AS (SELECT event_id, sum(n) AS t FROM n GROUP BY event_id) SELECT event_id, round(1 / sum(pow(n / t, 2)), 6) AS lisi FROM n JOIN t USING (event_id) GROUP BY event_id""")
def lisi(spark, sf):
    return batch.lisi(cells(spark, sf), ["c0", "c1"]).select("event_id", r6("lisi"))


@query()
def landmark_warp(spark, sf):
    e = table(spark, sf, "events")
    return batch.register(e.where("event_type = 'click'"), "value", e.where("event_type = 'view'"), to="warped").select("event_id", r6("warped"))


@query("""WITH {CELLS}, t AS (SELECT * FROM cells WHERE ('0x' || substr(md5(event_id::VARCHAR || ':1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3::DOUBLE),
    n AS (SELECT a.event_id, abs(a.c0 - b.c0) + abs(a.c1 - b.c1) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.c0 - b.c0) + abs(a.c1 - b.c1)) AS r FROM t a, t b),
    rad AS (SELECT 5 * median(d) AS r FROM n WHERE r = 2), k AS (SELECT c.event_id, count(*) FILTER (WHERE abs(c.c0 - t.c0) + abs(c.c1 - t.c1) <= rad.r)::DOUBLE AS k FROM cells c, t, rad GROUP BY c.event_id),
    q AS (SELECT quantile_cont(k, 0.01) AS od, quantile_cont(k, 0.05) AS td FROM k), w AS (SELECT event_id, CASE WHEN k <= od THEN 0 WHEN k <= td THEN 1 ELSE td / k END AS w FROM k, q)
    SELECT event_id FROM w WHERE w > 0 ORDER BY -ln((('0x' || substr(md5(event_id::VARCHAR || ':0'), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE) / w, event_id LIMIT 100""")
def density_downsample(spark, sf):
    return sampling.density_downsample(cells(spark, sf), ["c0", "c1"], 100, tree_fraction=0.3).select("event_id")


def _labelled(spark, sf):
    return cells(spark, sf).withColumn("label", (F.col("c0") + F.col("c1") >= 0).cast("int"))


@query()
def classify_logistic(spark, sf):
    train, test = classify.split(_labelled(spark, sf), 0.3)
    done = classify.CellClassifier(COLS, balanced=True).fit(train).predict(test)
    return _one(spark, classify.metrics(done, "label", "predicted"))


@query()
def classify_cv(spark, sf):
    scores = classify.CellClassifier(COLS).cross_validate(_labelled(spark, sf), 3)
    return spark.createDataFrame([(i, *[round(float(v), 6) for v in s.values()]) for i, s in enumerate(scores)], "fold int, balanced_accuracy double, f1_weighted double")


@query()
def logistic_l1_path(spark, sf):
    return classify.l1_path(_labelled(spark, sf), COLS, "label", [0.3, 0.03, 0.003])


@query()
def tree_importance(spark, sf):
    model = classify.CellClassifier(COLS, kind="decision_tree", scale=None).fit(_labelled(spark, sf))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in model.importance().items()], "feature string, importance double")


@query()
def permutation_importance(spark, sf):
    df = _labelled(spark, sf)
    model = classify.CellClassifier(COLS[:3]).fit(df)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in model.permutation_importance(df).items()], "feature string, fall double")


@query()
def minimum_spanning_tree(spark, sf):
    c = clustering.summarise(_clustered(spark, sf), ["c0", "c1"]).orderBy("sample_id", "cluster_label").toPandas()  # a row for each sample and cluster
    return spark.createDataFrame([(a, b, round(w, 6)) for a, b, w in clustering.minimum_spanning_tree(c[["c0", "c1"]].to_numpy())], "a int, b int, length double")
