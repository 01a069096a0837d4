"""Queries on neighbours, graphs, clusters of any shape, and samples by density and cover. Each measures all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, gates, graph, sampling, space
from .registry import cells, query, r6

COLS = ["c0", "c1", "c2"]
_D3 = "sqrt(pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2) + pow(a.c2 - b.c2, 2))"
_D2 = "sqrt(pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2))"
_NEAR = f"""near AS (SELECT * FROM (SELECT a.event_id AS id, b.event_id AS other, {_D3} AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY {_D3}, b.event_id) AS r
    FROM cells a JOIN cells b ON a.event_id <> b.event_id WHERE SAME) WHERE r <= K)"""
_GRAPH = """sets AS (SELECT id, list(other) AS s FROM near GROUP BY id), pairs AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM near),
    graph AS (SELECT a, b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS w FROM pairs JOIN sets x ON x.id = a JOIN sets y ON y.id = b WHERE len(list_intersect(x.s, y.s)) > 0)"""


@query(f"WITH {{CELLS}}, {_NEAR.replace('WHERE SAME', '').replace('r <= K', 'r <= 5')} SELECT id AS event_id, r::INT AS rank, other, round(d, 6) AS d FROM near")
def nearest_neighbours(spark, sf):
    """The five nearest events of every event, over all samples."""
    near = space.nearest(cells(spark, sf), COLS, 5)
    return near.select(F.col("id").alias("event_id"), F.posexplode("near").alias("i", "n")).select("event_id", (F.col("i") + 1).alias("rank"), F.col("n.id").alias("other"), r6(F.col("n.d"), "d"))


@query(f"WITH {{CELLS}}, {_NEAR.replace('SAME', 'a.sample_id = b.sample_id').replace('r <= K', 'r <= 3')} SELECT id AS event_id, r::INT AS rank, other, round(d, 6) AS d FROM near")
def nearest_in_sample(spark, sf):
    """The three nearest events of the same sample, all samples in one plan."""
    near = space.nearest(cells(spark, sf), COLS, 3, by="sample_id")
    return near.select(F.col("id").alias("event_id"), F.posexplode("near").alias("i", "n")).select("event_id", (F.col("i") + 1).alias("rank"), F.col("n.id").alias("other"), r6(F.col("n.d"), "d"))


@query(f"WITH {{CELLS}}, {_NEAR.replace('WHERE SAME', '').replace('r <= K', 'r <= 10')}, {_GRAPH} SELECT a, b, round(w, 6) AS w FROM graph")
def neighbour_graph(spark, sf):
    return graph.neighbour_graph(cells(spark, sf), COLS, 10).select("a", "b", r6("w"))


@query(f"""WITH {{CELLS}}, {_NEAR.replace('WHERE SAME', '').replace('r <= K', 'r <= 10')}, {_GRAPH}, e AS (SELECT x.sample_id AS p, y.sample_id AS q, w FROM graph JOIN cells x ON x.event_id = a JOIN cells y ON y.event_id = b),
    m AS (SELECT c, sum(w) AS mass, sum(i) AS inside FROM (SELECT p AS c, w, CASE WHEN p = q THEN w ELSE 0 END AS i FROM e UNION ALL SELECT q, w, 0 FROM e) GROUP BY c)
    SELECT round(2 * sum(inside) / sum(mass) - sum(mass * mass) / pow(sum(mass), 2), 6) AS modularity FROM m""")
def graph_modularity(spark, sf):
    """How far samples are communities of the neighbour graph."""
    df = cells(spark, sf)
    value = graph.modularity(graph.neighbour_graph(df, COLS, 10), df.select(F.col("event_id").alias("id"), F.col("sample_id").alias("community")))
    return spark.createDataFrame([(round(value, 6),)], "modularity double")


@query()
def graph_per_sample(spark, sf):
    """Communities of each sample's own neighbour graph, all samples in one plan."""
    found = clustering.graph_clusters(cells(spark, sf), COLS, 10, by="sample_id")
    return found.groupBy("sample_id", "cluster_label").agg(F.count("*").alias("n"))


def _dbscan_sql(eps: float, least: int, same: str) -> str:
    """event_id, core place (smallest id of the cluster's cores), or null."""
    return f"""{{CELLS}}, near AS (SELECT a.sample_id, a.event_id AS a, b.event_id AS b, {_D2} AS d FROM cells a JOIN cells b ON {_D2} <= {eps}{same}),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {least}), edge AS (SELECT a, b FROM near JOIN core x ON x.id = a JOIN core y ON y.id = b),
    reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b), comp AS (SELECT a AS id, min(b) AS comp FROM reach GROUP BY a),
    label AS (SELECT c.sample_id, c.event_id, first(comp ORDER BY d, n.b) AS comp FROM cells c LEFT JOIN (near n JOIN comp ON comp.id = n.b) ON n.a = c.event_id GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_dbscan_sql(250.0, 4, '')} SELECT event_id, (CASE WHEN comp IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY comp NULLS LAST) - 1 END)::INT AS cluster_label FROM label")
def dbscan_clusters(spark, sf):
    return clustering.global_clusters(cells(spark, sf), ["c0", "c1"], "dbscan", eps=250.0, least=4).select("event_id", "cluster_label")


@query(f"WITH RECURSIVE {_dbscan_sql(500.0, 3, ' AND a.sample_id = b.sample_id')} SELECT sample_id, event_id, (CASE WHEN comp IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY sample_id ORDER BY comp NULLS LAST) - 1 END)::INT AS cluster_label FROM label")
def dbscan_per_sample(spark, sf):
    """Clusters of each sample by itself, all samples in one plan."""
    return clustering.shaped_clusters(cells(spark, sf), ["c0", "c1"], "dbscan", by="sample_id", eps=500.0, least=3).select("sample_id", "event_id", "cluster_label")


@query()
def hdbscan_clusters(spark, sf):
    return clustering.global_clusters(cells(spark, sf), ["c0", "c1"], "hdbscan", least=5).groupBy("cluster_label").agg(F.count("*").alias("n"))


@query()
def gate_hdbscan(spark, sf):
    """Hulls of density clusters as a polygon gate's children."""
    df = cells(spark, sf)
    g = gates.PolygonGate("g", "root", "c0", "c1", method="hdbscan", params={"least": 6}).fit(df)
    return g.predict(df).groupBy("population").agg(F.count("*").alias("n")) if g.children else df.limit(0).select(F.lit("").alias("population"), F.lit(0).cast("long").alias("n"))


@query(f"""WITH RECURSIVE {_dbscan_sql(400.0, 8, '')}, m AS (SELECT event_id, comp, c0, c1 FROM label JOIN cells USING (event_id) WHERE comp IS NOT NULL)
    SELECT count(DISTINCT comp) AS clusters, round(min(c0), 6) AS least, round(max(c0), 6) AS most FROM (SELECT *, count(*) OVER (PARTITION BY comp) AS k FROM m) WHERE k >= 3""")
def gate_dbscan(spark, sf):
    """A polygon gate by DBSCAN: how many shapes, and how far they reach."""
    g = gates.PolygonGate("g", "root", "c0", "c1", method="dbscan", params={"eps": 400.0, "least": 8}).fit(cells(spark, sf))
    xs = [x for c in g.children for x, _ in c.polygon]
    return spark.createDataFrame([(len(g.children), round(min(xs), 6) if xs else None, round(max(xs), 6) if xs else None)], "clusters long, least double, most double")


_TAXI = "abs(a.c0 - b.c0) + abs(a.c1 - b.c1)"
_DENSE = f"""r AS (SELECT 5 * quantile_cont(d, 0.5) AS r FROM (SELECT a.event_id, min({_TAXI}) AS d FROM cells a JOIN cells b ON a.event_id <> b.event_id GROUP BY a.event_id)),
    dense AS (SELECT a.event_id, count(*) AS density FROM cells a, cells b, r WHERE {_TAXI} <= r.r GROUP BY a.event_id)"""


@query(f"WITH {{CELLS}}, {_DENSE} SELECT event_id, density FROM dense")
def local_density_all(spark, sf):
    """Neighbours of every event among all events."""
    df = cells(spark, sf)
    return sampling.local_density(df, ["c0", "c1"], df).select("event_id", F.col("density").cast("long").alias("density"))


_WEIGHT = f"{_DENSE}, q AS (SELECT quantile_cont(density, 0.1) AS low, quantile_cont(density, 0.4) AS high FROM dense), weight AS (SELECT event_id, CASE WHEN density <= low THEN 0 WHEN density <= high THEN 1 ELSE high / density END AS w FROM dense, q)"


@query(f"WITH {{CELLS}}, {_WEIGHT} SELECT event_id, round(w, 6) AS weight FROM weight")
def density_weights(spark, sf):
    """Chances of a density-dependent sample, from exact densities."""
    return sampling.density_weights(cells(spark, sf), ["c0", "c1"], tree_fraction=None, outlier=10, target=40).select("event_id", r6("weight"))


@query(f"WITH {{CELLS}}, {_WEIGHT} SELECT event_id, count(*) AS n FROM weight, (SELECT unnest([1, 2, 3]) AS copy) WHERE copy = 1 OR ('0x' || substr(md5(event_id::VARCHAR || ':' || copy || ':5'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < w GROUP BY event_id")
def density_upsample(spark, sf):
    """More rows of thin regions, by weights of its own."""
    return sampling.upsample_density(cells(spark, sf), ["c0", "c1"], 3, seed=5, tree_fraction=None, outlier=10, target=40).groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {{CELLS}}, o AS (SELECT event_id, c0, c1, row_number() OVER (ORDER BY md5(event_id::VARCHAR || ':0'), event_id) AS i FROM cells),
    near AS (SELECT a.i, list(b.i) AS before FROM o a JOIN o b ON b.i < a.i AND {_D2} <= 700 GROUP BY a.i),
    s AS (SELECT 0 AS i, []::BIGINT[] AS kept UNION ALL SELECT s.i + 1, CASE WHEN len(list_intersect(kept, coalesce(before, []))) = 0 THEN list_append(kept, s.i + 1) ELSE kept END FROM s LEFT JOIN near ON near.i = s.i + 1 WHERE s.i < (SELECT count(*) FROM o))
    SELECT event_id FROM o WHERE list_contains((SELECT kept FROM s ORDER BY i DESC LIMIT 1), o.i)""")
def faithful_neighbourhood(spark, sf):
    """A faithful cover: every event within 700 of a kept one, kept ones farther apart."""
    return sampling.faithful_downsample(cells(spark, sf), ["c0", "c1"], 700.0, first=40).select("event_id")
