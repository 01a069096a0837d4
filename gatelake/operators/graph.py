"""Graphs over events: connected components, neighbour graphs, and communities by rounds of local moves.

Edges are tables. What contraction leaves of a graph is finished in one place, by the same rules, once it has few enough edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .space import nearest

#: Edges that the driver takes over (components), and that one task does (communities of a group).
DRIVER_EDGES, TASK_EDGES = 200_000, 200_000
#: Rounds of moves at one level, and rounds without a gain of more than LEAST in modularity after which a level ends.
ROUNDS, PATIENCE, LEAST = 40, 4, 1e-6


def components(edges: DataFrame, driver_edges: int | None = None) -> DataFrame:
    """id, component (the smallest id) of all ends of edges(a, b).

    Every vertex joins its neighbour of the least hash, if that is less than its own; edges then join what vertices have joined. About half of
    the vertices go in a round, whatever the order of their ids.
    """
    most = DRIVER_EDGES if driver_edges is None else driver_edges
    left = stored(edges.select("a", "b"), "edges")
    joined: list[DataFrame] = []
    while left.agg(F.count_if(F.col("a") != F.col("b")).alias("n")).head().n > most:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tie = lambda c: F.xxhash64(c, F.lit(len(joined)))
        least = both.groupBy("a").agg(F.min(F.struct(tie("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        to = F.when(F.struct(F.col("m.h"), F.col("m.to")) < F.struct(tie("a"), F.col("a")), F.col("m.to")).otherwise(F.col("a"))
        joined.append(stored(least.select(F.col("a").alias("id"), to.alias("to")), "joined"))
        ends = left.where("a <> b").join(joined[-1].select(F.col("id").alias("a"), F.col("to").alias("c")), "a").join(joined[-1].select(F.col("id").alias("b"), F.col("to").alias("d")), "b")
        left = stored(ends.select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), "edges")
    got = left.toArrow().to_pandas()
    names, comp = _components(got["a"].to_numpy(), got["b"].to_numpy())
    spark = edges.sparkSession
    if not joined:
        return spark.createDataFrame(pa.table({"id": names, "component": comp}))
    # ends of the last edges that were left, then back through the rounds
    out = spark.createDataFrame(pa.table({"to": names, "component": comp}))
    for m in reversed(joined):
        out = stored(m.join(out, "to", "left").select(F.col("id").alias("to"), F.coalesce("component", "to").alias("component")), "components")
    least = out.groupBy("component").agg(F.min("to").alias("least"))
    return out.join(least, "component").select(F.col("to").alias("id"), F.col("least").alias("component"))


def _components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex that each is connected with."""
    names, ends = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        new = new[new]
        while (new != (again := new[new])).any():
            new = again
        new = new[low]
        if (new == low).all():
            return names, names[low]
        low = new


def neighbour_graph(events: DataFrame, features: list[str], k: int, id_col: str = "event_id", by: str | None = None) -> DataFrame:
    """a, b, w (a < b): events of which one is among the k nearest of the other (of its group), weighted by the overlap of both neighbour sets (over none: left out)."""
    near = stored(nearest(events, features, k, id_col, by).select("id", F.col("near.id").alias("near")), "neighbours")
    pairs = near.select("id", F.explode("near").alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    sets = pairs.join(near.select(F.col("id").alias("a"), F.col("near").alias("na")), "a").join(near.select(F.col("id").alias("b"), F.col("near").alias("nb")), "b")
    both = F.size(F.array_intersect("na", "nb"))
    return sets.select("a", "b", (both / (F.size("na") + F.size("nb") - both)).alias("w")).where("w > 0")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of labels(id, community) on edges(a, b, w), each pair once; an edge from an event to itself counts twice in its degree. Of edges with a group g, the sum over groups."""
    to = lambda end, name: labels.select(F.col("id").alias(end), F.col("community").alias(name))
    g = F.col("g") if "g" in edges.columns else F.lit("")
    held = edges.withColumn("g", g).join(to("a", "ca"), "a").join(to("b", "cb"), "b")
    both = held.select("g", "ca", "w", F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside")).unionByName(held.select("g", F.col("cb").alias("ca"), "w", F.lit(0.0).alias("inside")))
    masses = both.groupBy("g", "ca").agg(F.sum("w").alias("mass"), F.sum("inside").alias("inside"))
    each = masses.groupBy("g").agg(F.sum("mass").alias("total"), F.sum("inside").alias("inside"), F.sum(F.col("mass") * F.col("mass")).alias("squares"))
    return each.agg(F.sum(2 * F.col("inside") / F.col("total") - F.col("squares") / F.col("total") / F.col("total")).alias("m")).head().m or 0.0


def communities(edges: DataFrame, seed: int = 42, task_edges: int | None = None) -> DataFrame:
    """id, community (the smallest id in it) of all ends of edges(a, b, w): local moves that raise modularity, contraction, and the same again.

    Edges may have a group g, a string; each group is then a graph of its own, and all are handled in one plan. In a round every vertex finds the
    community that gains most by it, from all communities as they were; only vertices of an even hash of the round move, and a lone vertex only
    moves to another lone one that is smaller, so that pairs don't change places for ever. What is left of a group with at most TASK_EDGES edges
    is finished in one task, by the same moves one after another.
    """
    most = TASK_EDGES if task_edges is None else task_edges
    g = F.col("g") if "g" in edges.columns else F.lit("")
    left, levels = stored(edges.select("a", "b", F.col("w").cast("double").alias("w"), g.alias("g")), "graph"), []
    while (left.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head().n or 0) > most:
        labels, moved = _level(left, seed + 100 * len(levels))
        levels.append(labels)
        if not moved:
            left = left.limit(0)
            break
        to = lambda end, name, ls=labels: ls.select(F.col("id").alias(end), F.col("community").alias(name))
        joined = left.join(to("a", "c"), "a").join(to("b", "d"), "b")
        left = stored(joined.groupBy("g", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).agg(F.sum("w").alias("w")), "graph")

    def finish(t: pa.Table) -> pa.Table:
        from .clustering import louvain

        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        rows = sorted(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), w.tolist(), strict=True))
        by = louvain({(p, q): v for p, q, v in rows}, len(names), seed)
        least = np.full(by.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, by, names)
        return pa.table({"id": names, "community": least[by]})

    out = stored(left.groupBy("g").applyInArrow(finish, "id long, community long"), "communities")
    for labels in reversed(levels):
        above = out.select(F.col("id").alias("community"), F.col("community").alias("higher"))
        out = labels.join(above, "community", "left").select("id", F.coalesce("higher", "community").alias("community"))
    least = out.groupBy("community").agg(F.min("id").alias("least"))
    return out.join(least, "community").select("id", F.col("least").alias("community"))


def _level(edges: DataFrame, seed: int) -> tuple[DataFrame, bool]:
    """id, community after rounds of moves, and whether any vertex has moved."""
    both = edges.where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "g"))
    loops = edges.where("a = b").select("a", "b", (2 * F.col("w")).alias("w"), "g")
    degree = both.unionByName(loops).groupBy(F.col("a").alias("id"), "g").agg(F.sum("w").alias("degree"))
    totals = degree.groupBy("g").agg(F.sum("degree").alias("total"))
    degree = stored(degree.join(totals, "g").drop("g"), "degrees")
    arcs = stored(both.select("a", "b", "w"), "arcs")
    labels = degree.withColumn("community", F.col("id"))
    best, score, idle, any_move = labels, modularity(edges, labels), 0, False
    for r in range(ROUNDS):
        mass = labels.groupBy("community").agg(F.sum("degree").alias("mass"), F.count("*").alias("size"))
        own = labels.join(mass, "community").select("id", "degree", "total", F.col("community").alias("own"), F.col("mass").alias("own_mass"), F.col("size").alias("own_size"))
        reach = arcs.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
        option = reach.join(mass, "community").join(own, "id")
        gain = F.col("w") - F.col("degree") * (F.col("mass") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0.0)) / F.col("total")
        allowed = (F.col("community") == F.col("own")) | ~((F.col("size") == 1) & (F.col("own_size") == 1) & (F.col("community") > F.col("own")))
        chosen = option.where(allowed).groupBy("id").agg(F.max(F.struct(gain.alias("gain"), (-F.col("community")).alias("to"))).alias("best"), F.max(F.when(F.col("community") == F.col("own"), gain)).alias("stay"))
        stay = F.coalesce("stay", -F.col("degree") * (F.col("own_mass") - F.col("degree")) / F.col("total"))
        turn = F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(2)) == 0
        goes = turn & (F.col("best.gain") > stay + 1e-12)
        labels = stored(own.join(chosen, "id", "left").select("id", "degree", "total", F.when(goes, -F.col("best.to")).otherwise(F.col("own")).alias("community")), "labels")
        now = modularity(edges, labels)
        if now > score + LEAST:
            best, score, idle, any_move = labels, now, 0, True
        else:
            idle += 1
            if idle >= PATIENCE:
                break
    return best.select("id", "community"), any_move


def numbered(ids: DataFrame, column: str, to: str) -> DataFrame:
    """Distinct values of a column with their place, from 0, in ascending order."""
    spark = ids.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], names=[column, "part", "place"])
            n += b.num_rows

    ordered = ids.select(F.col(column).cast("long").alias(column)).distinct().repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), column).sortWithinPartitions(column)
    kept = stored(ordered.mapInArrow(run, f"{column} long, part int, place long"), "numbered")
    before: list[Column] = []
    total = 0
    for r in kept.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        before += [F.lit(r.part), F.lit(total)]
        total += r.n
    first = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    return kept.select(column, (F.col("place") + first).cast("long").alias(to))
