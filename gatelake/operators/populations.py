"""Populations as relations: a tree table (sample_id, population, parent) and a membership table (sample_id, population, event_id).

All samples are handled in one plan. The root population holds every event and isn't stored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from . import idsets

ROOT = "root"
#: Populations nest no deeper than this; a deeper tree is a cycle.
MAX_DEPTH = 64


def gated(events: DataFrame, definitions: dict[str, tuple[str, Column]], keys: tuple[str, ...] = ("sample_id", "event_id")) -> DataFrame:
    """Membership rows of predicate populations {name: (parent, predicate)}: a child's rows are its parent's that satisfy the predicate.

    One scan: every population is a conjunction of predicates along its path, and an event gives a row for each that holds.
    """
    full: dict[str, Column] = {ROOT: F.lit(True)}
    left = dict(definitions)
    while left:
        ready = [n for n, (p, _) in left.items() if p in full]
        if not ready:
            raise ValueError(f"no parent for {', '.join(sorted(left))}")
        for n in ready:
            parent, predicate = left.pop(n)
            full[n] = full[parent] & F.coalesce(predicate, F.lit(False))
    names = F.array(*[F.when(full[n], F.lit(n)) for n in definitions])
    return events.select(*keys, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("population"))


def tree_of(definitions: dict[str, tuple[str, Column]]) -> list[tuple[str, str | None]]:
    return [(ROOT, None), *((n, p) for n, (p, _) in definitions.items())]


def orphans(tree: DataFrame) -> DataFrame:
    """Populations whose parent isn't in the tree."""
    known = tree.select(F.col("population").alias("parent")).distinct()
    return tree.where(F.col("parent").isNotNull()).join(known, "parent", "left_anti").select("population", "parent")


def descendants(tree: DataFrame, of: str | None = None) -> DataFrame:
    """ancestor, population, depth (from 1) and path for each ancestor and each population below it, by a recursive query."""
    spark, view = tree.sparkSession, f"_tree_{uuid.uuid4().hex}"
    tree.select("population", "parent").createOrReplaceTempView(view)
    start = "WHERE parent = :of" if of else "WHERE parent IS NOT NULL"
    text = f"""
        WITH RECURSIVE d (ancestor, population, depth, path) AS (
            SELECT parent, population, 1, concat(parent, '/', population) FROM {view} {start}
            UNION ALL
            SELECT d.ancestor, t.population, d.depth + 1, concat(d.path, '/', t.population)
            FROM d JOIN {view} t ON t.parent = d.population WHERE d.depth < {MAX_DEPTH})
        SELECT * FROM d
    """
    out = spark.sql(text, args={"of": of}) if of else spark.sql(text)
    spark.catalog.dropTempView(view)  # the plan has the table itself
    return out


def print_tree(tree: list[tuple[str, str | None]]) -> str:
    """The tree as indented text, children in name order."""
    children: dict[str | None, list[str]] = {}
    for n, p in tree:
        children.setdefault(p, []).append(n)

    def lines(name: str, depth: int) -> list[str]:
        return ["    " * depth + name, *(x for c in sorted(children.get(name, [])) for x in lines(c, depth + 1))]

    return "\n".join(x for r in sorted(children.get(None, [])) for x in lines(r, 0))


def without(tree: DataFrame, populations: list[str]) -> DataFrame:
    """The tree without the given populations and all below them; ["all"] leaves the root."""
    if populations == ["all"]:
        return tree.where(F.col("population") == ROOT)
    below = descendants(tree).where(F.col("ancestor").isin(populations)).select("population").distinct()
    return tree.where(~F.col("population").isin(populations)).join(below, "population", "left_anti")


def stats(membership: DataFrame, tree: DataFrame, root_counts: DataFrame) -> DataFrame:
    """sample_id, population, parent, n, frac_of_parent, frac_of_root for every sample and population; 0 where a sample has none.

    root_counts(sample_id, n): all events of each sample. tree(population, parent) is small and the same for all samples.
    """
    counted = membership.groupBy("sample_id", "population").agg(F.count("*").alias("n"))
    roots = root_counts.select("sample_id", F.lit(ROOT).alias("population"), "n")
    grid = root_counts.select("sample_id", F.col("n").alias("root_n")).crossJoin(F.broadcast(tree.select("population", "parent")))
    known = grid.join(counted.unionByName(roots), ["sample_id", "population"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parents = known.select("sample_id", F.col("population").alias("parent"), F.col("n").alias("parent_n"))
    out = known.join(parents, ["sample_id", "parent"], "left")
    share = lambda by: F.coalesce(F.try_divide(F.col("n"), F.col(by)), F.lit(0.0))
    is_root = F.col("population") == ROOT
    return out.select("sample_id", "population", "parent", "n", F.when(is_root, 1.0).otherwise(share("parent_n")).alias("frac_of_parent"), F.when(is_root, 1.0).otherwise(share("root_n")).alias("frac_of_root"))


def merged(membership: DataFrame, populations: list[str], name: str) -> DataFrame:
    """Union of populations under a new name."""
    return idsets.combined(membership, {name: ("or", populations)})


def intersected(membership: DataFrame, populations: list[str], name: str) -> DataFrame:
    """Events that are in all the populations: one aggregate, no chain of joins."""
    return idsets.combined(membership, {name: ("and", populations)})


def subtracted(membership: DataFrame, left: str, right: list[str], name: str) -> DataFrame:
    """Events of one population that are in none of the others."""
    return idsets.combined(membership, {name: ("not", [left, *right])})


def merged_signature(signatures: DataFrame, populations: list[str]) -> DataFrame:
    """Per-feature mean of signature maps (population, signature)."""
    cells = signatures.where(F.col("population").isin(populations)).select(F.explode("signature").alias("feature", "value"))
    return cells.groupBy("feature").agg(F.avg("value").alias("value"))


def signature(events: DataFrame, membership: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature per sample and population, as columns."""
    joined = events.join(membership, ["sample_id", "event_id"])
    return joined.groupBy("sample_id", "population").agg(*[F.avg(f).alias(f) for f in features])


def preorder(tree: list[tuple[str, str | None]]) -> dict[str, int]:
    """Rank of each population in a depth-first walk that keeps the order of siblings."""
    children: dict[str | None, list[str]] = {}
    for n, p in tree:
        children.setdefault(p, []).append(n)
    out: dict[str, int] = {}
    todo = list(reversed(children.get(None, [])))
    while todo:
        name = todo.pop()
        if name in out:
            raise ValueError(f"{name} is its own ancestor")
        out[name] = len(out)
        todo += reversed(children.get(name, []))
    return out


def deepest_label(events: DataFrame, membership: DataFrame, tree: list[tuple[str, str | None]], parent: str = ROOT) -> DataFrame:
    """events with population_label: the last population in depth-first order below `parent` that contains the event, else the parent."""
    rank = preorder(tree)
    order = F.create_map(*[F.lit(v) for kv in rank.items() for v in kv])
    below = [n for n in rank if _is_below(n, parent, dict(tree))]
    last = membership.where(F.col("population").isin(below)).groupBy("sample_id", "event_id").agg(F.max_by("population", order[F.col("population")]).alias("population_label"))
    return events.join(last, ["sample_id", "event_id"], "left").withColumn("population_label", F.coalesce("population_label", F.lit(parent)))


def _is_below(name: str, ancestor: str, parents: dict[str, str | None]) -> bool:
    at = parents.get(name)
    while at is not None and at != ancestor:
        at = parents.get(at)
    return at == ancestor


def multilabel(events: DataFrame, membership: DataFrame, labels: list[str]) -> DataFrame:
    """events with a 0/1 column for each population."""
    flags = membership.where(F.col("population").isin(labels)).groupBy("sample_id", "event_id").agg(*[F.max((F.col("population") == n).cast("int")).alias(n) for n in labels])
    out = events.join(flags, ["sample_id", "event_id"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in labels})


def singlelabel(events: DataFrame, membership: DataFrame, labels: list[str]) -> DataFrame:
    """events with `label`: the 1-based place of the last listed population that contains the event, 0 for none."""
    place = reduce(lambda e, i: F.when(F.col("population") == labels[i], i + 1).otherwise(e), range(len(labels)), F.lit(0))
    best = membership.where(F.col("population").isin(labels)).groupBy("sample_id", "event_id").agg(F.max(place).alias("label"))
    return events.join(best, ["sample_id", "event_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def load(events: DataFrame, membership: DataFrame, population: str) -> DataFrame:
    """Events of one population over all samples; the root is everything."""
    if population == ROOT:
        return events
    return events.join(membership.where(F.col("population") == population), ["sample_id", "event_id"], "left_semi")


def quantile_clean(events: DataFrame, features: list[str], lower: float = 0.001, upper: float = 0.999) -> DataFrame:
    """Keep rows within the quantiles of each feature in turn; every feature's quantiles are those of the rows that are left."""
    for f in features:
        row = quantiles(events, [f], [lower, upper]).head()
        if row[f] is None:
            return events
        events = events.where(F.col(f).cast("double").between(*row[f]))
    return events


def renamed(membership: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename populations; those that get one name are merged."""
    new = F.coalesce(F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.col("population")], F.col("population"))
    return membership.withColumn("population", new).distinct()


def shares(membership: DataFrame, by: str = "population") -> DataFrame:
    """Count and share of each population within its sample."""
    w = Window.partitionBy("sample_id")
    return membership.groupBy("sample_id", by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(w))
