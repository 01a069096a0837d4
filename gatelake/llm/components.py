"""Connected components over DataFrames, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b) that isn't its component's smallest node, which is the root.

    Each round hooks every node to its smallest neighbour, shortens the paths, and contracts the graph; at least half of the nodes with
    edges vanish, so rounds grow with the logarithm of the nodes. Hot nodes are pre-aggregated.
    """
    left = staged(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    labels = None
    while True:
        up = staged(left.groupBy("hi").agg(F.min("lo").alias("up")), "up")
        if labels is not None and up.isEmpty():
            unstage(left, up)
            return labels
        while True:
            over = up.select(F.col("hi").alias("up"), F.col("up").alias("over"))
            jumped = staged(up.join(over, "up", "left").select("hi", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "up")
            unstage(up)
            up = jumped.drop("moved")
            up.staged_path = jumped.staged_path
            if jumped.where("moved").isEmpty():
                break
        hooked = up.select(F.col("hi").alias("node"), F.col("up").alias("root"))
        if labels is None:
            labels = staged(hooked, "labels")
        else:
            old = labels
            moved = old.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            labels = staged(moved.unionByName(hooked), "labels")
            unstage(old)
        a, b = up.select("hi", F.col("up").alias("ua")), up.select(F.col("hi").alias("lo"), F.col("up").alias("ub"))
        moved = left.join(a, "hi", "left").join(b, "lo", "left").select(F.coalesce("ua", "hi").alias("x"), F.coalesce("ub", "lo").alias("y")).where("x != y")
        new = staged(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
        unstage(left, up)
        left = new
