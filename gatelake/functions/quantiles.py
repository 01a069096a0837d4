"""Exact quantiles and running counts whose memory doesn't grow with the data.

Spark's exact percentile keeps all distinct values of a group in one buffer. It serves for groups of up to ROWS values; for larger ones the wanted
ranks are closed in on: every pass counts the values between a few hundred approximate cuts, keeps the interval that holds the rank, and
stops when an interval has ROWS values or only one distinct value. The cuts' quality changes the number of passes, not the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import number

#: Values that one task sorts, or holds in one aggregate.
ROWS = 1_000_000
#: Cuts of one pass.
CUTS = 256


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """by, and for each column an array of its quantiles, linear between ranks; null and NaN don't count, and a column without values gives null.

    One row for each group (for the whole table without `by`). Groups are few: their cuts are kept on the driver.
    """
    rows, by = rows or ROWS, list(by)
    xs = {c: number(c) for c in columns}
    grouped = df.groupBy(*by)
    sizes = grouped.agg(*[F.count(x).alias(f"_{i}") for i, x in enumerate(xs.values())])
    most = sizes.agg(F.max(F.greatest(*[F.col(f"_{i}") for i in range(len(xs))], F.lit(0))).alias("n")).head().n or 0
    if most <= rows:
        return grouped.agg(*[F.percentile(x, F.array(*map(F.lit, probs))).alias(c) for c, x in xs.items()])
    cells = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), x.alias("v")) for i, x in enumerate(xs.values())])).alias("_x")).select(*by, F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v")).where("_v is not null")
    known = sizes.collect()
    wanted: dict[tuple, set[int]] = {}
    for g, r in enumerate(known):
        for i in range(len(xs)):
            if n := r[f"_{i}"]:
                at = [p * (n - 1) for p in probs]
                wanted[g, i] = {math.floor(a) for a in at} | {math.ceil(a) for a in at}
    found = _ranked(cells, by, known, wanted, rows)
    out = []
    for g, r in enumerate(known):
        values: list[list[float] | None] = []
        for i in range(len(xs)):
            if not (n := r[f"_{i}"]):
                values.append(None)
                continue
            own = found[g, i]
            values.append([own[math.floor(a)] + (a - math.floor(a)) * (own[math.ceil(a)] - own[math.floor(a)]) for a in (p * (n - 1) for p in probs)])
        out.append((*(r[b] for b in by), *values))
    fields = [df.schema[b] for b in by] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns]
    return df.sparkSession.createDataFrame(out, T.StructType(fields))


def _ranked(cells: DataFrame, by: list[str], known: list, wanted: dict[tuple, set[int]], rows: int) -> dict[tuple, dict[int, float]]:
    """The values at the wanted ranks (from 0) of each group and column; cells has by, _c and _v."""
    spark = cells.sparkSession
    found: dict[tuple, dict[int, float]] = {k: {} for k in wanted}
    # open intervals: group, column, above which value, up to which, values below, values inside, wanted ranks
    left = [(g, i, -math.inf, math.inf, 0, known[g][f"_{i}"], tuple(sorted(w))) for (g, i), w in wanted.items()]
    fields = [T.StructField(f"_k{j}", cells.schema[b].dataType) for j, b in enumerate(by)]
    schema = T.StructType([T.StructField("_g", T.LongType()), *fields, T.StructField("_i", T.IntegerType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])

    def inside(some: list[tuple]) -> DataFrame:
        table = spark.createDataFrame([(at, *(known[g][b] for b in by), i, lo, hi) for at, (g, i, lo, hi, *_) in enumerate(some)], schema)
        on = (F.col("_c") == F.col("_i")) & (F.col("_v") > F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        for j, b in enumerate(by):
            on = on & F.col(b).eqNullSafe(F.col(f"_k{j}"))
        return cells.join(F.broadcast(table), on).select("_g", "_v")  # a row for each interval that is still open

    while large := [x for x in left if x[5] > rows]:
        part = inside(large)
        cuts = part.groupBy("_g").agg(F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit((j + 1) / CUTS) for j in range(CUTS)]), F.lit(20 * CUTS))).alias("_cuts"))
        # values equal to a cut are a cell of their own, so a frequent value can't hold a pass up
        cell = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = part.join(F.broadcast(cuts), "_g").groupBy("_g", cell.alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most")).orderBy("_g", "_b").collect()
        left = [x for x in left if x[5] <= rows]
        below: dict[int, int] = {}
        for r in counts:
            g, i, _, _, base, _, ranks = large[r["_g"]]
            before = base + below.get(r["_g"], 0)
            below[r["_g"]] = below.get(r["_g"], 0) + r.n
            if own := tuple(k for k in ranks if before <= k < before + r.n):
                if r.least == r.most:
                    found[g, i].update(dict.fromkeys(own, r.least))
                else:
                    left.append((g, i, math.nextafter(r.least, -math.inf), r.most, before, r.n, own))
    if left:
        for r in inside(left).groupBy("_g").agg(F.array_sort(F.collect_list("_v")).alias("vs")).select("_g", F.transform(_places(left), lambda k: F.col("vs")[k]).alias("vs")).collect():
            g, i, _, _, _, _, ranks = left[r["_g"]]
            found[g, i].update(zip(ranks, r.vs, strict=True))
    return found


def _places(left: list[tuple]) -> Column:
    """For each interval the wanted places within it."""
    table = F.create_map(*[x for at, (_, _, _, _, below, _, ranks) in enumerate(left) for x in (F.lit(at).cast("long"), F.array(*[F.lit(k - below) for k in ranks]))])
    return table[F.col("_g")]


def running(counts: DataFrame, value: str, k: str, to: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """counts with `to`: the sum of k over smaller values (of the group). counts has one row for each group and value.

    Values are dealt to buckets between approximate cuts; a window orders one bucket, and buckets' totals are added up.
    """
    rows, by = rows or ROWS, list(by)
    most = (counts.groupBy(*by).count().agg(F.max("count")).head()[0] or 0) if by else counts.count()
    buckets = min(1000, -(-most // rows))
    if buckets <= 1:
        parts, given = by or [F.lit(0)], counts
    else:
        cuts = counts.groupBy(*by).agg(F.percentile_approx(F.col(value), F.array(*[F.lit((j + 1) / buckets) for j in range(buckets)]), F.lit(10 * buckets)).alias("_cuts"))
        cuts = F.broadcast(cuts)  # `buckets` numbers for each group
        given = (counts.join(cuts, by) if by else counts.crossJoin(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
        parts = [*by, "_b"]
    w = Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = given.withColumn(to, F.coalesce(F.sum(k).over(w), F.lit(0)))
    if buckets <= 1:
        return out
    total = given.groupBy(*parts).agg(F.sum(k).alias("_total"))
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*parts, F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    return out.join(F.broadcast(base), parts).withColumn(to, F.col(to) + F.col("_base")).drop("_base", "_b")
