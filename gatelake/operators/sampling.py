"""Sampling of events: uniform, by density, by neighbours; every sample is fixed by a seed.

A row's place in a sample is the order of a hash of its id and the seed, so a result doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.transforms import number


def key(id_col: str = "event_id", seed: int = 0) -> Column:
    """Hash order of rows; md5, so that any engine can check it."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def uniform(df: DataFrame, size: int | float, *, id_col: str = "event_id", seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Exactly `size` rows (all, if there are fewer), or about a fraction of them if size is a float; in each group if `by` is given.

    Whole-table samples use a top-n that never sorts more than `size` rows a task; groups are cut by hash first, see `first_by_hash`.
    """
    if isinstance(size, bool) or not isinstance(size, int | float):
        raise TypeError("size must be an int or a float")
    if isinstance(size, float):
        cut = F.conv(F.substring(key(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return df.where(cut < size)
    if not by:
        return df.orderBy(key(id_col, seed), id_col).limit(size)
    return first_by_hash(df, by, F.lit(size), id_col=id_col, seed=seed)


#: Hash cells of a group; only the cell in which a sample ends is sorted.
HASH_CELLS = 4096


def first_by_hash(df: DataFrame, by: list[str], size: Column, *, id_col: str = "event_id", seed: int = 0) -> DataFrame:
    """The first rows of each group in hash order; size is an expression of the group's columns.

    Cells of the hash are counted first. Those before a group's last one are taken whole, and a window ranks that one cell alone.
    """
    cell = F.conv(F.substring(key(id_col, seed), 1, 3), 16, 10).cast("int")
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).withColumn("_left", size - F.col("_before"))
    counts = counts.where("_left > 0").select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_cell").alias("_own"), F.when(F.col("_left") < F.col("_n"), F.col("_left")).alias("_last"))
    on = F.col("_cell") == F.col("_own")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    kept = rows.join(counts, on)
    r = F.row_number().over(Window.partitionBy(*by).orderBy(key(id_col, seed), F.col(id_col)))
    whole = kept.where("_last is null").select(df.columns)
    return whole.unionByName(kept.where("_last is not null").withColumn("_r", r).where("_r <= _last").select(df.columns))


def density_weight(local: Column, target: Column | float, outlier: Column | float) -> Column:
    """0 up to the outlier density, 1 up to the target density, then target / local."""
    return F.when(local <= outlier, 0.0).when(local <= target, 1.0).otherwise(F.try_divide(F.lit(target) if not isinstance(target, Column) else target, local))


def weighted(df: DataFrame, size: int, weight: str, *, id_col: str = "event_id", seed: int = 0) -> DataFrame:
    """`size` rows without replacement, with chances in proportion to weight: the least -ln(u) / w win."""
    u = (F.conv(F.substring(key(id_col, seed), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
    return df.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k", id_col).limit(size).drop("_k")


#: Rows that are sent to every executor as a neighbour set.
TREE_ROWS = 20_000


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        out = np.zeros((len(x), len(y)))
        for i in range(x.shape[1]):
            out += np.abs(x[:, None, i] - y[None, :, i])
        return out
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))


def _spots(df: DataFrame, features: list[str], name: str) -> DataFrame:
    """pid, x, n and ids of df's places: what rows with equal features (all of them there) share."""
    from ..session import stored

    xs = [number(f) + F.lit(0.0) for f in features]
    rows = df.select(F.array(*xs).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    spots = rows.groupBy("x").agg(F.count("*").alias("n")).withColumn("pid", F.monotonically_increasing_id())
    return stored(spots.select("pid", "x", "n", F.transform(F.sequence(F.lit(1), F.least("n", F.lit(2))), lambda i: F.col("pid")).alias("ids")), name)


def local_density(df: DataFrame, features: list[str], tree: DataFrame, *, metric: str = "manhattan", alpha: float = 5.0, to: str = "density") -> DataFrame:
    """df with the number of tree rows within alpha times the tree's median distance to the nearest other row, exact for a tree of any size.

    Tree rows are in blocks of space, and each place of df asks the blocks within the radius. Rows that lack a feature have 0.
    """
    from . import space

    spots = _spots(tree, features, "tree")
    blocks = space.Blocks.of(spots, len(features))
    homes = space.dealt(spots, blocks)
    near = space.nearest_to_places(homes, blocks, 2, metric).where(F.size("near") > 1).join(spots.select("pid", "n"), "pid").select(F.explode(F.array_repeat(F.col("near")[1]["d"], F.col("n").cast("int"))).alias("d"))
    middle = quantiles(near, ["d"], [0.5]).head().d
    if middle is None:
        middle = [0.0]
    mine = _spots(df, features, "places")
    got = space.counts_within(space.dealt(mine, blocks).select("pid", "x", "home"), blocks, alpha * middle[0], metric, among=homes)
    dense = mine.select("pid", "x").join(got, "pid").select(F.col("x").alias("_at"), F.col("within").cast("double").alias(to))
    at = F.array(*[number(f) + F.lit(0.0) for f in features])
    return df.withColumn("_at", at).join(dense, "_at", "left").withColumn(to, F.coalesce(to, F.lit(0.0))).select(*df.columns, to)


def density_weights(df: DataFrame, features: list[str], *, id_col: str = "event_id", tree_fraction: float | None = 0.1, metric: str = "manhattan", alpha: float = 5.0, outlier: float = 1.0, target: float = 5.0, seed: int = 0, to: str = "weight") -> DataFrame:
    """df with a chance of being kept, from local densities whose outlier and target levels are their percentiles.

    Densities are told by `tree_fraction` of the rows, however many; by all of them, if it is None. Every row gets one.
    """
    tree = df if tree_fraction is None else uniform(df, tree_fraction, id_col=id_col, seed=seed + 1)
    dense = local_density(df, features, tree, metric=metric, alpha=alpha, to="_density")
    low, high = quantiles(dense, ["_density"], [outlier / 100, target / 100]).head()["_density"] or (0.0, 0.0)
    return dense.withColumn(to, density_weight(F.col("_density"), F.lit(high), F.lit(low))).drop("_density")


def density_downsample(df: DataFrame, features: list[str], size: int, *, id_col: str = "event_id", tree_fraction: float | None = 0.1, metric: str = "manhattan", alpha: float = 5.0, outlier: float = 1.0, target: float = 5.0, seed: int = 0) -> DataFrame:
    """A sample that thins dense regions: `size` rows by `density_weights`."""
    given = density_weights(df, features, id_col=id_col, tree_fraction=tree_fraction, metric=metric, alpha=alpha, outlier=outlier, target=target, seed=seed, to="_w")
    return weighted(given, size, "_w", id_col=id_col, seed=seed).drop("_w")


def upsample_density(df: DataFrame, features: list[str], factor: int = 2, *, weight: str | None = None, size: int | None = None, id_col: str = "event_id", seed: int = 0, **density) -> DataFrame:
    """df and, beside it, more of its rows from thin regions: each of `factor` - 1 further copies of a row is there with the chance of `density_weights`.

    `size` rows in all, by hash order, if given. With `weight`, a column, a row is instead there as often as its weight says, once at least and `factor`
    times at most. `copy` isn't kept: equal rows are copies.
    """
    if weight is not None:
        copies = F.greatest(F.lit(1), F.least(F.lit(factor), F.ceil(weight).cast("int")))
        return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    given = density_weights(df, features, id_col=id_col, seed=seed, to="_w", **density)
    each = given.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), "_copy", F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    more = each.where((F.col("_copy") == 1) | (chance < F.col("_w")))
    if size is not None:
        more = more.withColumn("_h", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), "_copy", F.lit(str(seed))))).orderBy("_h", id_col).limit(size)
    return more.select(df.columns)


def grid_cover(df: DataFrame, features: list[str], h: float, *, id_col: str = "event_id") -> DataFrame:
    """One event for each cell of a grid of side h, that of the least hash: one aggregate, but an event may be h times the root of the dimensions away from its cell's."""
    cell = [F.floor(F.col(f).cast("double") / h).alias(f"_{i}") for i, f in enumerate(features)]
    best = df.select(*cell, id_col).groupBy(*[f"_{i}" for i in range(len(features))]).agg(F.min_by(id_col, key(id_col)).alias(id_col))
    return df.join(best.select(id_col), id_col, "left_semi")


OPEN, KEPT, COVERED = 0, 1, 2
#: Events that come first in hash order, whose cover is made on the driver and sent to all tasks.
FIRST = 2048


def faithful_downsample(df: DataFrame, features: list[str], h: float, *, id_col: str = "event_id", seed: int = 0, first: int = FIRST, most: int | None = None) -> DataFrame:
    """A faithful cover: every event with all features is within h of a kept one, and kept ones are more than h apart.

    It is the cover that takes events one after another in hash order and leaves out what is within h of one taken before. The `first` events are
    taken so on the driver, and what they cover is left out in one pass, which is nearly all where h is large. The rest goes in rounds: an event that is
    the first of all open ones within h is kept, and what is within h of it is covered. Each block looks 2 h beyond its own cell, so a round
    is one pass, and a block goes on as long as what it needs is in sight.
    """
    from ..session import stored
    from . import space

    rows = df.select(F.col(id_col).alias("_id"), F.array(*[number(f) + F.lit(0.0) for f in features]).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    spots = rows.groupBy("x").agg(F.min(F.struct(F.md5(F.concat(F.col("_id").cast("string"), F.lit(f":{seed}"))).alias("h"), F.col("_id").alias("id"))).alias("m"))  # of equal events the first
    spots = stored(spots.select(F.monotonically_increasing_id().alias("pid"), "x", F.col("m.h").alias("order"), F.col("m.id").alias("_id"), F.lit(OPEN).alias("state")), "events")

    head = spots.orderBy("order", "_id").limit(first).select("pid", "x").collect()
    taken: list[int] = []
    points = np.array([r.x for r in head], float).reshape(len(head), len(features))
    for i in range(len(head)):
        if not taken or space.distances(points[i : i + 1], points[taken]).min() > h:
            taken.append(i)
    ids, kept_x = np.array([head[i].pid for i in taken], np.int64), points[taken]

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, state = space.matrix(b), np.full(b.num_rows, OPEN, np.int32)
            for part in space.in_parts(len(x), len(kept_x)):
                state[part][(space.distances(x[part], kept_x) <= h).any(1)] = COVERED
            state[np.isin(b.column("pid").to_numpy(), ids)] = KEPT
            yield b.set_column(b.schema.get_field_index("state"), "state", pa.array(state))

    spots = stored(spots.mapInArrow(cover, spots.schema), "events")
    kept, left = spots.where(F.col("state") == KEPT).select("_id"), spots.where(F.col("state") == OPEN)
    if not left.isEmpty():
        kept = kept.unionByName(_cover_in_rounds(left, len(features), h, most))
    return df.join(kept.select(F.col("_id").alias(id_col)), id_col, "left_semi")


def _cover_in_rounds(left: DataFrame, dims: int, h: float, most: int | None) -> DataFrame:
    from ..session import stored
    from . import space

    blocks = space.Blocks.of(left, dims, **({"most": most} if most else {}))
    low, high = blocks.cells()
    homes = stored(space.dealt(left, blocks), "homes")

    def settle(a: pa.Table) -> pa.Table:
        """States of the block's own events, from those of all within 2 h of its cell."""
        leaf = a.column("leaf")[0].as_py()
        x, state, own = space.matrix(a), a.column("state").to_numpy().copy(), a.column("home").to_numpy() == leaf
        rank = np.argsort(np.lexsort((a.column("_id").to_numpy(zero_copy_only=False), a.column("order").to_numpy(zero_copy_only=False))))
        away = np.sqrt((np.maximum(np.maximum(low[leaf] - x, x - high[leaf]), 0) ** 2).sum(1))
        sure = away <= h  # their neighbours are all in sight
        new = np.flatnonzero(state == KEPT)
        while True:
            at = np.flatnonzero(state == OPEN)
            for part in space.in_parts(len(at), len(new)) if len(new) else ():
                near = (space.distances(x[at[part]], x[new]) <= h).any(1)
                state[at[part][near]] = COVERED
            at = np.flatnonzero(state == OPEN)
            first = np.full(len(at), len(x))
            for part in space.in_parts(len(at), len(at)):
                first[part] = np.where(space.distances(x[at[part]], x[at]) <= h, rank[at][None], len(x)).min(1)
            new = at[(first == rank[at]) & sure[at]]
            if not len(new):
                break
            state[new] = KEPT
        return pa.table({"pid": a.column("pid").to_numpy()[own], "now": state[own].astype(np.int32)})

    while True:
        found = space.asking(homes, blocks, 2 * h).groupBy("leaf").applyInArrow(settle, "pid long, now int")
        homes = stored(homes.join(found, "pid").select("pid", "x", "order", "_id", F.col("now").alias("state"), "home"), "homes")
        if homes.where(F.col("state") == OPEN).isEmpty():
            return homes.where(F.col("state") == KEPT).select("_id")


def oversample(df: DataFrame, label: str, *, id_col: str = "event_id", seed: int = 0) -> DataFrame:
    """Minority classes repeated up to the majority's count: whole copies, then the rest by hash order."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    counts.pop(None, None)
    most = max(counts.values(), default=0)
    if not most:
        return df.withColumn("copy", F.lit(1)).limit(0)
    copies = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, most // n)])
    extra = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, most % n)])
    known = df.where(F.col(label).isNotNull())
    whole = known.withColumn("copy", F.explode(F.sequence(F.lit(1), copies[F.col(label)])))
    rest = first_by_hash(known, [label], extra[F.col(label)], id_col=id_col, seed=seed)
    return whole.unionByName(rest.withColumn("copy", copies[F.col(label)] + 1))


def knn_predict(df: DataFrame, labelled: DataFrame, features: list[str], label: str, k: int, *, to: str = "predicted") -> DataFrame:
    """df with the label most common among the k nearest labelled rows (at most TREE_ROWS, sent to every executor); ties go to the smaller label."""
    got = labelled.select(*[F.col(f).cast("double").alias(f) for f in features], label).limit(TREE_ROWS + 1).toPandas()
    if len(got) > TREE_ROWS:
        raise ValueError(f"more than {TREE_ROWS} labelled rows; sample them first")
    points, (codes, names) = got[features].to_numpy(float), pd.factorize(got[label], sort=True)
    step = max(1, 2_000_000 // max(1, len(points)))
    k = min(k, len(points))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, out = pdf[features].to_numpy(float), []
            for i in range(0, len(x), step):
                near = np.argpartition(_distances(x[i : i + step], points, "euclidean"), k - 1, axis=1)[:, :k]
                votes = np.zeros((len(near), len(names)))
                np.add.at(votes, (np.arange(len(near))[:, None], codes[near]), 1)
                out.append(votes.argmax(axis=1))
            yield pdf.assign(**{to: np.asarray(names)[np.concatenate(out)] if out else None})

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(to, labelled.schema[label].dataType)]))


def best_neighbours(labelled: DataFrame, features: list[str], label: str, candidates: list[int], *, id_col: str = "event_id", folds: int = 10) -> int:
    """The k of greatest balanced accuracy over folds by hash."""
    fold = F.pmod(F.xxhash64(id_col), F.lit(folds))
    best = (-1.0, 0)
    for k in candidates:
        scores = []
        for i in range(folds):
            rest, held = labelled.where(fold != i), labelled.where(fold == i)
            done = knn_predict(held, rest, features, label, k).groupBy(label).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("r"))
            if (score := done.agg(F.avg("r").alias("r")).head().r) is not None:
                scores.append(score)
        best = max(best, (sum(scores) / len(scores) if scores else 0.0, -k))
    return -best[1]
