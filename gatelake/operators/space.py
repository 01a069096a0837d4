"""Neighbours among all events, exactly: blocks of space of bounded size, and the blocks that a search reaches.

A k-d tree is cut until no block has more than BLOCK_ROWS places (a place is what events with equal coordinates share, so copies of an event are one row
with a count). Each level is one aggregate of counts and approximate quantiles; the cuts' quality changes blocks, not results. The tree has a few
numbers for every BLOCK_ROWS places and is sent to every task.

A search asks every block whose cell it reaches. A block that many searches ask is dealt to several tasks, so a task has at most BLOCK_ROWS places and
about ASKING searches, and it measures them a few million distances at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import number
from ..session import stored

#: Places of a block; searches that a task holds; ways that a block is cut in one pass; distances measured at a time.
BLOCK_ROWS, ASKING, WAYS, AT_ONCE = 1024, 8192, 16, 2_000_000


def located(events: DataFrame, features: list[str], id_col: str = "event_id") -> DataFrame:
    """id (long) and x, the coordinates, of the events that have all features."""
    if events.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} isn't an integer; number the events first")
    rows = events.select(F.col(id_col).cast("long").alias("id"), *[(number(f) + F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)]).dropna(subset=["id", *[f"_{i}" for i in range(len(features))]])
    return rows.select("id", F.array(*[f"_{i}" for i in range(len(features))]).alias("x"))


def side_by_side(events: DataFrame, features: list[str], by: str, id_col: str = "event_id") -> tuple[DataFrame, float]:
    """`located` events with one more coordinate, by which groups are farther apart than any events of one group are; and how far.

    A search for all groups is then one search: what is at least that far away is of another group.
    """
    rows = located(events, features, id_col)
    xs = [F.col("x")[i] for i in range(len(features))]
    r = rows.agg(*[(F.max(x) - F.min(x)).alias(f"r{i}") for i, x in enumerate(xs)]).head()
    gap = 4.0 * (1.0 + sum(v or 0.0 for v in r))
    groups = stored(events.select(F.col(by).alias("_by")).distinct().withColumn("_at", F.monotonically_increasing_id()), "groups")
    order = stored(groups.withColumn("_g", F.row_number().over(Window.orderBy("_at"))).drop("_at"), "groups")  # a row a group
    of = events.select(F.col(id_col).cast("long").alias("id"), F.col(by).alias("_by")).join(order, "_by", "left")  # a null group is one, too
    at = F.concat("x", F.array(F.coalesce("_g", F.lit(0)).cast("double") * gap))
    return rows.join(of.select("id", "_g"), "id").select("id", at.alias("x")), gap


def places(located: DataFrame, ids: int = 1) -> DataFrame:
    """pid (the smallest id of a place), x, n (its events) and ids, the `ids` smallest ones."""
    salted = Window.partitionBy("x", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = located.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= ids).groupBy("x").agg(F.slice(F.array_sort(F.collect_list("id")), 1, ids).alias("ids"))
    if ids == 1:
        return located.groupBy("x").agg(F.min("id").alias("pid"), F.count("*").alias("n")).select("pid", "x", "n", F.array("pid").alias("ids"))
    return located.groupBy("x").agg(F.min("id").alias("pid"), F.count("*").alias("n")).join(few, "x").select("pid", "x", "n", "ids")


def matrix(table: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    """A list column of equal lengths as rows of numbers."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances, each in the same order of operations wherever it is measured."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[None, :, i]
        out += np.abs(d) if metric == "manhattan" else d * d
    return out if metric == "manhattan" else np.sqrt(out)


def in_parts(n: int, m: int) -> Iterator[slice]:
    """Slices of n rows that have AT_ONCE distances to m others each."""
    step = max(1, AT_ONCE // max(1, m))
    for i in range(0, n, step):
        yield slice(i, min(n, i + step))


class Blocks:
    """Cells of a k-d tree: nodes have an axis, a cut (below it is left) and two children; a child of -1 - i is leaf i."""

    def __init__(self, dims: int) -> None:
        self.axis, self.cut, self.child, self.leaves, self.root, self.dims = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 2), np.int64), 1, -1, dims

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            at[inner] = self.child[node, (x[inner, self.axis[node]] >= self.cut[node]).astype(int)]
        return -1 - at

    def near(self, x: np.ndarray, radius: np.ndarray, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: every leaf whose cell is within radius of the row."""
        rows, found = [], []
        limit = radius * (1 + 1e-9) if metric == "manhattan" else (radius * (1 + 1e-9)) ** 2
        todo = [(self.root, np.arange(len(x)), np.zeros(x.shape))]
        while todo:
            node, own, off = todo.pop()
            if node < 0:
                rows.append(own)
                found.append(np.full(len(own), -1 - node))
                continue
            a = self.axis[node]
            gap = x[own, a] - self.cut[node]
            for side, outside in ((0, gap >= 0), (1, gap < 0)):
                far = off.copy()
                far[outside, a] = np.maximum(off[outside, a], np.abs(gap[outside]))
                inside = (far.sum(1) if metric == "manhattan" else (far * far).sum(1)) <= limit[own]
                if inside.any():
                    todo.append((self.child[node, side], own[inside], far[inside]))
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The lower and upper corner of every leaf's cell; infinite at the outside."""
        low, high = np.full((self.leaves, self.dims), -np.inf), np.full((self.leaves, self.dims), np.inf)
        todo = [(self.root, np.full(self.dims, -np.inf), np.full(self.dims, np.inf))]
        while todo:
            node, lo, hi = todo.pop()
            if node < 0:
                low[-1 - node], high[-1 - node] = lo, hi
                continue
            a, cut = self.axis[node], self.cut[node]
            for side in (0, 1):
                lo2, hi2 = lo.copy(), hi.copy()
                (hi2 if side == 0 else lo2)[a] = cut
                todo.append((self.child[node, side], lo2, hi2))
        return low, high

    def _split(self, splits: dict[int, tuple[int, list[float]]]) -> None:
        """Cut leaves along an axis at ascending places."""
        axis, cut, child = self.axis.tolist(), self.cut.tolist(), self.child.tolist()
        new = {}

        def grow(leaf: int | None, a: int, cuts: list[float]) -> int:
            if not cuts:
                if leaf is None:
                    self.leaves += 1
                    leaf = self.leaves - 1
                return -1 - leaf
            mid, at = len(cuts) // 2, len(axis)
            axis.append(a)
            cut.append(cuts[mid])
            child.append([0, 0])
            child[at] = [grow(leaf, a, cuts[:mid]), grow(None, a, cuts[mid + 1 :])]
            return at

        for leaf, (a, cuts) in splits.items():
            new[leaf] = grow(leaf, a, cuts)
        point = lambda c: new.get(-1 - c, c) if c < 0 else c
        first = len(self.axis)
        self.root = point(self.root)
        self.axis, self.cut = np.array(axis, np.int64), np.array(cut)
        self.child = np.array([[point(c) for c in pair] if i < first else pair for i, pair in enumerate(child)], np.int64).reshape(-1, 2)

    @classmethod
    def of(cls, rows: DataFrame, dims: int, most: int = BLOCK_ROWS) -> Blocks:
        """Cells with at most `most` rows of rows(x); of rows with equal x there may be more."""
        out = cls(dims)
        xs = [F.col("x")[i] for i in range(dims)]
        full = rows.agg(F.count("*").alias("n")).head().n > most
        done: set[int] = set()
        while full:
            cuts = [F.percentile_approx(x, F.array(*[F.lit((j + 1) / WAYS) for j in range(WAYS - 1)]), F.lit(1000)).alias(f"q{i}") for i, x in enumerate(xs)]
            stats = dealt(rows.select("x"), out).groupBy("home").agg(F.count("*").alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (("lo", F.min), ("hi", F.max))], *cuts).where(F.col("n") > most)
            splits = {}
            for r in stats.collect():  # a row for each block that is still too large
                if r.home in done:
                    continue
                a = max(range(dims), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
                lo, hi = r[f"lo{a}"], r[f"hi{a}"]
                if not lo < hi:
                    done.add(r.home)
                    continue
                q = r[f"q{a}"]
                ways = min(WAYS, -(-r.n * 4 // (3 * most)))
                some = sorted({q[min(WAYS - 2, round(j * WAYS / ways) - 1)] for j in range(1, ways)} - {lo})
                splits[r.home] = (a, some or [hi if (lo + hi) / 2 <= lo else (lo + hi) / 2])
            full = bool(splits)
            out._split(splits)
        return out


def dealt(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """rows(x, ...) with home, the leaf that each is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("home", pa.array(blocks.leaf(matrix(b)) if b.num_rows else np.zeros(0, np.int64), pa.int64()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("home", T.LongType())]))


def asking(rows: DataFrame, blocks: Blocks, radius: str | float, metric: str = "euclidean", others: bool = False) -> DataFrame:
    """rows(x, home, ...) once for every leaf within radius (a number or a column), named in `leaf`; with `others`, not for their home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                r = part.column(radius).to_numpy(zero_copy_only=False) if isinstance(radius, str) else np.full(part.num_rows, float(radius))
                row, leaf = blocks.near(matrix(part), r, metric)
                if others:
                    keep = leaf != part.column("home").to_numpy()[row]
                    row, leaf = row[keep], leaf[keep]
                yield part.take(pa.array(row)).append_column("leaf", pa.array(leaf, pa.int64()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())]))


def answered(asks: DataFrame, homes: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most: int = ASKING) -> DataFrame:
    """f(searches, places) for each leaf: asks(leaf, pid, ...) and homes(home, ...). A leaf with over `most` searches is dealt to several tasks."""
    asks = stored(asks, "asking")
    busy = asks.groupBy("leaf").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1")
    homes = homes.withColumnRenamed("home", "leaf")
    if not busy.isEmpty():
        asks = asks.join(busy, "leaf", "left").withColumn("_deal", F.pmod(F.xxhash64("pid"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        homes = homes.join(busy, "leaf", "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    else:
        asks, homes = asks.withColumn("_deal", F.lit(0)), homes.withColumn("_deal", F.lit(0))
    return asks.groupBy("leaf", "_deal").cogroup(homes.groupBy("leaf", "_deal")).applyInArrow(f, schema)


NEAR = "pid long, d array<double>, id array<long>"


def _closest(pid: np.ndarray, x: np.ndarray, there: pa.Table, k: int, metric: str = "euclidean") -> pa.Table:
    """For each search the k nearest events of the places, by distance, then id."""
    y, lists = matrix(there), there.column("ids").combine_chunks()
    ids, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    order = np.argsort(ids, kind="stable")
    ids, at = ids[order], np.repeat(np.arange(len(y)), sizes)[order]
    ds, out_ids, counts = [], [], []
    for part in in_parts(len(x), len(ids)):
        d = distances(x[part], y, metric)[:, at]
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        row, col = np.nonzero(d <= last[:, None])
        by = np.lexsort((col, d[row, col], row))
        row, col = row[by], col[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        ds.append(d[row, col])
        out_ids.append(ids[col])
        counts.append(np.bincount(row, minlength=d.shape[0]))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else [0], pa.int32())
    flat = lambda v, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else [], kind))
    return pa.table({"pid": pa.array(pid, pa.int64()), "d": flat(ds, pa.float64()), "id": flat(out_ids, pa.int64())})


def nearest_to_places(homes: DataFrame, blocks: Blocks, k: int, metric: str = "euclidean") -> DataFrame:
    """pid, near: the k nearest events (d, id) of each place, its own among them. homes has ids, k of each place at least or all."""
    own = stored(homes.groupBy("home").applyInArrow(lambda t: _closest(t.column("pid").to_numpy(), matrix(t), t, k, metric), NEAR), "own_block")
    if blocks.leaves == 1:
        return own.select("pid", F.arrays_zip("d", "id").alias("near"))
    reach = F.when(F.size("d") < k, float("inf")).otherwise(F.element_at("d", -1))
    asks = asking(homes.drop("ids", "n").join(own.select("pid", reach.alias("reach")), "pid"), blocks, "reach", metric, others=True)

    def there(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.slice(0, a.num_rows if b.num_rows else 0)
        return _closest(a.column("pid").to_numpy(), matrix(a), b, k, metric)

    more = answered(asks, homes.select("home", "x", "ids"), there, NEAR)
    every = own.unionByName(more).select("pid", F.arrays_zip("d", "id").alias("near"))
    return every.groupBy("pid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def nearest_of(rows: DataFrame, dims: int, k: int, beyond: float | None = None) -> DataFrame:
    """id, near: the k nearest other events (d, id) of every row of rows(id, x), by distance, then id; none as far as `beyond` or farther."""
    spots = stored(places(rows, k + 1), "places")
    blocks = Blocks.of(spots, dims)
    near = nearest_to_places(dealt(spots, blocks), blocks, k + 1)
    joined = rows.join(spots.select("pid", "x"), "x").join(near, "pid")
    limit = F.lit(float("inf") if beyond is None else beyond)
    return joined.select("id", F.slice(F.filter("near", lambda e: (e["id"] != F.col("id")) & (e["d"] < limit)), 1, k).alias("near"))


def nearest(events: DataFrame, features: list[str], k: int, id_col: str = "event_id", by: str | None = None) -> DataFrame:
    """id, near: the k nearest other events (d, id) of every event that has all features; of the same group, if `by` names one."""
    if by is None:
        return nearest_of(located(events, features, id_col), len(features), k)
    rows, gap = side_by_side(events, features, by, id_col)
    return nearest_of(rows, len(features) + 1, k, gap)


def counts_within(homes: DataFrame, blocks: Blocks, radius: float, metric: str = "euclidean", among: DataFrame | None = None) -> DataFrame:
    """pid, within: events of among(x, home, n) (by default of homes) within radius of each place of homes(pid, x, home), its own included."""

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, n = matrix(a), matrix(b), b.column("n").to_numpy()
        got = [(distances(x[p], y, metric) <= radius) @ n for p in in_parts(len(x), len(y))] if len(y) else [np.zeros(len(x), np.int64)]
        return pa.table({"pid": a.column("pid"), "within": pa.array(np.concatenate(got) if got else [], pa.int64())})

    asks = asking(homes.select("pid", "x", "home"), blocks, radius, metric)
    return answered(asks, (homes if among is None else among).select("home", "x", "n"), count, "pid long, within long").groupBy("pid").agg(F.sum("within").alias("within"))
