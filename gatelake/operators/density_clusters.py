"""Clusters of any shape: DBSCAN, and HDBSCAN over the tree of mutual reachability. Every event is seen, at exact distances.

Both work on places (events with equal coordinates, with their number) in blocks of space, see `space`. DBSCAN's blocks return, for each core
place, one place that it is connected with, never pairs. HDBSCAN's tree is made inside blocks where no other block can offer a shorter edge, and by
rounds over all blocks for the rest; its hierarchy is cut on the driver, which takes up to TREE_PLACES places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .graph import components, numbered
from .space import Blocks, answered, asking, counts_within, dealt, distances, in_parts, located, matrix, nearest_to_places, places

#: Places whose hierarchy the driver cuts; more are an error.
TREE_PLACES = 2_000_000
NOISE = -1


def dbscan(rows: DataFrame, eps: float, least: int = 5, *, most: int | None = None, driver_edges: int | None = None) -> DataFrame:
    """id, label of rows(id, x): clusters from 0, in the order of their smallest core place, or -1 for noise.

    A place is core if at least `least` events (its own among them) are within eps. Core places within eps of one another are a cluster; what
    isn't core belongs to its nearest core place within eps (of equally near ones to the smallest id).
    """
    spots = stored(places(rows), "places")
    blocks = Blocks.of(spots, _dims(spots), **({"most": most} if most else {}))
    homes = stored(dealt(spots.drop("ids"), blocks), "homes")
    found = counts_within(homes, blocks, eps)
    homes = stored(homes.join(found, "pid").withColumn("core", F.col("within") >= least).drop("within"), "cores")
    core, rest = homes.where("core").select("pid", "x", "home"), homes.where("NOT core").select("pid", "x", "home")

    def links(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, p, q = matrix(a), matrix(b), a.column("pid").to_numpy(), b.column("pid").to_numpy()
        # every search is connected with the first place that it reaches, and each of those with the first one among all searches
        first, low = np.full(len(x), -1, np.int64), np.arange(len(q))
        for part in in_parts(len(x), len(y)) if len(y) else ():
            near = distances(x[part], y) <= eps
            some = near.any(1)
            lead = near.argmax(1)
            first[np.arange(len(x))[part][some]] = lead[some]
            row, col = np.nonzero(near)
            low = _united(low, lead[row], col)
        known = np.flatnonzero(first >= 0)
        tops = low[first[known]]
        return pa.table({"a": np.concatenate([p[known], q]).astype(np.int64), "b": np.concatenate([q[tops], q[low]]).astype(np.int64)})

    edges = answered(asking(core, blocks, eps), core, links, "a long, b long")
    comps = components(edges, driver_edges)

    def nearest_core(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, q = matrix(a), matrix(b), b.column("pid").to_numpy()
        order = np.argsort(q, kind="stable")
        y, q = y[order] if len(q) else y, q[order]
        best, d = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for part in in_parts(len(x), len(y)) if len(y) else ():
            all_d = distances(x[part], y)
            at = all_d.argmin(1)
            best[part], d[part] = q[at], all_d[np.arange(len(at)), at]
        keep = d <= eps
        return pa.table({"pid": a.column("pid").to_numpy()[keep].astype(np.int64), "d": d[keep], "core": best[keep]})

    border = answered(asking(rest, blocks, eps), core, nearest_core, "pid long, d double, core long").groupBy("pid").agg(F.min(F.struct("d", "core")).alias("m")).select("pid", F.col("m.core").alias("id"))
    of = comps.select(F.col("id").alias("pid"), "component").unionByName(border.join(comps, "id").select("pid", "component"))
    labels = of.join(numbered(comps.select("component"), "component", "label"), "component").select("pid", "label")
    return _to_events(rows, spots, labels)


def _dims(spots: DataFrame) -> int:
    got = spots.select(F.size("x").alias("n")).head()
    return got.n if got else 1


def _united(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels low (each the least of its set) after a[i] and b[i] are joined."""
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while (new != (again := new[new])).any():
            new = again
        new = new[low]
        if (new == low).all():
            return low
        low = new


def _to_events(rows: DataFrame, spots: DataFrame, labels: DataFrame) -> DataFrame:
    named = spots.select("pid", "x").join(labels, "pid", "left").select("x", F.coalesce("label", F.lit(NOISE)).cast("int").alias("label"))
    return rows.join(named, "x").select("id", "label")


def core_distances(spots: DataFrame, blocks: Blocks, least: int, beyond: float | None = None) -> DataFrame:
    """pid, x, n, home and core, the distance to the `least`-th nearest event, its own counted; infinite if fewer are nearer than `beyond`."""
    homes = stored(dealt(spots, blocks), "homes")
    last = F.get("near", F.lit(least - 1))["d"]
    known = last.isNotNull() if beyond is None else last < beyond
    near = nearest_to_places(homes, blocks, least).select("pid", F.when(known, last).otherwise(float("inf")).alias("core"))
    return homes.drop("ids").join(near, "pid")



def reachability_tree(spots: DataFrame, blocks: Blocks) -> DataFrame:
    """a, b, w: a minimum spanning tree of spots(pid, x, home, core) under max(core of both, distance).

    In its block a set of places is joined with its nearest other one as long as that is nearer than anything beyond the block's cell can be. What
    is left is joined in rounds: each set finds its nearest place of another set, among the blocks that a bound from the blocks' boxes leaves.
    """
    spark = spots.sparkSession
    low, high = blocks.cells()
    kept = stored(spots.select("pid", "x", "home", "core"), "spots")

    def inside(t: pa.Table) -> pa.Table:
        x, pid, core = matrix(t), t.column("pid").to_numpy(), t.column("core").to_numpy(zero_copy_only=False)
        home = t.column("home")[0].as_py()
        beyond = np.maximum(core, np.minimum(x - low[home], high[home] - x).min(1))
        a, b, w = _prim(x, core)
        low_of, bound, out = np.arange(len(x)), beyond.copy(), []
        for i in np.argsort(w, kind="stable"):
            p, q = _root(low_of, a[i]), _root(low_of, b[i])
            if w[i] < bound[p] or w[i] < bound[q]:
                p, q = min(p, q), max(p, q)
                low_of[q] = p
                bound[p] = min(bound[p], bound[q])
                out.append(i)
        roots = np.array([_root(low_of, i) for i in range(len(x))])
        least = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, pid)
        out = np.array(out, int)
        n = len(out)
        return pa.table({"pid": np.concatenate([pid, np.zeros(n, np.int64)]), "part": np.concatenate([least[roots], np.zeros(n, np.int64)]), "a": np.concatenate([np.zeros(len(x), np.int64), pid[a[out]]]), "b": np.concatenate([np.zeros(len(x), np.int64), pid[b[out]]]), "w": np.concatenate([np.full(len(x), -1.0), w[out]])})

    first = stored(kept.groupBy("home").applyInArrow(inside, "pid long, part long, a long, b long, w double"), "inside")
    tree = first.where("w >= 0").select("a", "b", "w")
    if blocks.leaves == 1:
        return tree
    state = stored(kept.join(first.where("w < 0").select("pid", "part"), "pid"), "parts")
    trees = [tree]
    while state.select("part").distinct().limit(2).count() > 1:
        found = _nearest_parts(state, blocks).toArrow().to_pandas()  # a row for each set of places: fewer than half as many each round
        edges = found.sort_values(["w", "a", "b"], kind="stable").drop_duplicates(["a", "b"])
        # sets by their edges: the order of (w, a, b) has no cycle
        names, where = np.unique(np.concatenate([edges["pa"], edges["pb"]]), return_inverse=True)
        to, keep = np.arange(len(names)), np.zeros(len(edges), bool)
        for i, (p, q) in enumerate(zip(where[: len(edges)].tolist(), where[len(edges) :].tolist(), strict=True)):
            p, q = _root(to, p), _root(to, q)
            if p != q:
                to[max(p, q)], keep[i] = min(p, q), True
        trees.append(spark.createDataFrame(pa.Table.from_pandas(edges.loc[keep, ["a", "b", "w"]], preserve_index=False)))
        new = pd.DataFrame({"part": names, "now": names[[_root(to, i) for i in range(len(names))]]}).astype("int64")
        state = stored(state.join(spark.createDataFrame(pa.Table.from_pandas(new, preserve_index=False)), "part").select("pid", "x", "home", "core", F.col("now").alias("part")), "parts")
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out


def _root(to: np.ndarray, i: int) -> int:
    while to[i] != i:
        to[i] = to[to[i]]
        i = to[i]
    return int(i)


def _prim(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of a spanning tree of one block."""
    n = len(x)
    a, b, w = np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0))
    cost, near, out, at = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0
    for i in range(n - 1):
        out[at] = False
        d = np.maximum(np.maximum(core, core[at]), distances(x[at : at + 1], x)[0])
        better = out & ((d < cost) | ~np.isfinite(cost))
        cost[better], near[better] = d[better], at
        at = int(np.flatnonzero(out)[cost[out].argmin()])
        a[i], b[i], w[i] = near[at], at, cost[at]
    return a, b, w


def _nearest_parts(state: DataFrame, blocks: Blocks) -> DataFrame:
    """part's nearest place of another part: pa, pb (parts), a < b (places), w, the least by w, a, b."""
    dims = _dims(state)
    xs = [F.col("x")[i] for i in range(dims)]
    boxes = state.groupBy("home").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max("core").alias("core"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (("lo", F.min), ("hi", F.max))]).toArrow().to_pandas()  # a row a block
    home = boxes["home"].to_numpy()
    pure = np.full(blocks.leaves, -1, np.int64)
    pure[home] = np.where(boxes["p"] == boxes["q"], boxes["p"], -1)
    lo, hi, most = boxes[[f"lo{i}" for i in range(dims)]].to_numpy(float), boxes[[f"hi{i}" for i in range(dims)]].to_numpy(float), boxes["core"].to_numpy(float)
    alone = pure[home]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """No place of another part in a block is farther than the far corner of its box."""
        for b in batches:
            x, core, part = matrix(b), b.column("core").to_numpy(zero_copy_only=False), b.column("part").to_numpy()
            out = np.full(len(x), np.inf)
            for s in in_parts(len(x), len(home)):
                far = np.zeros((s.stop - s.start, len(home)))
                for i in range(dims):
                    far += np.maximum(np.abs(x[s, i, None] - lo[None, :, i]), np.abs(x[s, i, None] - hi[None, :, i])) ** 2
                reach = np.maximum(np.maximum(np.sqrt(far), core[s, None]), most[None])
                reach[part[s, None] == alone[None]] = np.inf
                out[s] = reach.min(1)
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(out)], names=["part", "bound"])

    one = state.groupBy("home", "part").agg(F.min_by(F.struct("x", "core"), "pid").alias("s")).select("part", "s.x", "s.core")  # one place of each part and block
    bound = one.mapInArrow(bounds, "part long, bound double").groupBy("part").agg(F.min("bound").alias("bound"))
    asks = asking(state.join(bound, "part").where("core <= bound"), blocks, "bound")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pure[b.column("leaf").to_numpy()] != b.column("part").to_numpy()
            yield b.filter(pa.array(keep))

    def least(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, p, q = matrix(a), matrix(b), a.column("part").to_numpy(), b.column("part").to_numpy()
        ca, cb, ia, ib = a.column("core").to_numpy(zero_copy_only=False), b.column("core").to_numpy(zero_copy_only=False), a.column("pid").to_numpy(), b.column("pid").to_numpy()
        rows = []
        for s in in_parts(len(x), len(y)) if len(y) else ():
            w = np.maximum(np.maximum(distances(x[s], y), ca[s, None]), cb[None])
            w[p[s, None] == q[None]] = np.inf
            best = w.min(1)
            i, j = np.nonzero((w == best[:, None]) & np.isfinite(w))
            u, v = ia[s][i], ib[j]
            rows.append(pd.DataFrame({"pa": p[s][i], "pb": q[j], "a": np.minimum(u, v), "b": np.maximum(u, v), "w": w[i, j]}))
        got = pd.concat(rows) if rows else pd.DataFrame({"pa": [], "pb": [], "a": [], "b": [], "w": []})
        got = got.astype({"pa": "int64", "pb": "int64", "a": "int64", "b": "int64"}).sort_values(["w", "a", "b"]).drop_duplicates("pa")
        return pa.Table.from_pandas(got, preserve_index=False)

    asks = asks.mapInArrow(others, asks.schema)
    found = answered(asks, state.select("home", "x", "core", "part", "pid"), least, "pa long, pb long, a long, b long, w double")
    return found.groupBy("pa").agg(F.min(F.struct("w", "a", "b", "pb")).alias("m")).select("pa", "m.pb", "m.a", "m.b", "m.w")


def hierarchy(a: np.ndarray, b: np.ndarray, w: np.ndarray, size: np.ndarray, core: np.ndarray, least: int) -> np.ndarray:
    """Labels (-1 for noise) of places 0... by the most stable branches of a spanning tree's hierarchy.

    Edges of one weight are taken at once. Sets that together have `least` events or more become a branch. What joins a single branch later leaves
    it as it is; where two branches or more meet, they end and a new one begins. A branch's stability is the sum over its events of 1 / w where they
    join it, less 1 / w where it ends; the branches chosen have more than all that they are made of. The whole (of each hierarchy) is never chosen.
    """
    n, alone = len(size), np.flatnonzero(size >= least)  # copies of one event are together from their core distance on
    a, b, w = np.concatenate([a, alone]).tolist(), np.concatenate([b, alone]).tolist(), np.concatenate([w, core[alone]])
    order, w = np.argsort(w, kind="stable").tolist(), w.tolist()
    to, total, branch, home = list(range(n)), size.tolist(), [-1] * n, [-1] * n
    head, tail, after = list(range(n)), list(range(n)), [-1] * n  # chains of places that are in no branch yet
    children: list[list[int]] = []
    joined: list[float] = []
    stable: list[float | None] = []

    def root(i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    i = 0
    while i < len(order):
        j, touched = i, set()
        while j < len(order) and w[order[j]] == w[order[i]]:
            touched |= {root(a[order[j]]), root(b[order[j]])}
            j += 1
        for e in order[i:j]:
            p, q = root(a[e]), root(b[e])
            to[max(p, q)] = min(p, q)
        value = 1 / w[order[i]] if w[order[i]] > 0 else 1e100
        met: dict[int, list[int]] = {}
        for s in sorted(touched):
            met.setdefault(root(s), []).append(s)
        for top, sets in met.items():
            big, small = [s for s in sets if branch[s] >= 0], [s for s in sets if branch[s] < 0]
            count, few = sum(total[s] for s in sets), sum(total[s] for s in small)
            if len(sets) == 1 and (big or count < least):
                continue
            own = -1
            if len(big) == 1:
                own = branch[big[0]]
                joined[own] += value * few
            elif big or count >= least:
                own = len(children)
                children.append([branch[s] for s in big])
                joined.append(value * count)
                stable.append(None)
                for s in big:
                    stable[branch[s]] = joined[branch[s]] - value * total[s]
            if own >= 0:
                for s in small:
                    at = head[s]
                    while at >= 0:
                        home[at], at = own, after[at]
            else:
                for s, t in zip(small[:-1], small[1:], strict=True):
                    after[tail[s]] = head[t]
                head[top], tail[top] = head[small[0]], tail[small[-1]]
            total[top], branch[top] = count, own
        i = j
    best, chosen, pick = [0.0] * len(children), [False] * len(children), [-1] * len(children)
    for c, below in enumerate(children):  # children come before their parents
        under = sum(best[k] for k in below)
        chosen[c] = stable[c] is not None and stable[c] >= under
        best[c] = stable[c] if chosen[c] else under
    for c in range(len(children) - 1, -1, -1):
        for k in children[c]:
            pick[k] = pick[c] if pick[c] >= 0 else k if chosen[k] else -1
    return np.array([pick[c] if c >= 0 else NOISE for c in home], np.int64)


def hdbscan(rows: DataFrame, least: int = 5, samples: int | None = None, *, beyond: float | None = None, most: int | None = None) -> DataFrame:
    """id, label of rows(id, x): clusters of at least `least` events, from 0 in the order of their smallest id, or -1 for noise.

    A place's core distance reaches `samples` events (by default `least`), its own among them. Core distances and the tree are found for all events;
    the hierarchy is cut on the driver, and more than TREE_PLACES places are an error. Events that are `beyond` or farther apart are in separate hierarchies.
    """
    samples = samples or least
    spots = stored(places(rows, samples), "places")
    if (n := spots.count()) > TREE_PLACES:
        raise ValueError(f"{n} places; the hierarchy takes {TREE_PLACES}: sample the events first, or use dbscan")
    if not n:
        return rows.select("id", F.lit(NOISE).alias("label"))
    blocks = Blocks.of(spots, _dims(spots), **({"most": most} if most else {}))
    cores = stored(core_distances(spots, blocks, samples, beyond), "core_distances")
    tree = reachability_tree(cores, blocks)
    tree = (tree if beyond is None else tree.where(F.col("w") < beyond)).toArrow()
    known = cores.select("pid", "n", "core").toArrow()
    pid = known.column("pid").to_numpy()
    order = np.argsort(pid, kind="stable")
    pid, size, core = pid[order], known.column("n").to_numpy()[order], known.column("core").to_numpy()[order]
    label = hierarchy(np.searchsorted(pid, tree.column("a").to_numpy()), np.searchsorted(pid, tree.column("b").to_numpy()), tree.column("w").to_numpy(), size, core, least)
    found = label >= 0
    _, first, by = np.unique(label[found], return_index=True, return_inverse=True)
    label[found] = np.argsort(np.argsort(first))[by]
    named = rows.sparkSession.createDataFrame(pa.table({"pid": pid[found], "label": label[found]}))
    return _to_events(rows, spots, named)
