"""Exact n-gram Jaccard join by T-occurrence search, and its connected components.

1. Documents with equal shingle sets form a class; only classes are compared.
2. Signatures route classes that can link to each other. The universe of shingles is cut by hash into k parts, k fixed for sizes of
   one power of two. Two sets that differ in at most d shingles agree in all but d parts, so among the d + 1 fullest parts of each
   (in one order for all) there is a common one. Sets near the next power of two also sign with its k. A signature
   stands for several shingles at once, so common shingles or passages alone route nothing.
3. In each signature's group the classes are tied to its smallest one, the hub. Groups are combined within each batch before the shuffle, so a
   hot group arrives as a row a batch; no pairs are emitted.
4. Each class meets the group of one of its hubs. A group is joined in memory by T-occurrence search with DivideSkip: each set searches the
   inverted lists of those before it, the short ones merged, the long ones probed. Links are contracted to components.
5. Signatures whose classes are still of different components are the rest. What they connect is searched in the same way; a group of more than
   `BLOCK` classes by bands of sizes, and a larger band in blocks, every pair of which meets in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import mapped, shuffle_partitions, staged, unstage
from .components import components
from .hashing import U
from .repeats import numbered

SHINGLE, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Classes compared in one task; larger groups are dealt out as pairs of blocks.
BLOCK = 3000
#: Classes that meet their hub in one task.
STAR = 1000
#: Ids of classes with candidates are broadcast up to this many (16 bytes each); beyond that their texts are found by a shuffle join.
BROADCAST_IDS = 500_000
#: DivideSkip's cost ratio of merging to probing.
MU = 0.01


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """For each document the sorted hashes of its distinct k-word shingles; a shorter one has its whole sequence."""
    if lower:
        data = hashing.LOWER[data]
    start, end = hashing.words(data, bounds)
    h = hashing.word_hashes(data, start, end)
    runs = hashing.runs_of(h, k)
    first = np.searchsorted(start, bounds)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(hashing.runs_of(h[a:b], b - a) if b > a else h[:0])
    return out


def class_of(shingles: np.ndarray) -> int:
    """A hash of the whole set, as a signed number."""
    with np.errstate(over="ignore"):
        x = hashing.mix(hashing.mix(shingles + U(1)).sum(dtype=U, keepdims=True) + U(len(shingles)))
    return int(hashing.signed(x)[0])


def links(n: int, m: int, both: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> bool:
    return den * both >= num * (n + m - both)


class Signatures:
    """Signatures of one set for a Jaccard threshold num / den."""

    def __init__(self, num: int = NUMERATOR, den: int = DENOMINATOR) -> None:
        self.num, self.den = num, den

    def differ(self, n: int, m: int) -> int:
        """The most shingles by which linked sets of n and of at most m can differ."""
        return (self.den - self.num) * (n + m) // (self.den + self.num)

    def parts(self, power: int) -> int:
        most = (2 << power) - 1
        return (self.differ(most, most) + 1) * 5 // 4 + 2

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        largest = n * self.den // self.num
        if not n or not self.differ(n, largest):
            return shingles[:0]  # only equal sets link
        power, out = n.bit_length() - 1, []
        sums = np.zeros(n + 1, U)
        np.cumsum(hashing.mix(shingles ^ U(0x5851F42D4C957F2D)), dtype=U, out=sums[1:])
        for p in (power, power + 1):
            if largest >> p == 0:
                continue
            k, most = self.parts(p), min(largest, (2 << p) - 1)
            edges = np.concatenate([[0], np.searchsorted(shingles, np.arange(1, k, dtype=U) * U((1 << 64) // k)), [n]])
            size = np.diff(edges)
            with np.errstate(over="ignore"):
                sig = hashing.mix((sums[edges[1:]] - sums[edges[:-1]]) * U(hashing.BASE) + np.arange(k, dtype=U) + U(p << 32))
            take = min(k, self.differ(n, most) + 1)
            order = (np.minimum(size, 255).astype(U) << U(56)) | (sig >> U(8))
            out.append(sig[np.argpartition(order, k - take)[k - take :]] if take < k else sig)
        return np.concatenate(out)


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in hashing.documents(batch, 1):
                sets = shingle_sets(data, bounds, k)
                own = [batch.column(c).slice(i, j - i) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], names=["did", "doc_id", "n", "cls"])

    return run


def _star(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (sig, cls): where each group begins, its first class for each row, and which rows are further classes."""
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    first = np.flatnonzero(new)
    hub = cls[first][np.cumsum(new) - 1]
    other = np.ones(len(sig), bool)
    other[1:] = new[1:] | (cls[1:] != cls[:-1])
    return first, hub, other & (cls != hub)


def _signed(k: int, num: int, den: int):
    """Batches of documents -> sig, cls, hub: combined signatures (hub null), and ties within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signatures(num, den)
        for batch in batches:
            sigs, owners, seen = [], [], set()
            for _, _, data, bounds in hashing.documents(batch, 0):
                for s in shingle_sets(data, bounds, k):
                    own = class_of(s)
                    if own not in seen:
                        seen.add(own)
                        sigs.append(sign(s))
                        owners.append(own)
            if not sigs:
                continue
            sig = hashing.signed(np.concatenate(sigs))
            cls = np.repeat(np.array(owners, np.int64), [len(x) for x in sigs])
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            first, hub, other = _star(sig, cls) if len(sig) else (order, cls, order.astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[first], sig[other]])), pa.array(np.concatenate([cls[first], cls[other]])), pa.array(np.concatenate([cls[first], hub[other]]), mask=np.concatenate([np.ones(len(first), bool), np.zeros(int(other.sum()), bool)]))], names=["sig", "cls", "hub"])

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, tied first, cls) -> sig, cls, hub: the ties, with those between batches added."""
    last_sig, last_hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, cls, hub = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        plain = np.asarray(hub.is_null())
        told = hub.fill_null(0).to_numpy(zero_copy_only=False)
        s, c = sig[plain], cls[plain]
        out_s, out_c, out_h = [sig[~plain]], [cls[~plain]], [told[~plain]]
        if len(s):
            _, top, _ = _star(s, c)
            if last_sig is not None and s[0] == last_sig:
                top[: int(np.searchsorted(s, s[0], side="right"))] = last_hub
            other = c != top
            out_s.append(s[other])
            out_c.append(c[other])
            out_h.append(top[other])
            last_sig, last_hub = s[-1], top[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_s, out_c, out_h)], names=["sig", "cls", "hub"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in hashing.documents(batch, 1):
                sets = shingle_sets(data, bounds, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])

    return run


def divide_skip(sets: list[np.ndarray], known: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[int, int]]:
    """Links between sets that join different components; known has a component's number for each set.

    Sets are taken by size. Each searches the inverted lists of those before it: its longest lists are left out, the short ones merged,
    and what occurs often enough in these is probed for in the long ones by binary search.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    tokens, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in order])])
    owner = np.repeat(np.arange(len(order)), np.diff(bounds))
    by_token = np.argsort(inverse, kind="stable")
    lists, starts = owner[by_token], np.searchsorted(inverse[by_token], np.arange(len(tokens) + 1))
    sizes = np.diff(bounds)
    rank = np.empty(len(owner), np.int64)
    rank[by_token] = np.arange(len(owner)) - starts[inverse[by_token]]
    out = []
    for r in range(1, len(order)):
        n = int(sizes[r])
        least = -(-num * n // den)  # partners are no larger, and a link shares num / den of the larger
        lo = int(np.searchsorted(sizes, least))
        if lo >= r or not n:
            continue
        own = slice(bounds[r], bounds[r + 1])
        mine, length = inverse[own], rank[own]  # the lists' parts before r
        need = -(-num * (n + least) // (den + num))
        mine, length = mine[length > 0], length[length > 0]
        if len(mine) < need:
            continue
        longest = int(length.max())
        skip = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
        by_length = np.argsort(length, kind="stable")
        short, long = by_length[: len(mine) - skip], by_length[len(mine) - skip :]
        count = length[short]
        where = np.repeat(starts[mine[short]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        merged = np.sort(lists[where], kind="stable")  # sorted lists end to end: merged run by run
        new = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, times = merged[new], np.diff(np.append(new, len(merged)))
        keep = (times >= need - skip) & (found >= lo)
        found, times = found[keep], times[keep]
        ahead = 1
        while len(found):
            # of each other component the likeliest candidates first: one link settles the component
            own_id = find(int(known[order[r]]))
            group = np.array([find(int(known[order[c]])) for c in found.tolist()])
            left = np.flatnonzero(group != own_id)
            if not len(left):
                break
            by = left[np.lexsort((found[left], -times[left], group[left]))]
            head = np.concatenate([[True], group[by[1:]] != group[by[:-1]]])
            place = np.arange(len(by)) - np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
            now, later = by[place < ahead], by[place >= ahead]
            some, both = found[now], times[now]
            for t in long:
                part = lists[starts[mine[t]] : starts[mine[t]] + length[t]]
                at = np.searchsorted(part, some)
                both = both + (part[np.minimum(at, len(part) - 1)] == some)
            for c, b in zip(some.tolist(), both.tolist(), strict=True):
                if links(n, int(sizes[c]), int(b), num, den):
                    x, y = find(int(known[order[r]])), find(int(known[order[c]]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((order[r], order[c]))
            found, times, ahead = found[later], times[later], 8 * ahead
    return out


def _blocks(num: int, den: int):
    """Rows sorted by (grp, i, j): grp, i, j, cls, known, shingles -> links a, b between classes of different components."""

    def search(cls: list[int], known: list[int], raw: list[bytes]) -> list[tuple[int, int]]:
        if len(cls) < 2:
            return []
        ids = np.unique(np.array(known, np.int64), return_inverse=True)[1]
        return [(cls[x], cls[y]) for x, y in divide_skip([np.frombuffer(s, U) for s in raw], ids, num, den)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])
        pairs: list[tuple[int, int]] = []
        for batch in batches:
            for *key, cls, known, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != at:
                    pairs += search(*held)
                    at, held = key, ([], [], [])
                for x, v in zip(held, (cls, known, raw), strict=True):
                    x.append(v)
        pairs += search(*held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def join_components(docs: DataFrame, *, shingle: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: doc_id, n_shingles, cls, component_id.

    Texts have A-Z lower-cased and are split at ASCII white space. Two documents link when den * shared >= num * union of their distinct
    `shingle`-word shingles; a text of fewer words is one shingle, and one without words (or null) is linked with nothing. component_id is
    the smallest id reachable by links; null if no row that is reachable has one. Rows that share an id, or have none, stand for themselves; equal
    sets always link. Shingles and classes are 64-bit hashes. An empty table gives no rows, and other columns are ignored.
    """
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)
    rows = numbered(docs, id_col, text_col)
    classes = rows.select("did", "text", "doc_id").transform(mapped, _classes(shingle), "did long, doc_id long, n long, cls long")
    base = staged(classes, "classes")
    signed = rows.select("text").transform(mapped, _signed(shingle, num, den), "sig long, cls long, hub long")
    dealt = signed.repartition(n_parts, "sig").sortWithinPartitions("sig", "cls", "hub")
    ties = staged(dealt.transform(mapped, _ties, "sig long, cls long, hub long"), "ties")
    firsts = base.where("n > 0").groupBy("cls").agg(F.min("did").alias("first"), F.min("doc_id").alias("low"))

    found = _class_links(rows, ties, firsts, n_parts, shingle, num, den)
    roots = components(found)
    unstage(ties, found)
    top = firsts.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    smallest = top.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = top.join(smallest, "root").select("cls", "component_id")
    out = base.join(of_class, "cls", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", own.alias("component_id"))


def _searched(dealt: DataFrame, n_parts: int, num: int, den: int) -> DataFrame:
    """Links between classes of different components within each (grp, i, j)."""
    return dealt.repartition(n_parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").transform(mapped, _blocks(num, den), "a long, b long")


def _class_links(rows: DataFrame, ties: DataFrame, firsts: DataFrame, n_parts: int, shingle: int, num: int, den: int) -> DataFrame:
    """Links a, b between classes that connect whatever any links connect."""
    members = ties.select("cls").union(ties.select("hub")).distinct()
    wanted = staged(firsts.join(members, "cls", "left_semi").select("cls", F.col("first").alias("did")), "candidates")
    n = wanted.count()
    chosen = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    made = rows.join(chosen, "did").select("cls", "text").transform(mapped, _sets(shingle), "cls long, shingles binary")
    sets = staged(made, "sets")

    # Each class meets one hub's group: the hub and at most about STAR others are searched together.
    stars = staged(ties.groupBy("cls").agg(F.min("hub").alias("hub")), "stars")
    load = stars.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    salted = staged(stars.join(load, "hub").select("hub", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), "cls"), "salted")
    both = salted.unionByName(salted.select("hub", "salt", F.col("hub").alias("cls")).distinct())
    dealt = both.join(sets, "cls").select(F.col("hub").alias("grp"), F.col("salt").alias("i"), F.lit(0).alias("j"), "cls", F.col("cls").alias("known"), "shingles")
    verified = staged(_searched(dealt, n_parts, num, den), "links")
    known = components(verified)

    def root(df: DataFrame, col: str, to: str) -> DataFrame:
        return df.join(known.select(F.col("node").alias(col), F.col("root").alias(to)), col, "left").withColumn(to, F.coalesce(to, col))

    mixed = root(root(ties, "cls", "ra"), "hub", "rb").where("ra != rb").select("sig").distinct()
    rest = staged(ties.join(mixed, "sig", "left_semi").select("cls", "hub").distinct(), "rest")
    if rest.isEmpty():
        return verified
    groups = components(rest.select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    nodes = rest.select("cls").union(rest.select("hub")).distinct()
    nodes = staged(root(nodes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("all")), "cls", "known"), "nodes")
    # Sets that link are of like size: bands of sizes, of which each set is in two, tell a large group's members apart.
    sizes = sets.select("cls", (F.octet_length("shingles") / 8).alias("size"))
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int")
    large = nodes.groupBy("all").agg((F.count("*") > BLOCK).alias("large"))
    bands = F.explode(F.when(F.col("large"), F.array(band, band + 1)).otherwise(F.array(F.lit(0)))).alias("band")
    nodes = staged(nodes.join(large, "all").join(sizes, "cls").select(F.col("all"), bands, "cls", "known").select(F.xxhash64("all", "band").alias("grp"), "cls", "known"), "banded")
    load = nodes.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count_distinct("known").alias("parts")).where("parts > 1").drop("parts")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = nodes.join(load, "grp").select("grp", "cls", "known", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "known")
    more = _searched(dealt.join(sets, "cls").select("grp", "i", "j", "cls", "known", "shingles"), n_parts, num, den)
    return staged(verified.unionByName(more), "links")
