"""The trie of conversations: a node for each distinct beginning, with what lies below it rolled up to every node above.

Turns are numbered in their conversations, and a numpy scan gives each turn the polynomial fingerprint of all turns up to it. Equal fingerprints at one
depth are candidates. Each candidate is verified against its group's representative, the smallest conversation, turn by turn: its last turn and the
group of its parent must be the representative's. What differs is split off, for this depth and all below it, so fingerprints that collide cost time
and never a wrong node.

Conversations of any length are scanned in blocks of BLOCK turns. A node's sums come from the conversations that it has as members: each
conversation counts the nodes whose smallest member it is, so copies carry nothing.

Odd tables: null roles and texts count as empty, rows without a conv_id are left out, turns with the same number are ordered by role and text, nulls
first, and repeated rows are turns of their own. An empty table has no nodes. Other columns, of whatever name, are ignored. A long text is a row like
any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions, staged, unstage
from .hashing import BASE, U, between, documents, mix, powers, prefix, signed, words

#: Powers of 2: turns of a conversation that are scanned in one go, and neighbouring ids that are joined before they are hashed.
SCAN, DIGEST = 12, 12
BLOCK = 1 << SCAN
TURN = ["conv_id", "place", "role", "text", "print", "words"]


class Trie(NamedTuple):
    """nodes(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), and members(conv_id, depth, node_conv_id): the node of every conversation at every depth from 1."""

    nodes: DataFrame
    members: DataFrame


def numbered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with place, counted from 0 in the order of turn (nulls first, then role and text), a fingerprint of the turn and its words."""
    spark = turns.sparkSession
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *said)
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    kept = staged(mapped(ordered, _number, "part int, " + ", ".join(f"{c} {'string' if c in ('role', 'text') else 'long'}" for c in TURN)), "turns")
    parts = kept.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("n"))
    cut = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 1)
    before = []
    for r in cut.collect():  # conversations that go on in a later partition: fewer than there are partitions
        n = 0
        for p in r.parts:
            before.append((r.conv_id, p.part, n))
            n += p.n
    out = kept
    if before:
        shift = spark.createDataFrame(before, "conv_id long, part int, before long")
        out = kept.join(F.broadcast(shift), ["conv_id", "part"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    out = out.select(TURN)
    out.staged_path = kept.staged_path
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        start = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
        place = np.arange(n) - np.repeat(start, np.diff([*start, n]))
        if conv[0] == last:
            place[: start[1] if len(start) > 1 else n] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        hashes, count = [np.zeros(n, U), np.zeros(n, U)], np.zeros(n, np.int64)
        for column in (1, 2):
            for i, j, data, bounds in documents(batch, column):
                hashes[column - 1][i:j] = between(prefix(data), bounds[:-1], bounds[1:])
                if column == 2:
                    count[i:j] = np.diff(np.searchsorted(words(data, bounds)[0], bounds))
        with np.errstate(over="ignore"):
            own = mix(mix(hashes[0]) * U(BASE) + hashes[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column(0), pa.array(place), batch.column(1), batch.column(2), pa.array(signed(own)), pa.array(count)], names=["part", *TURN])


def grafted(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Numbered turns in which the first h = crc32(conv_id) % heads of each conversation give way to the first h of its family's head, the conversation conv_id - conv_id % family."""
    head, h = F.col("conv_id") - F.pmod("conv_id", F.lit(family)), F.crc32(F.col("conv_id").cast("string")) % heads
    own = turns.where((head == F.col("conv_id")) | (F.col("place") >= h))
    takers = turns.select("conv_id").distinct().select("conv_id", head.alias("head"), h.alias("h")).where("h > 0 AND head <> conv_id")
    lent = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < heads - 1)).withColumnRenamed("conv_id", "head")
    return own.unionByName(takers.join(lent, "head").where("place < h").select(TURN))


def trie(turns: DataFrame, convs: DataFrame, bits: int = 64) -> Trie:
    """The trie of numbered turns. convs(conv_id) has every conversation once, those without a turn, too; places may have gaps among a conversation's first three.

    `bits` of each fingerprint are used; fewer only make more groups collide, which are then split.
    """
    rows = staged(_scanned(turns, bits), "prefixes")
    nodes = staged(rows.groupBy("depth", "print", "parent", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words")), "nodes")
    clash = nodes.groupBy("depth", "print").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if clash.isEmpty():
        at = rows.select("conv_id", "depth", "print", "parent").withColumns({"path": F.lit(""), "parent_path": F.lit("")})
        nodes = nodes.drop("role", "text").withColumns({"path": F.lit(""), "parent_path": F.lit("")})
        return _rolled_up(at, nodes, convs)
    at = staged(_split(rows, nodes, clash), "split")
    unstage(rows, nodes)
    nodes = staged(at.groupBy("depth", "print", "path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("parent", "parent_path", "words")]), "nodes")
    return _rolled_up(at, nodes, convs)


def _scanned(turns: DataFrame, bits: int) -> DataFrame:
    """conv_id, depth, print (of all turns up to this one), parent (that of the turn before), role, text, words."""
    n = shuffle_partitions(turns.sparkSession)
    first = turns.where(F.col("place") < BLOCK).withColumns({"block": F.lit(0).cast("long"), "above": F.lit(0).cast("long")})
    if turns.where(F.col("place") >= BLOCK).isEmpty():
        return _blocks(first, n, bits)
    long = turns.where(F.col("place") >= BLOCK).withColumn("block", F.shiftright("place", SCAN))
    ids = long.select("conv_id").distinct()
    own = turns.where(F.col("place") < BLOCK).join(ids, "conv_id", "left_semi").groupBy("conv_id").agg((F.lit(BLOCK) - F.count("*")).alias("gap"))
    long = long.join(own, "conv_id").withColumn("above", F.col("block") * BLOCK - F.col("gap")).drop("gap")
    cut = staged(_blocks(long.unionByName(first), n, 64, whole=False), "blocks")
    sums = cut.where("last").join(ids, "conv_id", "left_semi").select("conv_id", "block", "print").repartition(n, "conv_id").sortWithinPartitions("conv_id", "block")
    carry = mapped(sums, _carried, "conv_id long, block long, carry long")
    parts = cut.join(carry, ["conv_id", "block"], "left").withColumn("carry", F.coalesce("carry", F.lit(0)))
    mask = (1 << bits) - 1 - (1 << 64 if bits == 64 else 0)
    add = lambda c: _wrapped_sum(F.col(c), F.col("carry")).bitwiseAND(F.lit(mask).cast("long"))
    return parts.select("conv_id", "depth", add("print").alias("print"), add("parent").alias("parent"), "role", "text", "words")


def _wrapped_sum(a: Column, b: Column) -> Column:
    """a + b modulo 2 ** 64, which + takes for an error."""
    half = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def _blocks(rows: DataFrame, n: int, bits: int, whole: bool = True) -> DataFrame:
    """Fingerprints that count within a block, where that is all of a conversation (whole) or a part of it."""
    ordered = rows.select("conv_id", "block", "above", "place", "role", "text", "print", "words").repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, key, seen, total = U((1 << bits) - 1), None, 0, U(0)
        held: pa.RecordBatch | None = None
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            conv, block, above = (batch.column(i).to_numpy() for i in range(3))
            start = np.concatenate([[0], np.flatnonzero((np.diff(conv) != 0) | (np.diff(block) != 0)) + 1])
            size = np.diff([*start, m])
            rank = np.arange(m) - np.repeat(start, size)
            same = key == (conv[0], block[0])
            if same:
                rank[: size[0]] += seen
            with np.errstate(over="ignore"):
                scale = np.array([pow(BASE, int(a), 1 << 64) for a in above[start]], U) if not whole else np.ones(len(start), U)
                term = batch.column(6).to_numpy().view(U) * powers(BASE, int(rank.max()) + 1)[rank] * np.repeat(scale, size)
                sums = np.cumsum(term, dtype=U)
                shift = np.where(start > 0, sums[start - 1], U(0))
                if same:
                    shift[0] = U(0) - total
                sums -= np.repeat(shift, size)
                parent = (sums - term) & mask
            key, seen, total = (conv[-1], block[-1]), int(rank[-1]) + 1, sums[-1]
            last = np.zeros(m, bool)
            last[start[1:] - 1] = True
            arrays = [batch.column(0), batch.column(1), pa.array(above + rank + 1), pa.array(signed(sums & mask)), pa.array(signed(parent)), batch.column(4), batch.column(5), batch.column(7), pa.array(last)]
            names = ["conv_id", "block", "depth", "print", "parent", "role", "text", "words", "last"]
            if held is not None:
                yield _ended(held, not same)
            held = pa.RecordBatch.from_arrays(arrays, names=names)
        if held is not None:
            yield _ended(held, True)

    out = mapped(ordered, run, "conv_id long, block long, depth long, print long, parent long, role string, text string, words long, last boolean")
    return out.drop("block", "last") if whole else out


def _ended(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
    """The batch, its final row marked as the last of its block or not."""
    flags = batch.column("last").to_numpy(zero_copy_only=False).copy()
    flags[-1] = last
    return batch.set_column(batch.schema.get_field_index("last"), "last", pa.array(flags))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the blocks of a conversation before each one sum up to."""
    key, total = None, 0
    for batch in batches:
        out = []
        for conv, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            key, total = conv, total if conv == key else 0
            out.append(total)
            total = (total + own) % (1 << 64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed(np.array(out, U)))], names=["conv_id", "block", "carry"])


def _split(rows: DataFrame, nodes: DataFrame, clash: DataFrame) -> DataFrame:
    """rows with path and parent_path: where, from the first turn on, they differ from the representatives of their groups, and in what way."""
    w = Window.partitionBy("depth", "print").orderBy("conv_id")
    what = ["depth", "print", "parent", "role", "text"]
    ranked = nodes.join(clash, ["depth", "print"], "left_semi").withColumn("split", F.row_number().over(w) - 1).where("split > 0").select(*what, "split")
    turned = rows.join(ranked, what).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "split"))).alias("aside"))
    marked = rows.drop("role", "text").join(turned, "conv_id", "left")

    def upto(depth: Column) -> Column:
        some = F.filter("aside", lambda x: x["depth"] <= depth)
        return F.coalesce(F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["depth"].cast("string"), x["split"].cast("string"))), ","), F.lit(""))

    return marked.withColumns({"path": upto(F.col("depth")), "parent_path": upto(F.col("depth") - 1)}).drop("aside")


def _rolled_up(at: DataFrame, nodes: DataFrame, convs: DataFrame) -> Trie:
    key, above = ["depth", "print", "path"], [(F.col("depth") - 1).alias("depth"), F.col("parent").alias("print"), F.col("parent_path").alias("path")]
    top = convs.agg(F.min("conv_id").alias("low"), F.count("*").alias("n")).head()
    children = nodes.where("depth > 1").select(*above).groupBy(*key).agg(F.count("*").alias("n_children"))
    own = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = staged(own, "own")
    # what a conversation brings to every node that it passes: the nodes whose smallest member it is
    brought = own.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    sums = at.select("conv_id", *key).join(brought, "conv_id").groupBy(*key).agg(F.sum("saved").alias("all_saved"), F.sum("leaves").alias("n_leaves"))
    # less what a node's smallest member brought further up
    block = F.shiftright("depth", SCAN)
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    chain = own.withColumn("block", block)
    chain = chain.withColumn("higher", F.coalesce(F.sum("saved").over(w), F.lit(0)))
    if own.where(F.col("depth") >= BLOCK).isEmpty():
        chain = chain.drop("block")
    else:
        b = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK turns
        before = own.withColumn("block", block).groupBy("conv_id", "block").agg(F.sum("saved").alias("s")).select("conv_id", "block", F.coalesce(F.sum("s").over(b), F.lit(0)).alias("before"))
        chain = chain.join(before, ["conv_id", "block"]).withColumn("higher", F.col("higher") + F.col("before")).drop("block", "before")
    parents = nodes.select("depth", "print", "path", F.col("conv_id").alias("parent_conv_id"))
    linked = chain.withColumn("up", F.col("depth") - 1).join(parents.withColumnsRenamed({"depth": "up", "print": "parent", "path": "parent_path"}), ["up", "parent", "parent_path"], "left")
    ends = at.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("k")).select("conv_id", "k.*")
    bare = convs.join(ends, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit("").alias("path"))
    digests = _digests(ends.unionByName(bare), key)
    empty = hashlib.sha256(b"").hexdigest()
    found = linked.join(sums, key).select(
        *key, "conv_id", F.when(F.col("depth") == 1, top.low).otherwise(F.col("parent_conv_id")).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("all_saved") - F.col("higher")).alias("saved_tokens"),
    )
    if top.n:
        counts = [F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens")]
        is_root = [F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit("").alias("path"), F.lit(top.low).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top.n).cast("long").alias("n_convs")]
        found = found.unionByName(own.agg(*counts).select(*is_root, "n_children", "n_leaves", "saved_tokens"))
    out = found.join(digests, key, "left").drop("print", "path").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    members = at.select("conv_id", *key).join(nodes.select(*key, F.col("conv_id").alias("node_conv_id")), key).select("conv_id", "depth", "node_conv_id")
    return Trie(out, members)


def _digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """ends_sha256 of each key's conversation ids, in order and comma-joined. Ids come in blocks of neighbours, and one stream is hashed at a time."""
    spark = ends.sparkSession
    ids = ends.withColumn("block", F.shiftright("conv_id", DIGEST)).groupBy(*key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = ids.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key, "block").select(*key, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *at, said in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at == now:
                    hasher.update(b",")
                else:
                    if now:
                        done.append((*now, hasher.hexdigest()))
                    now, hasher = at, hashlib.sha256()
                hasher.update(said.encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, hasher.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        depth, print_, path, digest = zip(*done, strict=True) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(print_, pa.int64()), pa.array(path, pa.string()), pa.array(digest, pa.string())], names=[*key, "ends_sha256"])

    return mapped(ordered, run, "depth long, print long, path string, ends_sha256 string")
