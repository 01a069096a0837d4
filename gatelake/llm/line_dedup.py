"""Line deduplication: exact by hash, near by a segment-partition edit join.

A line is cut into threshold + 1 segments. A line that differs from it in at most `threshold` edits has one of the segments unchanged, at a place
that length and segment number bound. Each distinct line is indexed by its segments and probes the indexes of its own and slightly
smaller lengths with the substrings at those places; a key that serves for both is one row. Rows carry counts (modulo 16) of characters in
16 classes, which tell nearly all unequal lines apart.

Two steps follow, and neither makes a row for a pair. The first tells which lines share a key with one they may be near to. The
second deals these lines alone, with their texts, by key; a banded bit-parallel edit distance decides within each group, a row comes out for each
line that has an earlier near-copy. Groups beyond `BLOCK` lines or `BLOCK_CHARS` characters are split: lines are held against the group's `TRIES`
earliest ones first, block by block, and only those still open against all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import mapped, shuffle_partitions, staged
from .hashing import U
from .repeats import numbered

THRESHOLD, LEAST_CHARS = 2, 16
TRIES = 8
#: Documents whose lines are compared are broadcast up to so many ids; beyond that they are joined by shuffle.
BROADCAST_IDS = 200_000
CLASSES = 16
#: Pairs verified at a time.
PAIRS = 20_000
#: Lines of a key whose characters are counted against each other before texts are fetched; of larger groups all are fetched.
WIDE = 1024
#: Lines, and characters, of a group that one task compares; larger groups are split.
BLOCK, BLOCK_CHARS = 2000, 8 << 20
#: Key rows of a partition (24 bytes each).
PARTITION_ROWS = 2_000_000


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """Start and size of the threshold + 1 segments of a line of that length; the longer ones come last."""
    n = threshold + 1
    size, more = divmod(length, n)
    sizes = [size] * (n - more) + [size + 1] * more
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def probes(length: int, of: int, threshold: int) -> list[tuple[int, int, int]]:
    """Segment, start and size of the substrings that a line probes for among lines of length `of`, which is no greater than its own."""
    more, out = length - of, []
    for i, (at, size) in enumerate(segments(of, threshold)):
        left, right = i, threshold - i
        for start in range(max(0, at - left, at + more - right), min(length - size, at + left, at + more + right) + 1):
            out.append((i, start, size))
    return out


def within(a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether pairs of rows are at most `threshold` edits apart, by a bit-parallel band; rows are padded, each line longer than threshold.

    Bit 63 stands for the lowest diagonal of the band. The distance is followed down this diagonal, where it never falls, to the last row, then
    along that row, where it falls by 2 * threshold at most. Pairs that can't come back within the threshold, or are done, are left out as it goes.
    """
    k, n = threshold, len(a)
    one = U(1)
    near = np.zeros(n, bool)
    row = np.flatnonzero(np.abs(len_a - len_b) <= k)
    a, len_a, b, len_b = a[row], len_a[row], b[row], len_b[row]
    vp, vn = np.full(len(row), ~U(0) << U(63 - k), U), np.zeros(len(row), U)
    score = np.full(len(row), k, np.int64)
    down = len_a - k
    wide = a.shape[1]
    for i in range(int(len_b.max(initial=0))):
        if i % 16 == 0:
            done = i >= len_b
            near[row[done]] = score[done] <= k
            stay = ~done & (score <= 3 * k)
            if not stay.all():
                row, a, len_a, b, len_b, vp, vn, score, down = (x[stay] for x in (row, a, len_a, b, len_b, vp, vn, score, down))
            if not len(row):
                return near
        active = i < len_b
        same = np.zeros(len(row), U)
        for d in range(-k, k + 1):
            if 0 <= i + d < wide:
                same |= ((a[:, i + d] == b[:, i]) & (i + d < len_a)).astype(U) << U(63 - k + d)
        d0 = (((same & vp) + vp) ^ vp) | same | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        diagonal = i < down
        row_bit = np.clip(62 - (i - down), 0, 63).astype(U)
        along = ((hp >> row_bit) & one).astype(np.int64) - ((hn >> row_bit) & one).astype(np.int64)
        score += np.where(active, np.where(diagonal, 1 - (d0 >> U(63)).astype(np.int64), along), 0)
        vp, vn = np.where(active, hn | ~((d0 >> one) | hp), vp), np.where(active, (d0 >> one) & hp, vn)
    near[row] = score <= k
    return near


def near_pairs(texts: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Whether texts x and y (code points, longer than threshold) are near, pair by pair. What both begin and end with is left out of the band."""
    parts = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = texts[i], texts[j]
        n = min(len(a), len(b))
        spare = n - threshold - 1
        differ = a[:n] != b[:n]
        head = min(int(differ.argmax()) if differ.any() else n, spare)
        differ = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
        tail = min(int(differ.argmax()) if differ.any() else n, spare - head)
        parts.append((a[head : len(a) - tail], b[head : len(b) - tail]))
    sizes = np.array([max(len(a), len(b)) for a, b in parts], np.int64)
    near = np.zeros(len(parts), bool)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):  # like lengths together, about PAIRS at a time
        fit = max(1, min(PAIRS, int(np.searchsorted(sizes[order[at:]] * np.arange(1, len(order) - at + 1), 4_000_000))))
        some, at = order[at : at + fit], at + fit
        wide = int(sizes[some[-1]])
        sides = []
        for side in (0, 1):
            padded = np.zeros((len(some), wide), np.uint32)
            for r, i in enumerate(some):
                padded[r, : len(parts[i][side])] = parts[i][side]
            sides += [padded, np.array([len(parts[i][side]) for i in some], np.int64)]
        near[some] = within(*sides, threshold)
    return near


def _lines(ids: list[int], texts: list[str]) -> tuple[list[int], list[int], list[str]]:
    """Document, number and text of each line that isn't blank."""
    did, no, out = [], [], []
    for i, text in zip(ids, texts, strict=True):
        for j, line in enumerate(text.split("\n")):
            if line and not line.isspace():
                did.append(i)
                no.append(j)
                out.append(line)
    return did, no, out


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _earliest(did: list[int], no: list[int], lines: list[str]) -> dict[str, int]:
    """The place of each distinct line that comes first by document and number."""
    seen: dict[str, int] = {}
    for i, x in enumerate(lines):
        if (j := seen.setdefault(x, i)) != i and (did[i], no[i]) < (did[j], no[j]):
            seen[x] = i
    return seen


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> line, did, no, and whether the line comes earlier in the same batch: a hot line is open once a batch."""
    for batch in batches:
        did, no, lines = _lines(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        seen = _earliest(did, no, lines)
        ids = {x: line_hash(x) for x in seen}
        first = set(seen.values())
        yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in lines], pa.int64()), pa.array(did, pa.int64()), pa.array(no, pa.int32()), pa.array([i not in first for i in range(len(lines))], pa.bool_())], names=["line", "did", "no", "again"])


def _segment(length: np.ndarray, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of the given lengths, as in `segments`."""
    n = threshold + 1
    size, more = length // n, length % n
    return i * size + np.maximum(i - (n - more), 0), size + (i >= n - more)


def _keys(lines: list[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line and key of each index and probe row, and the lines' character classes. A key's two lowest bits say whether it indexes (1) and probes (2)."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(x) for x in lines], np.int64)
    first = np.cumsum(length) - length
    values = hashing.mix(points.astype(U) + U(1))
    sums = np.zeros(len(points) + 1, U)
    np.cumsum(values * hashing.powers(hashing.BASE, len(points)), dtype=U, out=sums[1:])
    rows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(some: np.ndarray, start: np.ndarray, size: np.ndarray, i: int, of: np.ndarray, role: int) -> None:
        with np.errstate(over="ignore"):
            place = ((of[some] << 8) + i).astype(U) * U(hashing.BASE)
            key = hashing.mix(hashing.between(sums, (first + start)[some], (first + start + size)[some]) + place)
        rows.append((some, (key & ~U(3)) | U(role)))

    every = np.arange(len(lines))
    for i in range(threshold + 1):
        for more in range(threshold + 1):
            of = length - more
            at, size = _segment(of, i, threshold)
            for shift in range(max(-i, more - (threshold - i)), min(i, more + threshold - i) + 1):
                fits = (of > threshold) & (at + shift >= 0) & (at + shift <= length - size)
                add(np.flatnonzero(fits), at + shift, size, i, of, 2 + (shift == more == 0))
    line, key = (np.concatenate(x) for x in zip(*rows, strict=True))
    cell = np.repeat(every * CLASSES, length) + (values >> U(60)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(lines) * CLASSES).reshape(-1, CLASSES)
    classes = ((counts & 15).astype(U) << U(4) * np.arange(CLASSES, dtype=U)).sum(axis=1, dtype=U)
    return line, hashing.signed(key), hashing.signed(classes)


def _portions(lines: list[str]) -> Iterator[slice]:
    """About half a group of text at a time; a longer line is taken alone."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= hashing.GROUP // 2):
            size += len(lines[end])
            end += 1
        yield slice(at, end)
        at = end


def _indexed(threshold: int, least: int):
    """Documents -> key, line, classes of each batch's distinct lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x for x in dict.fromkeys(_lines(batch.column(0).to_pylist(), batch.column(1).to_pylist())[2]) if len(x) >= least]
            for some in _portions(own):
                line, key, classes = _keys(own[some], threshold)
                ids = np.array([line_hash(x) for x in own[some]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[line]), pa.array(classes[line])], names=["key", "line", "classes"])

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of how far the character counts of lines are apart."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.int64)
    for shift in range(0, 4 * CLASSES, 4):
        d = ((x >> shift) & 15) - ((y >> shift) & 15) & 15
        out += np.minimum(d, 16 - d)
    return out


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether one of two keys indexes and the other probes."""
    return ((x & 1) & (y >> 1) | (x >> 1) & (y & 1)).astype(bool)


def _live(threshold: int):
    """Rows sorted by key: key, line, classes -> lines that share a key with one they may be near to, once a batch."""

    def told(rows: np.ndarray) -> pa.RecordBatch:
        out = [np.zeros(0, np.int64)]
        if rows.shape[1]:
            key, line, classes = rows
            group, role = key >> 2, key & 3
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(new, len(key)))
            differs = np.add.reduceat((line != np.repeat(line[new], size)).astype(np.int64), new) > 0
            open_groups = differs & (np.bitwise_or.reduceat(role, new) == 3)
            x = new[open_groups & (size == 2)]
            x = x[_meet(role[x], role[x + 1]) & (_apart(classes[x], classes[x + 1]) <= 2 * threshold)]
            out += [line[x], line[x + 1]]
            for s, n in zip(new[open_groups & (size > 2)].tolist(), size[open_groups & (size > 2)].tolist(), strict=True):
                if n > WIDE:
                    out.append(line[s : s + n])
                    continue
                for at in range(s, s + n, 256):
                    mine, others = slice(at, min(at + 256, s + n)), slice(s, s + n)
                    near = (line[mine, None] != line[None, others]) & _meet(role[mine, None], role[None, others])
                    near &= _apart(classes[mine, None], classes[None, others]) <= 2 * threshold
                    out.append(line[mine][near.any(axis=1)])
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.hstack([held, np.vstack([batch.column(i).to_numpy() for i in range(3)])])
            if not rows.shape[1]:
                continue
            cut = int(np.searchsorted(rows[0] >> 2, rows[0, -1] >> 2))
            held, rows = rows[:, cut:], rows[:, :cut]
            if rows.shape[1]:
                yield told(rows)
        yield told(held)

    return run


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, text, wanted lines -> line, did, no, text."""
    for batch in batches:
        out: list[tuple[int, int, int, str]] = []
        for did, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            lines = text.split("\n")
            out += [(w["line"], did, w["no"], lines[w["no"]]) for w in wanted]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["line", "did", "no", "text"])


def _keyed(threshold: int):
    """line, did, no, text -> the same for every key of the line, with its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for some in _portions(texts):
                line, key, classes = _keys(texts[some], threshold)
                own = pa.Table.from_batches([batch.slice(some.start, some.stop - some.start)])
                step = max(1, len(key) * (1 << 24) // max(1, sum(len(texts[some][i]) for i in line.tolist())))
                for at in range(0, len(key), step):
                    part = slice(at, at + step)
                    rows = own.take(pa.array(line[part])).combine_chunks()
                    columns = [pa.array(key[part]), pa.array(classes[line[part]]), *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)]
                    yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["key", "classes", "line", "did", "no", "text"])

    return run


#: What a row does in its unit of comparison: it is asked about, or it is what others are held against.
ASKED, AGAINST = 1, 2


def _judged(threshold: int):
    """Rows sorted by unit: unit, flag, key, classes, line, did, no, text -> lines asked about that have an earlier near-copy in their unit."""

    def pairs_of(key: np.ndarray, classes: np.ndarray, line: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a unit in the order of places -> asked rows and earlier ones that may be near."""
        asked, against = np.flatnonzero(flag & ASKED), np.flatnonzero(flag & AGAINST)
        x, y = [], []
        for at in range(0, len(asked), 256):
            mine = asked[at : at + 256]
            ok = (against[None, :] < mine[:, None]) & (line[mine, None] != line[None, against]) & _meet(key[mine, None] & 3, key[None, against] & 3)
            ok &= _apart(classes[mine, None], classes[None, against]) <= 2 * threshold
            i, j = np.nonzero(ok)
            x.append(mine[i])
            y.append(against[j])
        return (np.concatenate(x), np.concatenate(y)) if x else (asked, asked)

    def judge(tables: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(tables)
        unit, flag, key, classes, line, did, no = (rows.column(i).to_numpy() for i in range(7))
        order = np.lexsort((no, did, unit))
        text = rows.column(7).to_pylist()
        new = np.flatnonzero(np.concatenate([[True], unit[order][1:] != unit[order][:-1]]))
        x, y = [], []
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
            if e - s > 1:
                own = order[s:e]
                i, j = pairs_of(key[own], classes[own], line[own], flag[own])
                x.append(own[i])
                y.append(own[j])
        near = set()
        if x:
            a, b = np.concatenate(x), np.concatenate(y)
            used = np.unique(np.concatenate([a, b])).tolist()
            points: list = [None] * len(text)
            for i in used:
                points[i] = np.frombuffer(text[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
            rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            lo, step = 0, TRIES
            while len(a):  # the next candidates of every line still open, of all units at once
                now = rank < lo + step
                found = near_pairs(points, a[now], b[now], threshold)
                near.update(line[a[now][found]].tolist())
                stay = ~now & ~np.isin(line[a], np.fromiter(near, np.int64, len(near)))
                a, b, rank, lo, step = a[stay], b[stay], rank[stay], lo + step, 2 * step
        return pa.RecordBatch.from_arrays([pa.array(sorted(near), pa.int64())], names=["line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n, size = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                unit = part.column(0).to_numpy()
                # what is held goes as soon as it is enough and a unit ends
                if n and (n >= BLOCK or size >= BLOCK_CHARS):
                    whole = pa.concat_tables(tables)
                    last = whole.column(0)[-1].as_py()
                    end = int(np.searchsorted(unit != last, True)) if (unit != last).any() else len(unit)
                    if end < len(unit):
                        yield judge([*tables, pa.Table.from_batches([part.slice(0, end)])])
                        tables, n, size, part = [], 0, 0, part.slice(end)
                tables.append(pa.Table.from_batches([part]))
                n, size = n + part.num_rows, size + part.column(7).nbytes
        if n:
            yield judge(tables)

    return run


def near_earlier(rows: DataFrame, first: DataFrame, *, threshold: int, least: int) -> DataFrame:
    """line: distinct lines that have an earlier near-copy among the distinct lines. first(line, did, no) has each line's first place."""
    spark = rows.sparkSession
    n_parts = shuffle_partitions(spark)
    per_line = (threshold + 1) * (threshold + 2)
    index_parts = max(n_parts, first.count() * per_line // PARTITION_ROWS)
    indexed = rows.select("did", "text").transform(mapped, _indexed(threshold, least), "key long, line long, classes long")
    dealt = indexed.repartition(index_parts, F.shiftright("key", 2)).sortWithinPartitions("key")
    live = staged(dealt.transform(mapped, _live(threshold), "line long").distinct(), "live_lines")

    wanted = staged(first.join(live, "line").groupBy("did").agg(F.collect_list(F.struct("no", "line")).alias("wanted")), "wanted_lines")
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    # Line numbers are of whole texts; a line's text is fetched from its first place alone.
    texts = rows.join(chosen, "did").select("did", "text", "wanted").transform(mapped, _picked, "line long, did long, no int, text string")
    fields = "key long, classes long, line long, did long, no int, text string"
    keyed = staged(texts.transform(mapped, _keyed(threshold), fields).withColumn("grp", F.shiftright("key", 2)), "keyed_lines")

    def judged(units: DataFrame) -> DataFrame:
        units = units.select("unit", "flag", "key", "classes", "line", "did", "no", "text")
        return units.repartition(n_parts, "unit").sortWithinPartitions("unit").transform(mapped, _judged(threshold), "line long").distinct()

    def flag(x: int) -> Column:
        return F.lit(x).cast("long").alias("flag")

    load = keyed.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.bit_or(F.col("key").bitwiseAND(3)).alias("roles")).where("n > 1 and roles = 3")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    load = staged(load.select("grp", blocks.alias("blocks")), "groups")
    near = staged(judged(keyed.join(load.where("blocks = 1").select("grp"), "grp", "left_semi").withColumn("unit", F.col("grp")).withColumn("flag", flag(ASKED | AGAINST))), "near_lines")
    hot = load.where("blocks > 1")
    if hot.isEmpty():
        return near
    # Large groups: their earliest lines go to all blocks first, then all blocks to the lines still open.
    hot = staged(keyed.join(hot, "grp").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")), "hot_lines")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("did", "no"))
    hubs = hot.withColumn("rank", rank).where(F.col("rank") <= TRIES).select("*", every)
    tried = judged(hot.withColumn("unit", F.xxhash64("grp", "block")).withColumn("flag", flag(ASKED)).drop("grp", "blocks", "block").unionByName(hubs.withColumn("unit", F.xxhash64("grp", "other")).withColumn("flag", flag(AGAINST)).drop("grp", "blocks", "block", "rank", "other")))
    near = staged(near.unionByName(tried).distinct(), "near_lines")
    left = staged(hot.join(near, "line", "left_anti").select("*", every), "open_lines")
    busy = left.select("grp", F.col("block").alias("to")).distinct()
    asked = left.withColumn("unit", F.xxhash64("grp", "block", "other")).withColumn("flag", flag(ASKED)).drop("grp", "blocks", "block", "other")
    against = hot.join(busy, "grp").withColumn("unit", F.xxhash64("grp", "to", "block")).withColumn("flag", flag(AGAINST)).drop("grp", "blocks", "block", "to")
    return near.unionByName(judged(asked.unionByName(against))).distinct()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, removed numbers -> doc_id, kept, n_lines, n_removed, kept_sha256."""
    for batch in batches:
        out = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            drop = set(gone or ())
            kept = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            out.append((kept, len(lines), len(drop), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string())], names=["doc_id", "kept", "n_lines", "n_removed", "kept_sha256"])


def dedup_lines(docs: DataFrame, *, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: doc_id, kept (the text of the kept lines), n_lines, n_removed, kept_sha256.

    Lines end at line feeds. A line goes if an equal one, or one at most `threshold` edits (of characters) away, comes earlier: in a document of smaller
    id, or further up. Lines are judged on the input. Blank lines stay; lines under `least_chars` characters (more than threshold)
    go for equal ones only. Null and empty texts have no lines. Rows that share an id are documents of their own, ordered
    by a hash of their text. Lines are compared for equality by 64-bit hashes. An empty table gives no rows; other columns are ignored.
    """
    rows = numbered(docs, id_col, text_col)
    places = staged(rows.select("did", "text").transform(mapped, _occurrences, "line long, did long, no int, again boolean"), "lines")
    once = places.where("not again").drop("again")
    first = staged(once.groupBy("line").agg(F.min(F.struct("did", "no")).alias("at")).select("line", "at.did", "at.no"), "first_lines")
    near = near_earlier(rows, first, threshold=threshold, least=max(least_chars, threshold + 1))
    firsts = first.join(near.withColumn("near", F.lit(True)), "line", "left").select("line", F.col("did").alias("first_did"), F.col("no").alias("first_no"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = once.join(firsts, "line").where("near or did != first_did or no != first_no").select("did", "no")
    gone = gone.unionByName(places.where("again").select("did", "no"))
    by_doc = gone.groupBy("did").agg(F.collect_list("no").alias("gone"))
    out = rows.join(by_doc, "did", "left").select("doc_id", "text", "gone")
    return out.transform(mapped, _finish, "doc_id long, kept string, n_lines long, n_removed long, kept_sha256 string")
