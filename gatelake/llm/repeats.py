"""What exact substring removal by bytes and by words share: anchors, routing, and the rest of hot groups.

A window is `length` consecutive units (bytes or words) of one document. Each window's anchor is its least k-gram by hash, the last of equals, so equal
windows have equal anchors at equal places. Consecutive windows with one anchor are a run. Runs are routed by their anchor's hash:

- runs with equal text are told by a hash of their whole extent; all their windows repeat, and no text is compared;
- runs whose anchor occurs in no other text have no repeated window;
- for the rest, the mixed runs, one run of each distinct text is sent with its units to its anchor's group.

Equal runs are combined within each batch first, so a hot run arrives as a row a batch. A group of more than `most` distinct texts
isn't gathered: its windows are told apart by hash, dealt by that hash and combined within each batch again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import mapped, shuffle_partitions, staged
from .hashing import U

PLACE = 24
RUNS = "h long, c long, did long, packed long"


#: Places of an anchor in a window, at most: 14 bits of a packed run, and 15 for its windows.
WIDEST = (1 << 14) - 1


@dataclass(frozen=True)
class Kind:
    """Units and window. everywhere: a window counts if it starts anywhere else; else only if it starts earlier."""

    unit: str
    length: int
    gram: int
    everywhere: bool

    def __post_init__(self) -> None:
        if not self.gram <= self.length < self.gram + WIDEST:
            raise ValueError(f"windows have {self.gram} to {self.gram + WIDEST - 1} units")

    @property
    def width(self) -> int:
        return self.length - self.gram + 1

    def values(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units' values, and their bounds by document."""
        if self.unit == "byte":
            return hashing.BYTE[data], bounds
        start, end = hashing.words(data, bounds)
        return hashing.word_hashes(data, start, end), np.searchsorted(start, bounds)


def pack(start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, many: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """kind 0: a run to compare; 1: a run whose windows all count; 2: a run to be compared with its units."""
    return (start.astype(np.int64) << 32) | (windows.astype(np.int64) << 17) | (anchor.astype(np.int64) << 3) | (many.astype(np.int64) << 2) | kind


def unpack(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, windows, anchor's offset, whether the text occurs more than once, kind."""
    return x >> 32, (x >> 17) & 0x7FFF, (x >> 3) & 0x3FFF, (x >> 2) & 1, x & 3


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(values: np.ndarray, bounds: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """document, start, windows, anchor's offset, anchor's hash, text's hash of each run; start counts from the document's first unit."""
    n, size = len(values) - kind.length + 1, kind.length
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.view(U), none.view(U)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * hashing.powers(hashing.BASE, len(values)), dtype=U, out=sums[1:])
    at = np.arange(len(values) - kind.gram + 1)
    grams = hashing.between(sums, at, at + kind.gram)
    mask = U((1 << PLACE) - 1)
    least = sliding_least((grams & ~mask) | (mask - at.astype(U)), kind.width)
    place = (mask - (least & mask)).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(n), side="right") - 1
    inside = np.arange(n) + size <= bounds[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none, none.view(U), none.view(U)
    # a run ends before the next one begins, or where its document's windows end
    ends = np.append(np.flatnonzero(new)[1:], n)[np.searchsorted(np.flatnonzero(new), first)]
    ends = np.minimum(ends, bounds[doc[first] + 1] - size + 1)
    windows, anchor = ends - first, place[first] - first
    text = hashing.between(sums, first, ends - 1 + size)
    with np.errstate(over="ignore"):
        text = hashing.mix(text + anchor.astype(U) * U(hashing.BASE) + windows.astype(U))
    return doc[first], first - bounds[doc[first]], windows, anchor, grams[place[first]], text


def document_runs(values: np.ndarray, bounds: np.ndarray, kind: Kind) -> Iterator[tuple[np.ndarray, ...]]:
    """`runs` over pieces of at most hashing.GROUP windows; a long document's pieces overlap by a window."""
    if len(values) <= hashing.GROUP:
        yield runs(values, bounds, kind)
        return
    for i in range(len(bounds) - 1):
        for a in range(bounds[i], max(bounds[i] + 1, bounds[i + 1] - kind.length + 1), hashing.GROUP):
            b = min(a + hashing.GROUP + kind.length - 1, bounds[i + 1])
            doc, start, *rest = runs(values[a:b], np.array([0, b - a]), kind)
            yield doc + i, start + (a - bounds[i]), *rest


def _anchored(kind: Kind):
    """Documents -> runs: kind 1 those that a batch decides, kind 0 the first of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i, j, data, bounds in hashing.documents(batch, 1):
                ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                for doc, *rest in document_runs(*kind.values(data, bounds), kind):
                    got.append((ids[doc], *rest))
            if not got:
                continue
            did, start, windows, anchor, h, c = (np.concatenate(x) for x in zip(*got, strict=True))
            h, c = hashing.signed(h), hashing.signed(c)
            order = np.lexsort((start, did, c, h))
            did, start, windows, anchor, h, c = (x[order] for x in (did, start, windows, anchor, h, c))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            many = ~new | np.append(~new[1:], False)
            packed = pack(start, windows, anchor, many, np.where(new, 0, 1))
            # a later copy in the batch is settled; where copies count everywhere, so is the first, but it still speaks for its text
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(did), pa.array(packed)], names=["h", "c", "did", "packed"])

    return run


def _settle(kind: Kind):
    """Runs sorted by (h, c, did, packed) -> kind 1 and, for each distinct text of a mixed group, kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the last row: whether its text recurs isn't known yet
        group, text, mixed, first = None, None, False, np.zeros((4, 0), np.int64)

        def step(rows: np.ndarray, ahead: np.ndarray) -> np.ndarray:
            nonlocal group, text, mixed, first
            h, c = rows[0], rows[1]
            new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new_h[0] = group is None or h[0] != group
            new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
            new_c[0] = new_h[0] or c[0] != text
            recurs = np.zeros(len(h), bool)
            recurs[:-1] = ~new_c[1:]
            recurs[-1] = ahead.shape[1] > 0 and ahead[0, 0] == h[-1] and ahead[1, 0] == c[-1]
            start, windows, anchor, many, _ = unpack(rows[3])
            many = (many > 0) | recurs | ~new_c
            counts = ~new_c | (many if kind.everywhere else False)
            out = [np.vstack([rows[:3, counts], pack(start[counts], windows[counts], anchor[counts], many[counts], 1)])]
            speakers = rows.copy()
            speakers[3] = pack(start, windows, anchor, many, 2)
            # groups: the first continues the last batch's, the last may go on
            ids = np.cumsum(new_h)
            texts = np.bincount(ids, weights=new_c, minlength=ids[-1] + 1)
            is_mixed = texts >= 2
            if not new_h[0]:
                is_mixed[0] = mixed or texts[0] >= 1
            if not new_h[0] and is_mixed[0] and not mixed:
                out.append(first)
            out.append(speakers[:, new_c & is_mixed[ids]])
            last = ids[-1]
            if last > 0 or new_h[0]:
                at = np.flatnonzero(ids == last)[0]
                first, mixed = speakers[:, at : at + 1], bool(is_mixed[last])
            else:
                mixed = bool(is_mixed[0])
            group, text = h[-1], c[-1]
            return np.hstack(out)

        def told(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in x], names=["h", "c", "did", "packed"])

        for batch in batches:
            rows = np.vstack([batch.column(i).to_numpy() for i in range(4)])
            done = rows[:, unpack(rows[3])[4] == 1]
            rows = np.hstack([held, rows[:, unpack(rows[3])[4] == 0]])
            held, rows = rows[:, -1:], rows[:, :-1]
            yield told(np.hstack([done, step(rows, held)]) if rows.shape[1] else done)
        if held.shape[1]:
            yield told(step(held, held[:, :0]))

    return run


def _cut_out(kind: Kind):
    """did, text, requests -> mixed runs with their units."""
    size = 1 if kind.unit == "byte" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for i, j, data, bounds in hashing.documents(batch, 1):
                values, first = (data, bounds) if size == 1 else kind.values(data, bounds)
                some = wanted.slice(i, j - i)
                flat = some.flatten()
                h, packed = flat.field("h").to_numpy(), flat.field("packed").to_numpy()
                doc = np.repeat(np.arange(j - i), np.diff(some.offsets.to_numpy()))
                start, windows, _, _, _ = unpack(packed)
                a = first[doc] + start
                b = a + windows - 1 + kind.length
                cut = values.tobytes()
                units = [cut[x * size : y * size] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[doc]), pa.array(packed), pa.array(units, pa.binary())], names=["h", "did", "packed", "units"])

    return run


@dataclass
class Mixed:
    """Mixed runs of whole groups: group number, document, start, windows, anchor's offset, recurs, units end to end, and where each run's begin."""

    group: np.ndarray
    did: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    many: np.ndarray
    units: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, kind: Kind) -> Mixed:
        rows = rows.combine_chunks()
        h = rows.column("h").to_numpy()
        start, windows, anchor, many, _ = unpack(rows.column("packed").to_numpy())
        raw = rows.column("units").combine_chunks() if isinstance(rows.column("units"), pa.ChunkedArray) else rows.column("units")
        units = np.frombuffer(b"".join(raw.to_pylist()), np.uint8 if kind.unit == "byte" else U)
        bounds = np.concatenate([[0], np.cumsum(windows - 1 + kind.length)])
        return cls(np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)])), rows.column("did").to_numpy(), start, windows, anchor, many, units, bounds)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every window: its run, and its place in the run."""
        run = np.repeat(np.arange(len(self.windows)), self.windows)
        first = np.cumsum(self.windows) - self.windows
        return run, np.arange(len(run)) - first[run]


def spans(mixed: Mixed, counts: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """did, start, length of what the counting windows cover; counts has a truth for every window in `cells` order."""
    run, place = mixed.cells()
    at = np.flatnonzero(counts)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])
    a, b = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return mixed.did[run[a]], mixed.start[run[a]] + place[a], b - a + kind.length


def _grouped(kind: Kind, judge: Callable[[Mixed], np.ndarray], windows_at_once: int):
    """Mixed runs sorted by h -> spans; whole groups are judged together, several small ones at a time."""

    def judged(tables: list[pa.Table]) -> pa.RecordBatch:
        mixed = Mixed.of(pa.concat_tables(tables), kind)
        return _span_rows(*spans(mixed, judge(mixed), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = [], 0
        for batch in batches:
            tables.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n * kind.width < 2 * windows_at_once:
                continue
            whole = pa.concat_tables(tables)
            h = whole.column("h").to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            if not len(cuts):
                continue
            for a, b in _pieces(cuts, kind, windows_at_once):
                yield judged([whole.slice(a, b - a)])
            tables, n = [whole.slice(cuts[-1])], len(h) - cuts[-1]
        if n:
            whole = pa.concat_tables(tables)
            h = whole.column("h").to_numpy()
            cuts = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            for a, b in _pieces(cuts, kind, windows_at_once):
                yield judged([whole.slice(a, b - a)])

    return run


def _pieces(cuts: np.ndarray, kind: Kind, windows_at_once: int) -> Iterator[tuple[int, int]]:
    a, rows = 0, max(1, windows_at_once // kind.width)
    while a < cuts[-1]:
        i = int(np.searchsorted(cuts, a + rows, side="right"))
        b = int(cuts[max(i - 1, 0)])
        if b <= a:
            b = int(cuts[min(int(np.searchsorted(cuts, a, side="right")), len(cuts) - 1)])
        yield a, b
        a = b


def _span_rows(did: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (did, start, length)], names=["did", "start", "length"])


def _windows(kind: Kind):
    """Mixed runs of hot groups -> each window's hash, document, start; windows that a batch decides get kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mixed = Mixed.of(pa.Table.from_batches([batch]), kind)
            values = hashing.BYTE[mixed.units] if kind.unit == "byte" else mixed.units
            run_of, place = mixed.cells()
            sums = np.zeros(len(values) + 1, U)
            np.cumsum(values * hashing.powers(hashing.BASE, len(values)), dtype=U, out=sums[1:])
            at = mixed.bounds[run_of] + place
            key = hashing.signed(hashing.between(sums, at, at + kind.length))
            did, start, many = mixed.did[run_of], mixed.start[run_of] + place, mixed.many[run_of]
            order = np.lexsort((start, did, key))
            key, did, start, many = key[order], did[order], start[order], many[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            several = np.maximum(many, ~new | np.append(~new[1:], False))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(did), pa.array(pack(start, np.ones_like(start), np.zeros_like(start), several, np.where(new, 0, 1)))], names=["h", "did", "packed"])

    return run


def _rest(kind: Kind, n_parts: int, hot: DataFrame) -> DataFrame:
    """Spans of the windows of hot groups, told apart by 64-bit hashes."""
    dealt = hot.transform(mapped, _windows(kind), "h long, did long, packed long")
    to = F.when(F.col("packed").bitwiseAND(3) == 1, F.xxhash64("did", "packed")).otherwise(F.col("h"))
    dealt = dealt.select("h", F.lit(0).cast("long").alias("c"), "did", "packed").repartition(n_parts, to).sortWithinPartitions("h", "did", "packed")
    return _as_spans(dealt.transform(mapped, _settle(kind), RUNS), kind)


def _as_spans(settled: DataFrame, kind: Kind) -> DataFrame:
    start = F.shiftright("packed", 32)
    windows = F.shiftright("packed", 17).bitwiseAND(0x7FFF)
    return settled.where(F.col("packed").bitwiseAND(3) == 1).select("did", start.alias("start"), (windows - 1 + kind.length).alias("length"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, doc_id, text: did is the id where ids are unique; else numbers in the order of ids, then texts, so that rows stay apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if again.isEmpty():
        return rows.select(F.col("doc_id").alias("did"), "doc_id", "text")
    n_parts = shuffle_partitions(docs.sparkSession)
    ordered = rows.withColumn("v", F.xxhash64("text")).repartitionByRange(n_parts, "doc_id", "v").sortWithinPartitions("doc_id", "v")
    return staged(ordered.select(F.monotonically_increasing_id().alias("did"), "doc_id", "text"), "numbered")


def repeated_spans(rows: DataFrame, kind: Kind, judge: Callable[[Mixed], np.ndarray], *, most: int, windows_at_once: int = 200_000) -> DataFrame:
    """did, start, length (in units) of what is covered by windows that count, for rows(did, doc_id, text). Spans may overlap.

    judge says for every window of whole groups (in `cells` order) whether it counts; groups have at most `most` distinct texts.
    """
    n_parts = shuffle_partitions(rows.sparkSession)
    anchored = rows.select("did", "text").transform(mapped, _anchored(kind), RUNS)
    # a run that its batch has decided needs no company: it goes with its document, and a hot anchor's group keeps one row a batch and text
    to = F.when(F.col("packed").bitwiseAND(3) == 1, F.xxhash64("did", "packed")).otherwise(F.col("h"))
    sorted_runs = anchored.repartition(n_parts, to).sortWithinPartitions("h", "c", "did", "packed")
    settled = staged(sorted_runs.transform(mapped, _settle(kind), RUNS).withColumn("kind", F.col("packed").bitwiseAND(3)), "settled")
    found = _as_spans(settled, kind)
    wanted = settled.where("kind = 2").select("did", "h", "packed")
    if wanted.isEmpty():
        return found
    requests = wanted.groupBy("did").agg(F.collect_list(F.struct("h", "packed")).alias("requests"))
    mixed = staged(rows.join(requests, "did").select("did", "text", "requests").transform(mapped, _cut_out(kind), "h long, did long, packed long, units binary"), "mixed")
    sizes = mixed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("h")
    if sizes.isEmpty():
        small = mixed
    else:
        small = mixed.join(sizes, "h", "left_anti")
        found = found.unionByName(_rest(kind, n_parts, mixed.join(sizes, "h", "left_semi").select("h", "did", "packed", "units")))
    dealt = small.select("h", "did", "packed", "units").repartition(n_parts, "h").sortWithinPartitions("h", "did", "packed")
    return found.unionByName(dealt.transform(mapped, _grouped(kind, judge, windows_at_once), "did long, start long, length long"))


def removed(rows: DataFrame, found: DataFrame, finish, schema: str) -> DataFrame:
    """rows with their spans, as `finish` makes them. Spans are first joined within each document."""
    by_doc = found.groupBy("did").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return rows.join(by_doc, "did", "left").select("doc_id", "text", "spans").transform(mapped, finish, schema)


def union(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by the given ones: starts and ends."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else end


__all__ = ["Kind", "Mixed", "numbered", "removed", "repeated_spans", "union"]
