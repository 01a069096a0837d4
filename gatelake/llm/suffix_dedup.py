"""Removal of repeated byte strings by suffix arrays and longest-previous-factor arrays.

Anchors route the places that can repeat (see repeats). Each group's windows are sorted as suffixes; previous and next smaller positions
in suffix order give every place's longest earlier match, its longest previous factor. From the same order, the neighbours'
common prefixes tell whether a string occurs anywhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .repeats import Kind, Mixed

LENGTH, GRAM = 200, 64
#: Distinct texts around one anchor that are sorted in one task; larger groups are told apart by window hashes.
MOST = 20_000


def suffix_order(units: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at the given places in the order of their first `depth` bytes (ties by place), and each one's common prefix with the one before.

    Every suffix has at least `depth` bytes; no byte may be 255, which UTF-8 never has.
    """
    rows = np.lib.stride_tricks.sliding_window_view(units + np.uint8(1), depth)[at]  # numpy's strings end at a zero byte
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")
    shared = np.zeros(len(at), np.int64)
    for i in range(1, len(at), 4096):
        part = order[i - 1 : i + 4096]
        differ = rows[part[1:]] != rows[part[:-1]]
        shared[i : i + len(part) - 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return order, shared


def _smaller(position: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank, the common prefix with the nearest rank before that has a smaller position, and that rank (-1: none)."""
    back, common = [-1] * len(position), [0] * len(position)
    stack: list[tuple[int, int]] = []  # rank, and its common prefix with the one below it in the stack
    place, lcp = position.tolist(), shared.tolist()
    for i, p in enumerate(place):
        least = lcp[i] if i else 0
        while stack and place[stack[-1][0]] > p:
            least = min(least, stack.pop()[1])
        if stack:
            back[i], common[i] = stack[-1][0], least
        stack.append((i, least))
    return np.array(common, np.int64), np.array(back, np.int64)


def longest_previous_factor(order: np.ndarray, shared: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the length of its longest match that begins at a smaller position, and the matching suffix (-1: none).

    order and shared are a suffix array and its common prefixes; position orders the suffixes in the corpus.
    """
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranked = position[order]
    before, b = _smaller(ranked, shared)
    flipped = np.concatenate([[0], shared[:0:-1]])
    after, a = (x[::-1] for x in _smaller(ranked[::-1], flipped))
    a = np.where(a >= 0, len(order) - 1 - a, -1)
    length, source = np.where(after > before, after, before), np.where(after > before, a, b)
    out, at = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    out[order] = length
    at[order] = np.where((length > 0) & (source >= 0), order[source], -1)
    return out, at


def judge(kind: Kind):
    """Which windows of whole groups count."""

    def run(mixed: Mixed) -> np.ndarray:
        run_of, place = mixed.cells()
        order, shared = suffix_order(mixed.units, mixed.bounds[run_of] + place, kind.length)
        # positions in the corpus order: document, then start
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((mixed.start[run_of] + place, mixed.did[run_of]))] = np.arange(len(order))
        earlier = longest_previous_factor(order, shared, rank)[0] >= kind.length
        if not kind.everywhere:
            return earlier
        # a later match is an earlier match of the mirrored order
        later = longest_previous_factor(order, shared, -rank)[0] >= kind.length
        return earlier | later | (mixed.many[run_of] > 0)

    return run


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                a, b = repeats.union(np.array([x["start"] for x in found or []], np.int64), np.array([x["length"] for x in found or []], np.int64))
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if len(a) else raw
                out.append((len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), list(zip(a.tolist(), b.tolist(), strict=True)), kept))
            columns = [batch.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns += [pa.array([[{"start": s, "end": e} for s, e in x[4]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[5] for x in out], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, with_text: bool = False, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans and kept bytes if `with_text`.

    Texts are UTF-8 bytes, null as empty; matches don't cross documents. A byte goes if it is in a string of `length` bytes that also starts earlier
    (smaller id, or the same document further left) or, without `keep_first`, anywhere else. Overlaps count; strings are judged on the input. What is kept
    may cut characters in two, hence bytes. Rows that share an id are documents of their own, ordered by a hash of their text. Texts shorter
    than `length` lose nothing. An empty table gives no rows; other columns are ignored.
    """
    kind = Kind("byte", length, min(gram, length), not keep_first)
    rows = repeats.numbered(docs, id_col, text_col)
    found = repeats.repeated_spans(rows, kind, judge(kind), most=most)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,end:long>>, kept binary" * with_text
    return repeats.removed(rows, found, _finish(with_text), schema)
