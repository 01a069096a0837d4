"""Removal of repeated word sequences by seed and extend.

Winnowed anchors are the seeds (see repeats). Documents that share an anchor meet in its group, where all their matches are
extended word by word to both sides at once: extending refines the classes of places whose text is still equal, so no
pairs are formed. Left and right classes together give the maximal repeats around the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing, repeats
from .repeats import Kind, Mixed

LENGTH, GRAM = 20, 8
#: Distinct texts around one anchor that are extended in one task; larger groups are told apart by window hashes.
MOST = 200_000


def _refined(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs (class, value)."""
    order = np.lexsort((values, classes))
    new = np.ones(len(order), bool)
    new[1:] = (classes[order[1:]] != classes[order[:-1]]) | (values[order[1:]] != values[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def judge(kind: Kind):
    """Which windows of whole groups have an equal window earlier (or anywhere else, if the kind says so)."""

    def run(mixed: Mixed) -> np.ndarray:
        n, anchor = len(mixed.group), mixed.anchor
        seed = mixed.bounds[:-1] + anchor
        ends = mixed.bounds[1:]
        apart = np.arange(n) + (int(mixed.group[-1]) + 1 if n else 0)

        def extended(steps: int, side: int) -> list[np.ndarray]:
            """Classes after 0, 1, ... words; a run whose units end is alone in its class from there on."""
            out = [mixed.group]
            for i in range(steps):
                at = seed + kind.gram + i if side > 0 else seed - 1 - i
                inside = (at < ends) if side > 0 else (at >= mixed.bounds[:-1])
                word = hashing.signed(mixed.units[np.where(inside, at, 0)])
                out.append(_refined(np.where(inside, out[-1], out[-1].max(initial=0) + 1 + apart), np.where(inside, word, 0)))
            return out

        left, right = extended(kind.width - 1, -1), extended(kind.width - 1, 1)
        run_of, place = mixed.cells()
        back = anchor[run_of] - place  # words of the window before the anchor
        key = _refined(np.stack(left)[back, run_of], np.stack(right)[kind.width - 1 - back, run_of])
        key = _refined(key, back)
        order = np.lexsort((mixed.start[run_of] + place, mixed.did[run_of], key))
        again = np.zeros(len(order), bool)
        again[1:] = key[order[1:]] == key[order[:-1]]
        out = np.empty(len(order), bool)
        out[order] = again | np.append(again[1:], False) if kind.everywhere else again
        return out | (mixed.many[run_of] > 0) if kind.everywhere else out

    return run


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                a, b = repeats.union(np.array([x["start"] for x in found or []], np.int64), np.array([x["length"] for x in found or []], np.int64))
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(words)]
                kept = b" ".join(w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y])
                out.append((len(words), int((b - a).sum()), hashlib.sha256(kept).hexdigest(), list(zip(a.tolist(), b.tolist(), strict=True)), kept.decode("utf-8", "replace") if with_text else None))
            columns = [batch.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(2)), pa.array([x[2] for x in out], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns += [pa.array([[{"start": s, "end": e} for s, e in x[3]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[4] for x in out], pa.string())]
                names += ["repeats", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, with_text: bool = False, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: doc_id, n_words, n_removed, kept_sha256, and the maximal repeats and kept words if `with_text`.

    Words are split at ASCII white space and otherwise unchanged; null has none. A word goes if it is in a window of `length` words that also starts earlier
    (smaller id, or the same document further left) or, without `keep_first`, anywhere else. Windows are judged on the input. Rows that share an
    id are documents of their own, ordered by a hash of their text. Texts of fewer words lose nothing. Words are
    compared by 64-bit hashes. An empty table gives no rows; other columns are ignored.
    """
    kind = Kind("word", length, min(gram, length), not keep_first)
    rows = repeats.numbered(docs, id_col, text_col)
    found = repeats.repeated_spans(rows, kind, judge(kind), most=most)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", repeats array<struct<start:long,end:long>>, kept string" * with_text
    return repeats.removed(rows, found, _finish(with_text), schema)
