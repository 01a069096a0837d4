"""Vectorised 64-bit hashes of words and byte ranges, straight from Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word or range is hashed whole.
SEGMENT = 1 << 20
#: Bytes of text that a worker takes up at a time; a longer document is taken whole.
GROUP = 2 << 20

U = np.uint64
_rng = np.random.default_rng(20240607)  # fixed: every worker must draw the same tables
BYTE = _rng.integers(0, 1 << 64, 256, dtype=U)
BASE = int(_rng.integers(0, 1 << 62)) * 4 + 3
INVERSE = pow(BASE, -1, 1 << 64)
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers in which every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, SEGMENT + 1), U(base))
        x[0] = 1
        got = np.cumprod(x, dtype=U)
        if n > SEGMENT + 1:
            return got
        _powers[base] = got
    return _powers[base][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `between` gets the hash of any range."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), dtype=U, out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; documents lie between successive bounds."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = SEPARATORS[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    inside = ~gap[1:-1]
    return np.flatnonzero(inside & (gap[:-2] | edge[:-1])), np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
        at = start[i]
        out[i:j] = between(prefix(data[at : end[j - 1]]), start[i:j] - at, end[i:j] - at)
        i = j
    return out


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * U(BASE) + hashes[i : n + i]
    return mix(out)


def documents(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of rows (first, behind the last) with their text's bytes and bounds. Null counts as empty."""
    text = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, raw = text.buffers()
    n = len(text)
    bounds = np.frombuffer(offsets, kind)[text.offset : text.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if text.null_count:  # a null's bytes, if any, don't count
        keep = np.asarray(text.is_valid())
        size = np.diff(bounds) * keep
        if (size != np.diff(bounds)).any():
            data = np.concatenate([data[a:b] for a, b, k in zip(bounds[:-1], bounds[1:], keep, strict=True) if k] or [data[:0]])
            bounds = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + GROUP, side="right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
