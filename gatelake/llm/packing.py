"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing depends on the pieces' lengths only, and these are at most `capacity`. So the driver
packs the histogram of lengths (`capacity` numbers, however many documents there are): a segment tree over
remaining capacities finds the tightest open bin in logarithmic time, and all bins of that capacity
are filled at once. The plan is a list of runs (length, ranks) -> (bins, offset), whose number is bounded by
`capacity` squared and not by the documents. Executors then look up each piece's rank among the pieces of its
length. Ranks come from per-partition counts, so no key is ever gathered into one task.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, mapped, staged

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Encoded chunks that a worker keeps; beyond that it starts over. Affects speed only.
CACHE_ENTRIES = 400_000


class TightestFit:
    """Segment tree over remaining capacities; a leaf is set while some open bin has that capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, on: bool) -> None:
        at += self.size
        self.any[at] = on
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def first(self, least: int) -> int | None:
        """The smallest set leaf that is at least `least`."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Pack histogram[length] pieces of each length. Rows: length, first rank, pieces, first bin, pieces a bin, offset.

    Piece r of a row (r from 0) goes to bin `first bin + r // pieces a bin`, at `offset + r % pieces a bin * length`.
    """
    tree, open_bins, n_bins, rows = TightestFit(capacity), {}, 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.first(length)
            if room is None:
                room, first = capacity, n_bins
                n = -(-left // (capacity // length))
                n_bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            some = left - full * each if full < n else 0
            if full:
                rows.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
            if some:
                rows.append((length, rank + full * each, some, first + full, some, capacity - room))
                put(room - some * length, first + full, 1)
            put(room, first + full + bool(some), n - full - bool(some))
            rank += full * each + some
            left -= full * each + some
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def merge_ranks(tokenizer: str) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if the tokenizer (its file's text) is a plain byte-level BPE whose merges are in the order of their ids."""
    said = json.loads(tokenizer)
    model, split = said["model"], said.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # Byte-level vocabularies print each byte as a character: printable Latin-1 as itself, the rest from U+0100 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in said.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(x + y) for x, y in pairs]
    if None in ids or any(x >= y for x, y in zip(ids[:-1], ids[1:], strict=True)):
        return None
    return {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items() if k not in special}


class Kept(dict):
    """Ids by chunk (without its leading space), made when first asked for."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers; those of the tokenizer whose file has the given text.

    A byte-level tokenizer cuts a text before it merges bytes, and always cuts in front of a single space or behind a single line feed. So
    the chunks between these are encoded once and kept. Texts with other runs of white space or with special
    tokens go to the tokenizer whole.
    """

    #: The split pattern of byte-level BPE, and white space besides space and line feed.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    spaces = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        if ranks := merge_ranks(tokenizer):
            import tiktoken

            bpe = tiktoken.Encoding("chunks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            ids = lambda x: array("I", bpe.encode_ordinary(x)).tobytes()
            self.first, self.kept, self.feed = Kept(ids), Kept(lambda x: ids(" " + x)), ids("\n")
        else:
            self.kept = None

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bool:
        """Only single spaces and line feeds between chunks, and no special tokens."""
        if "  " in text or " \n" in text or "\n\n" in text or "<|" in text or text[-1] in " \n":
            return False
        return not any(c in text for c in (self.spaces[:8] if text.isascii() else self.spaces))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kept is None or not self.plain(text):
            return self.direct(text)
        for x in (self.kept, self.first):
            if len(x) > CACHE_ENTRIES:
                x.clear()
        lines = []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            lines.append((self.first[head] if head else b"") + b"".join(map(self.kept.__getitem__, tail)))
        return self.feed.join(lines)


#: The greatest tokenizer file that is sent to executors.
TOKENIZER_BYTES = 64 << 20


def _cut(sent, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()
    encoders: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.append(Encoder(sent.value))
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("task", "doc_id", "piece", "start", "length", "ids_crc32", "nth", *["ids"] * with_ids)}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoders[-1](text) + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start - 1) % capacity + 1 if piece == 0 else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    nth = seen[length] = seen.get(length, -1) + 1
                    row = (task, doc_id, piece, start, length, zlib.crc32(part), nth)
                    for k, v in zip(out, row, strict=False):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    start, piece = start + length, piece + 1
            kinds = {"task": pa.int32(), "piece": pa.int32(), "doc_id": batch.column(0).type, "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return run


def _place(rows: np.ndarray):
    lengths = {int(x): rows[rows[:, 0] == x] for x in np.unique(rows[:, 0])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            bins, offsets = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                plan = lengths[int(length[part[0]])]
                run_of = plan[np.searchsorted(plan[:, 1], rank[part], side="right") - 1]
                r = rank[part] - run_of[:, 1]
                bins[part] = run_of[:, 3] + r // run_of[:, 4]
                offsets[part] = run_of[:, 5] + r % run_of[:, 4] * length[part]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(bins), pa.array(offsets)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every whole text, cut documents longer than `capacity`, and pack the pieces best-fit decreasing.

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if `with_ids`.
    A null or empty text is the end id alone. Rows with the same id or text are packed each on its own. An empty table
    gives no rows. Other columns are ignored. Ties between pieces of equal length are broken by position in the input.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    said = Path(tokenizer_path).read_bytes()
    if len(said) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} has more than {TOKENIZER_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(said.decode())  # executors needn't have the file
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = staged(rows.transform(mapped, _cut(sent, capacity, end_id, with_ids), f"task int, doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * with_ids), "pieces")
    counts = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece_counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(histogram, capacity)
    ranked = pieces.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("before") + F.col("nth")).alias("rank"))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.transform(mapped, _place(plan), schema)
