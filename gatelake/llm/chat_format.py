r"""Conversations as training text, held to a grammar by a round trip.

The grammar, with one turn after another and no state between turns:

    user       <s>[INST] text [/INST]
    assistant   text</s>                                (a space before the text)
    system     <s>[SYS] text [/SYS]
    any other  <s>[ROLE] role [/ROLE][TURN] text [/TURN]

A parser reads rendered text back: it looks at the start of a turn, takes what follows up to the next control string, and stops with an error at any
control string that is out of place. Turns are rendered as they are; if what the parser recovers isn't the source, the turns that don't come back are
escaped: a backslash goes behind the first character of each control string in them, and of each string that looks like an escaped one. The
parser takes one backslash away again. That is repeated until source and recovered turns are identical.

Long conversations come in segments of about SEGMENT characters (a parameter) that end between turns; one after another they are the formatted text. The loss mask is
a list of spans of code points: the assistants' texts, without control strings.

Odd tables: null roles and texts count as empty, rows are ordered by turn, role and text (nulls first), repeated rows are turns of their own, and rows
without a conv_id are one conversation, whose id is null. An empty table gives none. Other columns, of whatever name, are ignored. A long text is a
segment of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions

#: Characters of a segment, about.
SEGMENT = 1 << 18
CONTROL = re.compile(r"\[/?(?:INST|SYS|ROLE|TURN)\]|</?s>")
_ESCAPE = re.compile(r"(?<=\[)(?=\\*/?(?:INST|SYS|ROLE|TURN)\])|(?<=<)(?=\\*/?s>)")
_UNESCAPE = re.compile(r"(?<=\[)\\(?=\\*/?(?:INST|SYS|ROLE|TURN)\])|(?<=<)\\(?=\\*/?s>)")
#: What stands before and behind the text of a turn.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<s>[SYS] ", " [/SYS]")}
OTHER = ("<s>[ROLE] ", " [/ROLE][TURN] ", " [/TURN]")
SCHEMA = "conv_id long, segment long, text string, n_turns long, loss array<struct<start: long, end: long>>"


class GrammarError(ValueError):
    """The text isn't in the grammar."""


class Turn(NamedTuple):
    role: str
    text: str
    start: int = -1  #: code points of the text, as it stands in the formatted text
    end: int = -1


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def rendered(role: str, text: str) -> str:
    """One turn, with role and text as they are."""
    if marks := MARKS.get(role):
        return f"{marks[0]}{text}{marks[1]}"
    return f"{OTHER[0]}{role}{OTHER[1]}{text}{OTHER[2]}"


def parse(said: str) -> list[Turn]:
    """The turns of a rendered text, unescaped; GrammarError if it isn't one."""
    out, at = [], 0

    def content(start: int, close: str) -> int:
        """Where the content from start ends; behind it stands close."""
        found = CONTROL.search(said, start)
        end = -1 if found is None else found.start() - (len(close) - len(close.lstrip(" ")))
        if end < start or not said.startswith(close, end):
            raise GrammarError(f"{close!r} is missing behind {start}")
        return end

    while at < len(said):
        role, (mark, close) = next(((r, m) for r, m in MARKS.items() if said.startswith(m[0], at)), (None, OTHER[:2]))
        if not said.startswith(mark, at):
            raise GrammarError(f"no turn begins at {at}")
        start = at + len(mark)
        end = content(start, close)
        if role is None:
            role = unescape(said[start:end])
            if role in MARKS:
                raise GrammarError(f"{role} has marks of its own")
            start, close = end + len(close), OTHER[2]
            end = content(start, close)
        out.append(Turn(role, unescape(said[start:end]), start, end))
        at = end + len(close)
    return out


def _same(said: str, turns: list[tuple[str, str]]) -> list[Turn] | None:
    """The turns of said, if they are the given ones."""
    try:
        got = parse(said)
    except GrammarError:
        return None
    return got if [(t.role, t.text) for t in got] == turns else None


def render(turns: list[tuple[str, str]]) -> tuple[str, list[Turn]]:
    """The text of the turns and what the parser makes of it, which is the same turns again."""
    parts = [rendered(*t) for t in turns]
    while (got := _same(said := "".join(parts), turns)) is None:
        conflicts = [i for i, (p, t) in enumerate(zip(parts, turns, strict=True)) if _same(p, [t]) is None]
        fixed = {i: rendered(*map(escape, turns[i])) for i in conflicts}
        if not conflicts or all(parts[i] == p for i, p in fixed.items()):
            raise GrammarError("no escaping brings the turns back")
        for i, p in fixed.items():
            parts[i] = p
    return said, got


def formatted(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment (ascending in a conversation, with gaps), text, n_turns, loss (spans of the segment's text) of turns(conv_id, turn, role, text).

    Conversations are cut wherever a segment is full or a partition ends, so none of any length meets in one task.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *said)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    return mapped(ordered.select("conv_id", "role", "text"), lambda batches: _segments(batches, segment), SCHEMA)


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    conv, turns, size = None, [], 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal number
        said, got = render(turns)
        out.append((conv, number, said, len(turns), [{"start": t.start, "end": t.end} for t in got if t.role == "assistant"]))
        number += 1

    for batch in batches:
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = len(rendered(role, text))
            if turns and (c != conv or size + own > most):
                close()
                turns, size = [], 0
            conv, size = c, size + own
            turns.append((role, text))
        if out:
            yield _batch(out)
            out.clear()
    if turns:
        close()
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"conv_id": pa.int64(), "segment": pa.int64(), "text": pa.string(), "n_turns": pa.int64(), "loss": spans}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed for each turn), loss_chars, loss_sha256 (of the masked text, unescaped), formatted_chars: from the segments' text and mask alone.

    A conversation's segments are hashed one after another, so a task holds one of them at a time.
    """
    ordered = segments.select("conv_id", "segment", "text", "loss").repartition(shuffle_partitions(segments.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment")
    return mapped(ordered, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, turns, loss, n, chars, size = None, None, None, 0, 0, 0
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in zip(names, zip(*out, strict=True), strict=True)], names=names)
        out.clear()
        return got

    for batch in batches:
        for conv, said, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
            if turns is None or conv != now:
                if turns is not None:
                    out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                now, turns, loss, n, chars, size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for t in parse(said):
                turns.update(f"{t.role}\n{t.text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for span in mask:
                text = unescape(said[span["start"] : span["end"]])
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            size += len(said)
        if out:
            yield flush()
    if turns is not None:
        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        yield flush()
