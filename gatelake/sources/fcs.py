"""Flow cytometry standard files (2.0, 3.0, 3.1) as a Spark data source.

`spark.read.format("fcs").load(folder)` gives a row for each event; with option("part", "meta"), a row for each file. Each file is a
partition; only its header and text segments are read for metadata. Opened through pyarrow's file systems, so any store that they know works.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

META = "path string, version string, n_events long, channels array<struct<channel:string,marker:string>>, spill string, date string, keywords map<string,string>"
EVENTS = "path string, event_id long, values array<float>"


def parse_text(raw: bytes) -> dict[str, str]:
    """Keywords of a text segment; its first character is the delimiter, which stands for itself when doubled."""
    text = raw.decode("utf-8", "replace")
    delimiter, parts = text[0], text[1:].rstrip("\x00 \r\n").split(text[0])
    fields: list[str] = []
    i = 0
    while i < len(parts):
        value = parts[i]
        while i + 2 < len(parts) and parts[i + 1] == "":
            value += delimiter + parts[i + 2]
            i += 2
        fields.append(value)
        i += 1
    if fields and fields[-1] == "":
        fields.pop()
    return {k.strip().upper(): v.strip() for k, v in zip(fields[::2], fields[1::2], strict=False)}


def channels_of(keywords: dict[str, str]) -> list[tuple[str, str]]:
    """(channel, marker) in order of number; '_' becomes '-', a missing marker is empty."""
    n = int(keywords["$PAR"])
    clean = lambda v: v.replace("_", "-").strip()
    return [(clean(keywords.get(f"$P{i}N", "")), clean(keywords.get(f"$P{i}S", ""))) for i in range(1, n + 1)]


def head(read, size: int) -> tuple[str, dict[str, str]]:
    first = read(0, 58)
    version = first[:6].decode("ascii", "replace")
    if not version.startswith("FCS"):
        raise ValueError("not an FCS file")
    a, b = int(first[10:18]), int(first[18:26])
    keywords = parse_text(read(a, b - a + 1))
    keywords["_DATA"] = f"{int(first[26:34] or 0) or int(keywords.get('$BEGINDATA', 0))},{int(first[34:42] or 0) or int(keywords.get('$ENDDATA', 0))}"
    return version, keywords


def matrix(read, keywords: dict[str, str]) -> np.ndarray:
    """Events by channels, as float32; types F, D and I (whole bytes, masked by range)."""
    a, b = map(int, keywords["_DATA"].split(","))
    n, kind = int(keywords["$PAR"]), keywords["$DATATYPE"].upper()
    order = "<" if keywords.get("$BYTEORD", "1,2,3,4").startswith("1") else ">"
    raw = read(a, b - a + 1)
    if kind in "FD":
        width = 4 if kind == "F" else 8
        rows = len(raw) // (n * width)
        return np.frombuffer(raw[: rows * n * width], f"{order}f{width}").reshape(rows, n).astype(np.float32)
    bits = [int(keywords[f"$P{i}B"]) for i in range(1, n + 1)]
    if any(x not in (8, 16, 32) for x in bits):
        raise ValueError("integers of whole bytes only")
    layout = np.dtype([(f"c{i}", f"{order}u{x // 8}") for i, x in enumerate(bits)])
    table = np.frombuffer(raw[: len(raw) // layout.itemsize * layout.itemsize], layout)
    ranges = [int(float(keywords.get(f"$P{i}R", 0) or 0)) for i in range(1, n + 1)]
    columns = [table[f"c{i}"] & ((1 << (r - 1).bit_length()) - 1) if r > 1 else table[f"c{i}"] for i, r in enumerate(ranges)]
    return np.stack(columns, axis=1).astype(np.float32)


def write(path: str, data: np.ndarray, channels: list[tuple[str, str]], extra: dict[str, str] | None = None) -> None:
    """A minimal FCS 3.1 file of floats, for fixtures and exports."""
    body = np.ascontiguousarray(data, dtype="<f4").tobytes()
    words = {"$PAR": str(len(channels)), "$TOT": str(len(data)), "$DATATYPE": "F", "$MODE": "L", "$BYTEORD": "1,2,3,4", "$NEXTDATA": "0", **(extra or {})}
    for i, (c, m) in enumerate(channels, 1):
        words |= {f"$P{i}N": c, f"$P{i}B": "32", f"$P{i}E": "0,0", f"$P{i}R": "262144"} | ({f"$P{i}S": m} if m else {})
    text = ("/" + "/".join(v.replace("/", "//") for kv in words.items() for v in kv) + "/").encode()
    start = 58 + len(text)
    header = "FCS3.1    " + "".join(f"{x:>8}" for x in (58, start - 1, start, start + len(body) - 1, 0, 0))
    with open(path, "wb") as f:
        f.write(header.encode() + text + body)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.part = options["path"], options.get("part", "events")
        self.skip_compensation = options.get("excludeCompensation", "true").lower() == "true"
        self.exclude = options.get("excludeFolder", "DUPLICATES")

    def partitions(self) -> list[InputPartition]:
        fs, at = pa.fs.FileSystem.from_uri(self.root) if "://" in self.root else (pa.fs.LocalFileSystem(), self.root)
        info = fs.get_file_info(at)
        files = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
        names = sorted(f.path for f in files if f.type == pa.fs.FileType.File and f.path.lower().endswith(".fcs"))
        names = [n for n in names if self.exclude not in n.split("/")[:-1] and not (self.skip_compensation and "comp" in n.rpartition("/")[2].lower())]
        return [_File(n) for n in names]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        fs = pa.fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else pa.fs.LocalFileSystem()
        with fs.open_input_file(partition.path) as f:
            read = lambda a, n: f.read_at(n, a)
            try:
                version, keywords = head(read, f.size())
            except (ValueError, KeyError, struct.error):
                return  # not readable: no rows
            if self.part == "meta":
                spill = keywords.get("$SPILLOVER") or keywords.get("SPILL") or keywords.get("$COMP")
                date = " ".join(x for x in (keywords.get("$DATE"), keywords.get("$ETIM")) if x) or None
                yield (partition.path, version, int(keywords.get("$TOT", 0)), channels_of(keywords), spill, date, {k: v for k, v in keywords.items() if k != "_DATA"})
                return
            data = matrix(read, keywords)
            for a in range(0, len(data), 8192):
                part = data[a : a + 8192]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(part)), pa.array(np.arange(a, a + len(part))), lists], names=["path", "event_id", "values"])


class FCSDataSource(DataSource):
    """Options: path (file or folder), part (events or meta), excludeCompensation, excludeFolder."""

    @classmethod
    def name(cls) -> str:
        return "fcs"

    def schema(self) -> str:
        return META if self.options.get("part") == "meta" else EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(FCSDataSource)


def controls_of(names: list[str], control_names: list[str], ctrl_id: str = "FMO") -> tuple[list[str], dict[str, list[str]]]:
    """Primary files, and files of each control by name; a control without a file has an empty list."""
    ctrl = [n for n in names if ctrl_id.lower() in n.rpartition("/")[2].lower()]
    return [n for n in names if n not in ctrl], {c: [n for n in ctrl if c.lower() in n.lower()] for c in control_names}
