"""WARC archives: written with an index of byte ranges first, read back by coalesced range reads.

Every task writes gzip members of its own to its own files in the shared folder and returns their index rows. The index is a
table, so files of failed attempts are never referred to. Reading sorts the wanted index rows by file and offset, joins
neighbouring ranges into large reads, and checks every record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, mapped, shuffle_partitions, staged

FILE_BYTES = 1 << 30
#: Reads join records that are at most GAP bytes apart, up to READ bytes; tasks get CHUNK bytes of a file at a time.
GAP, READ, CHUNK = 64 << 10, 8 << 20, 64 << 20
#: The archives carry no capture time of their own, so equal input gives equal files.
DATE = "2000-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, record_type string, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    own = name.removeprefix("<urn:page:").removesuffix(">")
    return None if own == "none" else int(own)


def _line(value: str) -> str:
    """A header value: percent-encoded where it would break the line."""
    return "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with an HTTP response; a revisit has the response's head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What `record` wrote; an error if the block or the payload isn't what its headers say."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": _number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": said, "record_type": fields["WARC-Type"], "refers_to": _number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload if fields["WARC-Type"] == "response" else None}


#: Arrow's names of schemes that Hadoop names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "file": "file"}


def opened_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """A folder that Hadoop names with its scheme, for Arrow."""
    scheme, _, rest = folder.partition(":")
    return pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest.removeprefix('//')}")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened_folder(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows: dict[str, list] = {k: [] for k in ("file", "offset", "length", "page_id", "url", "record_type", "payload_digest")}
                for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(record(page_id, url, payload, refers_to)) + pack.flush()
                    out.write(member)
                    for k, v in zip(rows, (name, offset, len(member), page_id, url, "response" if refers_to is None else "revisit", digest(payload)), strict=True):
                        rows[k].append(v)
                    offset += len(member)
                kinds = {"offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()], names=list(rows))
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, *, min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); return the index table, whose folder_path is the archives' folder.

    Of rows with equal payloads of at least `min_revisit_bytes` bytes, that with the largest page_id is the response, and the others are
    revisits of it. A null html is an empty payload, a null url is left out. Rows that repeat a page_id with the same payload are
    alike: all responses or all revisits. A row without a page_id is a response, which no other row refers to. An empty table gives an empty
    index. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or fresh_path(spark, "warc"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    folder = fs.makeQualified(path).toString()  # executors open the very same place
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = rows.select("page_id", F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_revisit_bytes)
    first = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(first, "sha1").where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()
    known = rows.withColumn("sha1", F.unhex(F.sha1(payload))).join(revisits, ["page_id", "sha1"], "left")
    index = known.select("page_id", "url", "html", "refers_to").transform(mapped, _writer(folder), INDEX)
    index = staged(index, "warc_index")
    index.folder_path = folder
    return index


def _reader(folder: str, with_payload: bool):
    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        run: list[tuple[str, int, int]] = []
        for r in rows:
            if run and (r[0] != run[0][0] or r[1] - (run[-1][1] + run[-1][2]) > GAP or r[1] + r[2] - run[0][1] > READ):
                yield run
                run = []
            run.append(r)
        if run:
            yield run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened_folder(folder)
        opened, name = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            for some in ranges(rows):
                if some[0][0] != name:
                    if opened is not None:
                        opened.close()
                    name = some[0][0]
                    opened = fs.open_input_file(f"{at}/{name}")
                start = some[0][1]
                raw = opened.read_at(some[-1][1] + some[-1][2] - start, start)
                got = [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for _, o, n in some]
                columns = [pa.array([g["page_id"] for g in got], pa.int64()), pa.array([g["url"] for g in got], pa.string()), pa.array([g["payload_bytes"] for g in got], pa.int64()), pa.array([g["payload_digest"] for g in got], pa.string()), pa.array([g["record_type"] for g in got], pa.string()), pa.array([g["refers_to"] for g in got], pa.int64())]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    columns.append(pa.array([g["payload"] for g in got], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if opened is not None:
            opened.close()

    return run


def read(index: DataFrame, *, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows, checked; filter the index first to read a selection only."""
    spark = index.sparkSession
    spread = index.select("file", "offset", "length").repartition(shuffle_partitions(spark), "file", F.floor(F.col("offset") / CHUNK)).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return spread.transform(mapped, _reader(folder, with_payload), schema)
