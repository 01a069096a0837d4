import pyarrow.fs
import pytest
from gatelake.llm import warc
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def pages(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y %", "<p>é</p>"), (9, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "", "WARC/1.1\r\n\r\nnot a record" * 3), (6, "u", "z" * 300000), (7, "u", "z" * 300000), (8, "u", "one"), (8, "u", "one"), (8, "u", "two")]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "5 AS offset", "'f' AS file"), rows


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    df, rows = pages(spark)
    index = warc.write(df, min_revisit_bytes=least)
    got = warc.read(index, folder=index.folder_path).toPandas()
    assert len(got) == len(rows)
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    for i, body in raw:
        same = [j for j, b in raw if b == body and len(body) >= least]
        top = max(same, default=i)
        r = got[(got.page_id == i) & (got.payload_digest == warc.digest(body))].iloc[0]
        assert r.payload_bytes == len(body) and r.record_type == ("revisit" if i < top else "response")
        assert (r.refers_to == top and r.payload is None) if i < top else bytes(r.payload) == body
    assert got[got.page_id == 9].url.isna().all() and (got[got.page_id == 2].url == "http://b/%0D%0AX: y %25").all()


def test_index_gives_records_one_by_one(spark):
    import zlib

    df, _ = pages(spark)
    index = warc.write(df)
    fs, at = pyarrow.fs.FileSystem.from_uri(index.folder_path)
    for r in index.collect():
        with fs.open_input_file(f"{at}/{r.file}") as f:
            assert warc.parse(zlib.decompress(f.read_at(r.length, r.offset), 31))["page_id"] == r.page_id


def test_selection_reads_less(spark):
    df, _ = pages(spark)
    index = warc.write(df)
    assert [r.page_id for r in warc.read(index.where("page_id = 7"), folder=index.folder_path).collect()] == [7]


def test_damage_is_found(spark):
    body = warc.record(1, "u", b"hello", None)
    assert warc.parse(body)["payload"] == b"hello"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(body.replace(b"hello", b"hellp"))


def test_empty_table(spark):
    index = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.read(index, folder=index.folder_path).count() == 0


def test_pages_without_an_id(spark):
    """They are responses of their own, and nothing refers to them."""
    df = spark.createDataFrame([(None, "u", "same"), (None, "v", "same"), (4, "w", "same"), (7, "x", "same"), (None, None, None)], SCHEMA)
    index = warc.write(df)
    got = warc.read(index, folder=index.folder_path).toPandas()
    none = got[got.page_id.isna()]
    assert len(got) == 5 and list(none.record_type) == ["response"] * 3 and none.refers_to.isna().all()
    assert got[got.page_id == 4].refers_to.tolist() == [7] and got[got.page_id == 7].record_type.tolist() == ["response"]
    assert sorted(bytes(x) for x in none.payload) == [b"", b"same", b"same"]


def test_folders_by_scheme():
    assert warc.opened_folder("file:/tmp/x")[1] == warc.opened_folder("file:///tmp/x")[1] == "/tmp/x"
