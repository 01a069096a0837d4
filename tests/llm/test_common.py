import pyarrow as pa
from gatelake.llm import common
from pyspark.sql import functions as F


def test_batches_have_bounded_bytes(spark):
    """Rows of long texts come a few at a time; a row longer than the bound comes alone."""
    df = spark.range(0, 64, 1, 1).select("id", F.expr("repeat('x', CASE WHEN id = 7 THEN 12000000 ELSE 500000 END)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = common.mapped(df, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 64 and max(r.n for r in got) <= 10
    assert all(r["size"] <= common.BATCH_BYTES + 12_100_000 for r in got)


def test_a_smaller_bound_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1000")
    try:
        common.mapped(spark.range(1), lambda b: b, "id long")
        assert spark.conf.get(key).rstrip("bB") == "1000"
    finally:
        spark.conf.unset(key)
