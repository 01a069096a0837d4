"""Shared pieces: the shared folder, staged tables, text columns."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode (tests); on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="gatelake-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # what isn't unstaged goes with the application
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in dfs:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch at most (a longer row is a batch of its own), so that rows of long texts don't add up in a worker.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(f, schema) with batches of bounded bytes, and workers that give their memory back after a task."""
    conf = df.sparkSession.conf
    if _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        freed()

    return df.mapInArrow(run, schema)


def freed() -> None:
    """Give the memory that nothing uses back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _bytes(said: str) -> int:
    return int(said.rstrip("bB")) if said.rstrip("bB").isdigit() else 1 << 62


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns, text as string with null as empty; whatever else the table has is left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema with more fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
