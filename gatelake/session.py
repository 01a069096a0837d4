"""Making the package importable on executors, a shared scratch folder, and the package's logger."""

from __future__ import annotations

import logging
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; Spark's file server hands it to every new executor."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    into = tempfile.mkdtemp(prefix="gatelake-package-")
    context.addPyFile(shutil.make_archive(f"{into}/gatelake", "zip", here.parent, here.name))
    _SHIPPED.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, or below a temporary folder in local mode; on a cluster the setting is needed."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='gatelake-')}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there. The files go with the application."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def logger(name: str = "gatelake", level: int | str = logging.INFO, path: str | None = None) -> logging.Logger:
    """A logger that writes to standard error, or to a file; asked for again, it is the same one."""
    out = logging.getLogger(name)
    if not out.handlers:
        handler = logging.FileHandler(path) if path else logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        out.addHandler(handler)
        out.setLevel(level)
    return out
