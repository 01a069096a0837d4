"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CHANNELS = 6
#: Common table expression of `cells` for the SQL side.
CELLS = "cells AS (SELECT vec_id AS event_id, label::VARCHAR AS sample_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE * 10000 AS c{i}" for i in range(CHANNELS)) + " FROM embeddings)"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("{CELLS}", CELLS)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ten samples: event_id, sample_id and channels c0... of the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("event_id"), F.col("label").cast("string").alias("sample_id"), *[(F.col("embedding")[i].cast("double") * 10000).alias(f"c{i}") for i in range(CHANNELS)])


def r6(c: str | Column, name: str | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x, 6).alias(name or c)
