"""Streams: stateless gates run on readStream unchanged; windowed counts are below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate_counts(gated: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", population: str = "population") -> DataFrame:
    """Events of each population in each window of event time; later rows than `late` are dropped by the watermark."""
    gated = gated.withColumn(time, F.col(time).cast("timestamp"))
    return gated.withWatermark(time, late).groupBy(F.window(time, window), population).agg(F.count("*").alias("n"))
