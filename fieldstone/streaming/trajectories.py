"""Observations that arrive as a stream: levels of a trajectory and running field statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(stream: DataFrame, step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, i, v): sums of a stream (ts, i, v) by time level; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", step).alias("w"), "i").agg(F.sum("v").alias("v")).select(F.col("w.start").alias("start"), "i", "v")


def running_moments(stream: DataFrame) -> DataFrame:
    """(i, n, mean, var) of each index of a stream (i, v) as it stands after every batch; var is null after one value."""
    return stream.groupBy("i").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
