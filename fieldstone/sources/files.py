"""Reading and writing vectors, observations and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_vector(path: str, v: DataFrame, parts: int = 8) -> None:
    """A vector in index order; the index is a column, so nothing is gathered."""
    v.select("i", "v").repartitionByRange(parts, "i").sortWithinPartitions("i").write.mode("overwrite").parquet(path)


def load_vector(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("i long, v double").parquet(path)


def write_point_csv(path: str, points: DataFrame, values: DataFrame) -> None:
    """points (t, x, y[, z]) with values (t, v) as CSV with a header."""
    points.join(values, "t").drop("t").withColumnRenamed("v", "value").write.mode("overwrite").option("header", True).csv(path)


def read_point_csv(spark: SparkSession, path: str, dims: int = 2) -> DataFrame:
    columns = [f"{c} double" for c in "xyz"[:dims]] + ["value double"]
    return spark.read.option("header", True).schema(", ".join(columns)).csv(path)


def write_field(path: str, name: str, cycle: int, time: float, coordinates: DataFrame, v: DataFrame) -> None:
    """Append one cycle of a named field; cycles and names are partitions, so a reader takes only what it asks for."""
    rows = coordinates.join(v, "i").select("i", "x", "y", "v", F.lit(float(time)).alias("time"), F.lit(name).alias("name"), F.lit(cycle).alias("cycle"))
    rows.write.mode("append").partitionBy("name", "cycle").parquet(path)


def read_field(spark: SparkSession, path: str, name: str, cycle: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).filter(F.col("name") == name)
    return df if cycle is None else df.filter(F.col("cycle") == cycle)


def write_trajectory(path: str, x: DataFrame) -> None:
    x.write.mode("overwrite").partitionBy("k").parquet(path)
