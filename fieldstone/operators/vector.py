"""Vectors (i, v), multivectors (i, x: array) and trajectories (k, t, i, v) as frames.

A missing entry is zero; entries are unique by index. Results with one row hold scalars.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a vector that may be sent to the driver or to every executor (8 bytes each).
DRIVER_ENTRIES = 4_000_000


def from_columns(df: DataFrame, index: str, value: str | Column) -> DataFrame:
    return df.select(F.col(index).cast("bigint").alias("i"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("v"))


def from_array(spark: SparkSession, a: Sequence[float]) -> DataFrame:
    """A vector of a driver array."""
    values = np.asarray(a, float)
    return spark.createDataFrame(pa.table({"i": np.arange(len(values)), "v": values}))


def as_vector(spark: SparkSession, x) -> DataFrame:
    """A frame (i, v) as it is, or a vector of an array."""
    return x.select("i", "v") if isinstance(x, DataFrame) else from_array(spark, x)


def gather(x: DataFrame, n: int, limit: int = DRIVER_ENTRIES) -> np.ndarray:
    """The whole vector on the driver; refused above `limit` entries."""
    if n > limit:
        raise ValueError(f"{n} entries are more than {limit}")
    out = np.zeros(n)
    t = x.select("i", "v").toArrow()
    out[t["i"].to_numpy()] = t["v"].to_numpy()
    return out


def allgather(x: DataFrame, limit: int = DRIVER_ENTRIES) -> DataFrame:
    """The vector with a hint that sends it to every executor, if it has at most `limit` entries."""
    return F.broadcast(x) if x.count() <= limit else x


def partition(sizes: DataFrame) -> DataFrame:
    """(rank, first, size): contiguous owner ranges from local sizes (rank, size), one row per rank."""
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("rank", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"), "size")


def owner(i: Column, n: int, parts: int) -> Column:
    """Which of `parts` contiguous ranges of 0..n-1 an index lies in."""
    return F.floor(i * parts / n).cast("int")


def layout(x: DataFrame, n: int, parts: int) -> DataFrame:
    """(rank, first, last, size) of the stored entries by owner."""
    return x.groupBy(owner(F.col("i"), n, parts).alias("rank")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("size"))


def constant(x: DataFrame, alpha: float = 0.0) -> DataFrame:
    """A vector on the indices of x with one value everywhere."""
    return x.select("i", F.lit(float(alpha)).alias("v"))


def scale(x: DataFrame, alpha: float) -> DataFrame:
    return x.select("i", (F.lit(float(alpha)) * F.col("v")).alias("v"))


def axpby(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    """a x + b y: one aggregation over the union, so neither side needs the other's indices."""
    return scale(x, a).unionByName(scale(y, b)).groupBy("i").agg(F.sum("v").alias("v"))


def axpy(x: DataFrame, alpha: float, y: DataFrame) -> DataFrame:
    """x + alpha y."""
    return axpby(1.0, x, alpha, y)


def aypx(x: DataFrame, alpha: float, y: DataFrame) -> DataFrame:
    """alpha x + y."""
    return axpby(alpha, x, 1.0, y)


def pointwise_mult(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnRenamed("v", "w"), "i").select("i", (F.col("v") * F.col("w")).alias("v"))


def pointwise_divide(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnRenamed("v", "w"), "i").select("i", (F.col("v") / F.col("w")).alias("v"))


def inner(x: DataFrame, y: DataFrame) -> DataFrame:
    return pointwise_mult(x, y).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("inner"))


def norms(x: DataFrame) -> DataFrame:
    """All norms, the sum and the extremes in one pass. NaN surfaces in each of them."""
    nan = F.max(F.isnan("v"))
    surfacing = lambda c: F.when(nan, F.lit(float("nan"))).otherwise(c)
    return x.agg(
        F.sum(F.abs("v")).alias("l1"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"), surfacing(F.max(F.abs("v"))).alias("linf"),
        F.sum("v").alias("total"), surfacing(F.max("v")).alias("largest"), surfacing(F.min("v")).alias("least"),
    )


def all_finite(x: DataFrame) -> DataFrame:
    v = F.col("v")
    return x.agg(F.coalesce(F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(True)).alias("finite"))


def any_nonzero(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.bool_or(F.col("v") != 0), F.lit(False)).alias("nonzero"))


# Multivectors: all columns of a row in one array.


def _products(rows: DataFrame) -> DataFrame:
    """(k, l, v): the matrix X^T Y of rows (x, y): one small product per Arrow batch, then the sum of those."""

    def run(batches):
        stack = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        for b in batches:
            if b.num_rows:
                part = stack(b.column(0)).T @ stack(b.column(1))
                k, l = np.indices(part.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(l.ravel()), pa.array(part.ravel())], ["k", "l", "v"])

    return rows.mapInArrow(run, "k int, l int, v double").groupBy("k", "l").agg(F.sum("v").alias("v"))


def dot_mv(x: DataFrame, y: DataFrame) -> DataFrame:
    """(k, l, v): the matrix X^T Y."""
    return _products(x.join(y.withColumnRenamed("x", "y"), "i").select("x", "y"))


def gram(x: DataFrame) -> DataFrame:
    """X^T X without a join."""
    return _products(x.select("x", F.col("x").alias("y")))


def dot_v(x: DataFrame, v: DataFrame) -> DataFrame:
    """(k, v): X^T v."""
    return x.join(v, "i").select("v", F.posexplode("x").alias("k", "a")).groupBy("k").agg(F.sum(F.col("a") * F.col("v")).alias("v"))


def mv_norms(x: DataFrame) -> DataFrame:
    """(k, l2, linf) of each column."""
    return x.select(F.posexplode("x").alias("k", "a")).groupBy("k").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("l2"), F.max(F.abs("a")).alias("linf"))


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(a)) for a in values])


def contract(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)


def reduce(x: DataFrame, a) -> DataFrame:
    """Vector sum_k a_k X_k."""
    return x.select("i", contract(F.col("x"), _numbers(a)).alias("v"))


def mv_zero(v: DataFrame, columns: int) -> DataFrame:
    """A multivector of zero columns on the indices of v."""
    return v.select("i", F.array_repeat(F.lit(0.0), columns).alias("x"))


def mv_from_array(spark: SparkSession, a) -> DataFrame:
    """A multivector of a driver array (rows, columns)."""
    values = np.asarray(a, float)
    return spark.createDataFrame(pa.table({"i": np.arange(len(values)), "x": pa.array(list(values))}))


def mv_columns(x: DataFrame, rank: int, ranks: int) -> DataFrame:
    """The columns that a rank of an ensemble owns: every `ranks`-th, from its own number on."""
    return x.select("i", F.filter("x", lambda _, k: k % ranks == rank).alias("x"))


def mv_exchange(parts: list[DataFrame]) -> DataFrame:
    """The multivector whose columns were dealt out by mv_columns()."""
    out = parts[0].withColumnRenamed("x", "p0")
    for r, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumnRenamed("x", f"p{r}"), "i")
    n = F.size("p0")
    for r in range(1, len(parts)):
        n = n + F.size(f"p{r}")
    lists = F.array(*[F.col(f"p{r}") for r in range(len(parts))])
    at = lambda k: F.element_at(F.element_at(lists, (k % len(parts) + 1).cast("int")), (F.floor(k / len(parts)) + 1).cast("int"))
    return out.select("i", F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at)).alias("x"))


def mv_scale(x: DataFrame, a) -> DataFrame:
    return x.select("i", F.zip_with("x", _numbers(a), lambda p, q: p * q).alias("x"))


def mv_axpy(x: DataFrame, a, y: DataFrame) -> DataFrame:
    """X_k + a_k Y_k."""
    both = x.join(y.withColumnRenamed("x", "y"), "i")
    return both.select("i", F.zip_with("x", F.zip_with("y", _numbers(a), lambda p, q: p * q), lambda p, q: p + q).alias("x"))


def small_mult(x: DataFrame, a) -> DataFrame:
    """X A for a small dense A (rows of Python numbers), a projection."""
    return x.select("i", F.array(*[contract(F.col("x"), _numbers([row[c] for row in a])) for c in range(len(a[0]))]).alias("x"))


# Trajectories.


def td_axpy(x: DataFrame, alpha: float, y: DataFrame) -> DataFrame:
    rows = x.select("k", "i", "v").unionByName(y.select("k", "i", (F.lit(float(alpha)) * F.col("v")).alias("v")))
    return rows.groupBy("k", "i").agg(F.sum("v").alias("v"))


def td_inner_by_level(x: DataFrame, y: DataFrame) -> DataFrame:
    both = x.select("k", "i", "v").join(y.select("k", "i", F.col("v").alias("w")), ["k", "i"])
    return both.groupBy("k").agg(F.sum(F.col("v") * F.col("w")).alias("inner"))


def td_inner(x: DataFrame, y: DataFrame) -> DataFrame:
    return td_inner_by_level(x, y).agg(F.coalesce(F.sum("inner"), F.lit(0.0)).alias("inner"))


def td_norm(x: DataFrame, time_norm: str = "linf", space_norm: str = "l2") -> DataFrame:
    """A space norm per level, then a norm of those over time."""
    of = {"l1": lambda c: F.sum(F.abs(c)), "l2": lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))), "linf": lambda c: F.max(F.abs(c))}
    return x.groupBy("k").agg(of[space_norm]("v").alias("n")).agg(of[time_norm]("n").alias("norm"))


def td_index(levels: DataFrame, times: DataFrame, tol: float) -> DataFrame:
    """(t, k): the level within tol that is nearest to each requested time (of equals the first). A bucketed range join.

    levels: (k, t), times: (t). A time without a level has no row.
    """
    cell = lambda c: F.floor(c / tol).cast("bigint")
    wanted = times.select("t").withColumn("cell", F.explode(F.array(*[cell(F.col("t")) + d for d in (-1, 0, 1)])))
    near = wanted.join(levels.select("k", F.col("t").alias("at")).withColumn("cell", cell(F.col("at"))), "cell").withColumn("gap", F.abs(F.col("at") - F.col("t"))).filter(F.col("gap") <= tol)
    return near.groupBy("t").agg(F.min(F.struct("gap", "k")).alias("m")).select("t", F.col("m.k").alias("k"))


def td_level(x: DataFrame, k: int) -> DataFrame:
    return x.filter(F.col("k") == k).select("i", "v")


def td_store(x: DataFrame, k: int, t: float, v: DataFrame) -> DataFrame:
    """x with level k replaced by v."""
    return x.filter(F.col("k") != k).unionByName(v.select(F.lit(k).alias("k"), F.lit(float(t)).alias("t"), "i", "v"))


def previous_level(x: DataFrame) -> DataFrame:
    """Each entry beside that of the level before it (null at the first)."""
    return x.withColumn("before", F.lag("v").over(Window.partitionBy("i").orderBy("k")))
