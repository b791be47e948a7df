"""Misfits of observed data (t, bu: model, d: data) and quantities of interest, as aggregates and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.functions.applied import ranked
from fieldstone.operators import matrix as mx
from fieldstone.operators import vector as vec


def _variance(noise_variance: float | None) -> float:
    if noise_variance is None:
        raise ValueError("the noise variance is not set")
    if noise_variance == 0:
        raise ZeroDivisionError("the noise variance is zero")
    return float(noise_variance)


def gauss_cost(obs: DataFrame, noise_variance: float | None) -> DataFrame:
    """|Bu - d|^2 / (2 s^2)."""
    r = F.col("bu") - F.col("d")
    return obs.agg((F.sum(r * r) / (2 * _variance(noise_variance))).alias("cost"))


def gauss_residual(obs: DataFrame, noise_variance: float | None) -> DataFrame:
    """(t, v): (Bu - d) / s^2; B^T of it is the gradient."""
    return obs.select("t", ((F.col("bu") - F.col("d")) / _variance(noise_variance)).alias("v"))


def weighted_cost(obs: DataFrame) -> DataFrame:
    """sum ((Bu - d) / sigma)^2 / 2 with a sigma per datum."""
    r = (F.col("bu") - F.col("d")) / F.col("sigma")
    return obs.agg((F.sum(r * r) / 2).alias("cost"))


def _positive() -> Column:
    return F.when(F.col("bu") > 0, F.col("bu")).otherwise(F.raise_error(F.lit("the observed state is not positive")).cast("double"))


def gamma_cost(obs: DataFrame, m: float) -> DataFrame:
    """M sum (log Bu + d/Bu); a state that is not positive raises."""
    return obs.agg((m * F.sum(F.ln(_positive()) + F.col("d") / F.col("bu"))).alias("cost"))


def gamma_residual(obs: DataFrame, m: float) -> DataFrame:
    """(t, v): M (1/Bu - d/Bu^2)."""
    bu = _positive()
    return obs.select("t", (m * (1 / bu - F.col("d") / (bu * bu))).alias("v"))


def gamma_hessian(obs: DataFrame, m: float) -> DataFrame:
    """obs with du, the observed direction -> (t, v): M (-1/Bu^2 + 2 d/Bu^3) B du."""
    bu = _positive()
    return obs.select("t", (m * (-1 / (bu * bu) + 2 * F.col("d") / (bu * bu * bu)) * F.col("du")).alias("v"))


def per_experiment(obs: DataFrame, noise_variance: float | None) -> DataFrame:
    """(experiment, cost): the parts of a sum over independent experiments or observation times."""
    r = F.col("bu") - F.col("d")
    return obs.groupBy("experiment").agg((F.sum(r * r) / (2 * _variance(noise_variance))).alias("cost"))


def observed_noise_level(bu: DataFrame, rel_noise: float) -> DataFrame:
    """sigma = rel_noise * max(|Bu|_inf, 1e-30)."""
    return bu.agg((F.lit(float(rel_noise)) * F.greatest(F.coalesce(F.max(F.abs("v")), F.lit(0.0)), F.lit(1e-30))).alias("sigma"))


def quadratic_qoi(wu: DataFrame, u: DataFrame) -> DataFrame:
    """1/2 u^T W u from W u."""
    return wu.join(u.withColumnRenamed("v", "u"), "i").agg((0.5 * F.sum(F.col("v") * F.col("u"))).alias("q"))


def weighted_mean_qoi(weights: DataFrame, u: DataFrame) -> DataFrame:
    """(w^T u) / (w^T 1)."""
    return weights.withColumnRenamed("v", "w").join(u, "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("q"))


def weighted_l2_cost(w: DataFrame, u: DataFrame, d: DataFrame, noise_variance: float | None) -> DataFrame:
    """(u - d)^T W (u - d) / (2 s^2): W a mass matrix of the domain, of part of it or of a boundary."""
    r = vec.axpy(u, -1.0, d)
    return vec.inner(mx.spmv(w, r), r).select((F.col("inner") / (2 * _variance(noise_variance))).alias("cost"))


def per_level(x: DataFrame, data: DataFrame, noise_variance: float | None) -> DataFrame:
    """(k, cost) of a trajectory (k, i, v) at the levels that have data (k, i, d); the others are not observed."""
    r = F.col("v") - F.col("d")
    return x.join(data, ["k", "i"]).groupBy("k").agg((F.sum(r * r) / (2 * _variance(noise_variance))).alias("cost"))


def line_of_sight(b: DataFrame, directions: DataFrame, components: int) -> DataFrame:
    """Rows of a point-evaluation operator for the component of a vector field along each point's direction (i, w).

    Dofs of the field are components * j + c.
    """
    rows = b.join(directions, "i").select("i", "j", "v", F.posexplode("w").alias("c", "w"))
    return rows.select("i", (components * F.col("j") + F.col("c")).alias("j"), (F.col("v") * F.col("w")).alias("v"))


def gather_observations(obs: DataFrame, target: str) -> DataFrame:
    """(i, v): values (target, v) in target order, numbered from 0; no value goes to the driver."""
    return ranked(obs.select(target, "v"), [target], "i").select("i", "v")


def scatter_observations(values: DataFrame | Sequence[float], targets: DataFrame) -> DataFrame:
    """(target, v): values in target order, numbered (i, v) or an array, on the targets of a frame with one column."""
    (name,) = targets.columns
    return ranked(targets, [name], "i").join(vec.as_vector(targets.sparkSession, values), "i").select(name, "v")
