"""Chain diagnostics, finite-difference slopes and uncertainty summaries, as aggregates and windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a chain that one group takes at least.
BLOCK = 4096


def lag_limit(n: Column, max_lag: int | None = None) -> Column:
    """The largest lag of a chain of n: max_lag, or a tenth of the chain and 10 at least, below n."""
    return F.greatest(F.lit(0), F.least(n - 1, F.greatest(F.lit(10), F.floor(n / 10))) if max_lag is None else F.lit(max_lag)).cast("bigint")


def autocorrelation(chain: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(key, lag, rho) of chain (key, k, q), k = 0, 1, ... per key: normalised by n, not n - lag; 0 for a constant chain and
    from lag n on. Without max_lag, each chain has lags up to lag_limit().

    Chains are cut into blocks of at least as many rows as there are lags; a block gets the rows after it too, so each row
    moves twice and a long chain is spread over tasks. Blocks give their sums for all lags.
    """
    stats = chain.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean")).withColumn("lags", lag_limit(F.col("n"), max_lag))
    x = chain.join(stats, "key").withColumn("size", F.greatest(F.lit(BLOCK).cast("bigint"), F.col("lags")))
    block = F.floor(F.col("k") / F.col("size"))
    both = F.when((F.col("k") % F.col("size") < F.col("lags")) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = x.select("key", F.explode(both).alias("block"), "k", "lags", "size", (F.col("q") - F.col("mean")).alias("d"))
    kind = chain.select("key").schema[0].dataType

    def sums(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        k, d, lags = t["k"].to_numpy(), t["d"].to_numpy(), t["lags"][0].as_py()
        own = int(np.searchsorted(k, (t["block"][0].as_py() + 1) * t["size"][0].as_py()))
        out = [float(d[: min(own, len(d) - lag)] @ d[lag : lag + min(own, len(d) - lag)]) if lag < len(d) else 0.0 for lag in range(lags + 1)]
        return pa.table({"key": pa.array([t["key"][0].as_py()] * (lags + 1), t.schema.field("key").type), "lag": pa.array(range(lags + 1), pa.int64()), "s": out})

    parts = rows.groupBy("key", "block").applyInArrow(sums, f"key {kind.simpleString()}, lag long, s double")
    c = parts.groupBy("key", "lag").agg(F.sum("s").alias("c"))
    zero = c.filter("lag = 0").select("key", F.col("c").alias("c0"))
    return c.join(zero, "key").select("key", "lag", F.when(F.col("c0") > 0, F.col("c") / F.col("c0")).otherwise(0.0).alias("rho"))


def iact(rho: DataFrame) -> DataFrame:
    """(key, iact): 1 + 2 sum of rho up to the first negative one."""
    seen = Window.partitionBy("key").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    kept = rho.withColumn("ok", F.min((F.col("rho") >= 0).cast("int")).over(seen))
    return kept.groupBy("key").agg((1 + 2 * F.sum(F.when((F.col("ok") == 1) & (F.col("lag") > 0), F.col("rho")).otherwise(0.0))).alias("iact"))


def chain_summary(chain: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(key, n, mean, std, iact, ess, mcse); std and mcse of a chain of one sample are null."""
    stats = chain.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean"), F.stddev_samp("q").alias("std"))
    out = stats.join(iact(autocorrelation(chain, max_lag)), "key").withColumn("ess", F.col("n") / F.col("iact"))
    return out.withColumn("mcse", F.col("std") / F.sqrt("ess"))


def importance_weights(samples: DataFrame) -> DataFrame:
    """(key, logw) -> with the normalised weight, relative to the key's largest log weight."""
    top = samples.groupBy("key").agg(F.max("logw").alias("top"))
    w = samples.join(top, "key").withColumn("w", F.exp(F.col("logw") - F.col("top")))
    return w.join(w.groupBy("key").agg(F.sum("w").alias("all")), "key").withColumn("weight", F.col("w") / F.col("all")).drop("w", "all", "top")


def fd_slopes(table: DataFrame) -> DataFrame:
    """(key, eps, err) -> with slope ln(err_i/err_i+1)/ln(eps_i/eps_i+1), NaN beside a zero error, null at the last."""
    w = Window.partitionBy("key").orderBy(F.desc("eps"))
    err, eps = F.lead("err").over(w), F.lead("eps").over(w)
    ok = (F.col("err") > 0) & (err > 0)
    return table.withColumn("slope", F.when(eps.isNull(), None).when(ok, F.ln(F.col("err") / err) / F.ln(F.col("eps") / eps)).otherwise(float("nan")))


def best_slope(slopes: DataFrame, lo: float = 1e-7, hi: float = 1e-2) -> DataFrame:
    """(key, slope): median over lo <= eps <= hi, over all steps if fewer than 3 are there."""
    known = slopes.filter(F.col("slope").isNotNull())
    near = F.when(F.col("eps").between(lo, hi), F.col("slope"))
    return known.groupBy("key").agg(F.when(F.count(near) >= 3, F.percentile(near, 0.5)).otherwise(F.percentile("slope", 0.5)).alias("slope"))


def control_variate(samples: DataFrame) -> DataFrame:
    """samples (key, q, t) -> mean of q, mean of q - t, their standard errors and the variance reduction (infinite if t is q)."""
    d = F.col("q") - F.col("t")
    root = F.sqrt(F.count(F.lit(1)))
    return samples.groupBy("key").agg(
        F.avg("q").alias("mean_q"), (F.stddev_samp("q") / root).alias("err_q"), F.avg(d).alias("mean_d"), (F.stddev_samp(d) / root).alias("err_d"),
        F.when(F.stddev_samp(d) > 0, F.pow(F.stddev_samp("q") / F.stddev_samp(d), F.lit(2.0))).otherwise(F.lit(float("inf"))).alias("factor"),
    )


def kl_terms(spectrum: DataFrame) -> DataFrame:
    """(d) -> 1/2 sum log(1+d) - 1/2 sum d/(1+d)."""
    return spectrum.agg((0.5 * F.sum(F.log1p("d")) - 0.5 * F.sum(F.col("d") / (1 + F.col("d")))).alias("kl"))


def taylor_moments(spectrum: DataFrame) -> DataFrame:
    """(d) -> the spectrum's part of the second-order mean and variance: 1/2 sum d, 1/2 sum d^2."""
    return spectrum.agg((0.5 * F.sum("d")).alias("mean_part"), (0.5 * F.sum(F.col("d") * F.col("d"))).alias("variance_part"))
