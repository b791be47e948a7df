"""Markov chains: kernels, chains as partitions, importance sampling.

A chain is sequential, so chains are the unit of parallel work: each is one group of applyInPandas, runs the whole
problem inside its task with its own counter-based stream, and a task that is run again gives the same samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fieldstone.functions.philox import Random
from fieldstone.plans.inverse import Model, Posterior


@dataclass
class Sample:
    m: np.ndarray
    u: np.ndarray
    cost: float = 0.0
    p: np.ndarray | None = None
    g: np.ndarray | None = None
    cg: np.ndarray | None = None
    log_weight: float = 0.0


def _log_uniform(rng: Random) -> float:
    return math.log(max(rng.scalar_uniform(), 1e-300))


class PCN:
    """m' = mean + sqrt(1 - s^2) (m - mean) + s w with prior noise w; the misfit decides."""

    def __init__(self, model: Model, s: float = 0.1):
        self.model, self.s = model, s

    def start(self, m: np.ndarray) -> Sample:
        u = self.model.forward(m)
        return Sample(m, u, self.model.misfit.cost(u, m))

    def propose(self, now: Sample, rng: Random) -> Sample:
        mean = self.model.prior.mean
        w = self.model.prior.sample(rng.normal(len(mean)), False)
        return self.start(mean + math.sqrt(1 - self.s**2) * (now.m - mean) + self.s * w)

    def log_ratio(self, now: Sample, ahead: Sample) -> float:
        return now.cost - ahead.cost

    def step(self, now: Sample, rng: Random) -> tuple[Sample, bool]:
        ahead = self.propose(now, rng)
        return (ahead, True) if self.log_ratio(now, ahead) > _log_uniform(rng) else (now, False)


class GPCN(PCN):
    """The same around a Laplace posterior nu: the ratio uses the misfit plus prior less nu's cost."""

    def __init__(self, model: Model, nu: Posterior, s: float = 0.1):
        super().__init__(model, s)
        self.nu = nu

    def start(self, m: np.ndarray) -> Sample:
        u = self.model.forward(m)
        return Sample(m, u, self.model.cost(u, m)[0] - self.nu.cost(m))

    def propose(self, now: Sample, rng: Random) -> Sample:
        w = self.nu.sample(rng.normal(len(now.m)), False)
        return self.start(self.nu.mean + math.sqrt(1 - self.s**2) * (now.m - self.nu.mean) + self.s * w)


class MALA(PCN):
    """Langevin steps preconditioned by the prior covariance, with the exact acceptance ratio."""

    def __init__(self, model: Model, delta: float = 0.25):
        super().__init__(model)
        self.delta = delta

    def start(self, m: np.ndarray) -> Sample:
        u = self.model.forward(m)
        p = self.model.adjoint(u, m)
        g = self.model.gradient(u, m, p, misfit_only=True)[0]
        return Sample(m, u, self.model.cost(u, m)[0], p, g, self.model.prior.solve(g))

    def _mean(self, x: Sample) -> np.ndarray:
        drift = x.cg + x.m - self.model.prior.mean
        return x.m - self.delta * drift

    def propose(self, now: Sample, rng: Random) -> Sample:
        return self.start(self._mean(now) + math.sqrt(2 * self.delta) * self.model.prior.sample(rng.normal(len(now.m)), False))

    def _log_q(self, a: Sample, b: Sample) -> float:
        d = b.m - self._mean(a)
        return -float(d @ self.model.prior.r @ d) / (4 * self.delta)

    def log_ratio(self, now: Sample, ahead: Sample) -> float:
        return now.cost - ahead.cost + self._log_q(ahead, now) - self._log_q(now, ahead)


class Importance(GPCN):
    """Independent draws of nu, each with the log weight that makes them posterior draws."""

    def step(self, now: Sample, rng: Random) -> tuple[Sample, bool]:
        ahead = self.start(self.nu.sample(rng.normal(len(now.m))))
        ahead.log_weight = -ahead.cost
        return ahead, True


class FullTracer:
    """Keeps the parameter and the state of every recorded step."""

    def __init__(self):
        self.m: list[np.ndarray] = []
        self.u: list[np.ndarray] = []

    def __call__(self, now: Sample) -> None:
        self.m.append(now.m)
        self.u.append(now.u)


def consume_random(kernel, rng: Random, dim: int, steps: int) -> None:
    """Advance a stream as a chain of so many steps would: a draw of the noise and, but for independent draws, a uniform number each."""
    rng.advance(steps * (dim + (0 if isinstance(kernel, Importance) else 1)))


def run_chain(kernel, m0: np.ndarray, qoi: Callable[[np.ndarray, np.ndarray], float], rng: Random, samples: int = 2000, burn_in: int = 1000, tracer: Callable[[Sample], None] | None = None) -> pd.DataFrame:
    """(k, q, accepted, logw) of one chain; a rejected proposal records the state again. tracer is called with each."""
    now = kernel.start(m0)
    rows = []
    for k in range(-burn_in, samples):
        now, accepted = kernel.step(now, rng)
        if k >= 0:
            rows.append((k, float(qoi(now.u, now.m)), accepted, now.log_weight))
            if tracer is not None:
                tracer(now)
    return pd.DataFrame(rows, columns=["k", "q", "accepted", "logw"])


def run_chains(spark: SparkSession, make: Callable[[], tuple], chains: int, samples: int = 2000, burn_in: int = 1000, seed: int = 1) -> DataFrame:
    """(chain, k, q, accepted, logw) of independent chains. make() builds (kernel, m0, qoi) inside each task."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        chain = int(group["chain"].iloc[0])
        kernel, m0, qoi = make()
        return run_chain(kernel, m0, qoi, Random(seed * 1_000_003 + chain), samples, burn_in).assign(chain=chain)

    starts = spark.range(chains).withColumnRenamed("id", "chain").repartition(chains, "chain")
    return starts.groupBy("chain").applyInPandas(one, "k long, q double, accepted boolean, logw double, chain long").select("chain", "k", "q", "accepted", "logw")
