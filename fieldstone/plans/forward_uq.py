"""Forward propagation of uncertainty: quantities of interest, their Taylor models, control variates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fieldstone.functions.jet import ElementKernel
from fieldstone.functions.philox import Random
from fieldstone.operators import randomized as rz
from fieldstone.plans.inverse import Model, Prior, Problem
from fieldstone.plans.spaces import Space, mass, scatter


@dataclass
class LinearQoi:
    """l^T u; also a misfit to Model, so that its derivatives come by the same adjoints."""

    ell: np.ndarray

    def cost(self, u, m) -> float:
        return float(self.ell @ u)

    def grad_state(self, u, m) -> np.ndarray:
        return self.ell

    def hess_state(self, u, du) -> np.ndarray:
        return np.zeros_like(du)


@dataclass
class QuadraticQoi:
    """1/2 u^T W u."""

    w: np.ndarray

    def cost(self, u, m) -> float:
        return 0.5 * float(u @ self.w @ u)

    def grad_state(self, u, m) -> np.ndarray:
        return self.w @ u

    def hess_state(self, u, du) -> np.ndarray:
        return self.w @ du


class DensityQoi:
    """The integral of a density q(u, x), differentiated by jets."""

    def __init__(self, space: Space, density: Callable, degree: int | None = None):
        self.space, self.kernel = space, ElementKernel(density, (space.order,), degree)

    def cost(self, u, m) -> float:
        return float(self.kernel.values(self.space.mesh.corners, [u[self.space.dofs]]).sum())

    def grad_state(self, u, m) -> np.ndarray:
        out = np.zeros(self.space.dim)
        np.add.at(out, self.space.dofs, self.kernel.vector(0, self.space.mesh.corners, [u[self.space.dofs]]))
        return out

    def hess_state(self, u, du) -> np.ndarray:
        k = self.kernel.matrices([(0, 0)], self.space.mesh.corners, [u[self.space.dofs]])[0, 0]
        return scatter((self.space.dim,) * 2, self.space.dofs, self.space.dofs, k) @ du


class NullQoi(LinearQoi):
    def __init__(self, space: Space):
        super().__init__(np.zeros(space.dim))


def l2_norm_qoi(space: Space) -> QuadraticQoi:
    return QuadraticQoi(mass(space))


def weighted_mean_qoi(space: Space, w: np.ndarray) -> LinearQoi:
    """(w^T M u) / (w^T M 1)."""
    mw = mass(space) @ w
    return LinearQoi(mw / mw.sum())


def mean_state_qoi(space: Space) -> LinearQoi:
    return weighted_mean_qoi(space, np.ones(space.dim))


class QoiMap(Model):
    """m -> q(u(m)), with gradient and Hessian by adjoints and without a prior."""

    def __init__(self, problem: Problem, qoi, prior: Prior):
        super().__init__(problem, prior, qoi)

    def value(self, m: np.ndarray) -> float:
        return self.misfit.cost(self.forward(m), m)

    def value_gradient(self, m: np.ndarray) -> tuple[float, np.ndarray]:
        u = self.forward(m)
        return self.misfit.cost(u, m), self.gradient(u, m, self.adjoint(u, m), misfit_only=True)[0]

    def verify(self, m: np.ndarray, direction: np.ndarray, eps: list[float]) -> list[tuple[float, float]]:
        """(eps, error of the gradient's finite difference)."""
        q, g = self.value_gradient(m)
        return [(e, abs((self.value(m + e * direction) - q) / e - float(g @ direction))) for e in eps]


class TaylorModel:
    """First- and second-order Taylor model of a quantity around the mean of a Gaussian."""

    def __init__(self, qmap: QoiMap, k: int, rng: Random, oversampling: int = 10, s: int = 1):
        prior = self.prior = qmap.prior
        self.mean = prior.mean
        u = qmap.forward(self.mean)
        p = qmap.adjoint(u, self.mean)
        self.q, self.g = qmap.misfit.cost(u, self.mean), qmap.gradient(u, self.mean, p, misfit_only=True)[0]
        act = qmap.hessian_block(u, self.mean, p, misfit_only=True)
        self.act = act
        n = len(self.mean)
        columns = min(n, k + oversampling)
        self.d, self.u = rz.double_pass_g(act, lambda x: prior.r @ x, lambda x: prior.cov @ x, rng.normal_block(n, columns), min(k, columns), s)

    def expected(self, order: int = 2) -> float:
        return self.q + (0.5 * float(self.d.sum()) if order == 2 else 0.0)

    def variance(self, order: int = 2) -> float:
        return float(self.g @ self.prior.solve(self.g)) + (0.5 * float((self.d**2).sum()) if order == 2 else 0.0)

    def value(self, m: np.ndarray, order: int = 2) -> float:
        e = m - self.mean
        return self.q + float(self.g @ e) + (0.5 * float(e @ self.act(e[:, None])[:, 0]) if order == 2 else 0.0)

    def value_low_rank(self, m: np.ndarray, order: int = 2) -> float:
        """With the low-rank Hessian, whose mean is known: the one to use as a control variate."""
        e = m - self.mean
        return self.q + float(self.g @ e) + (0.5 * float(self.d @ (self.u.T @ (self.prior.r @ e)) ** 2) if order == 2 else 0.0)


def variance_reduction(qmap: QoiMap, taylor: TaylorModel, samples: int, rng: Random, order: int = 2) -> dict[str, float]:
    """Monte Carlo with and without the Taylor model as a control variate."""
    draws = [qmap.prior.sample(rng.normal(len(taylor.mean))) for _ in range(samples)]
    return summarize(np.array([qmap.value(m) for m in draws]), np.array([taylor.value_low_rank(m, order) for m in draws]), taylor.expected(order))


def summarize(q: np.ndarray, t: np.ndarray, expected: float) -> dict[str, float]:
    d, n = q - t, len(q)
    sd_q, sd_d = float(q.std(ddof=1)), float(d.std(ddof=1))
    return {"mc": float(q.mean()), "mc_err": sd_q / math.sqrt(n), "cv": float(d.mean()) + expected, "cv_err": sd_d / math.sqrt(n), "factor": (sd_q / sd_d) ** 2 if sd_d else math.inf}


def sample_frame(spark: SparkSession, make: Callable[[], Callable[[np.ndarray], tuple[float, float]]], dim: int, samples: int, parts: int = 8, seed: int = 1) -> DataFrame:
    """(k, q, t) of independent draws over tasks: make() builds, in each, a function of white noise that gives both values.

    operators.diagnostics.control_variate summarises it.
    """

    def run(batches):
        f = make()
        for b in batches:
            rows = [(k, *f(noise_of(seed, k, dim))) for k in b["id"]]
            yield pd.DataFrame(rows, columns=["k", "q", "t"])

    return spark.range(0, samples, 1, parts).mapInPandas(run, "k long, q double, t double")


def noise_of(seed: int, k: int, dim: int) -> np.ndarray:
    """White noise of sample k: a block of the stream of its own."""
    rng = Random(seed)
    rng.seek(k * dim)
    return rng.normal(dim)
