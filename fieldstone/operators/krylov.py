"""Iterative solvers over any vectors that have +, - and scalar *, with one inner product: arrays or frames.

`Vec` wraps a frame (i, v); a NumPy array is its own vector. An operator is a function. Scalars live on the driver, and
all inner products of a step that can be taken together are one job. Vec cuts its lineage by a checkpoint every few
operations, so that plans stay short and a lost executor costs little.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldstone.operators import matrix as mx
from fieldstone.operators import vector as vec
from fieldstone.shared import written


class Vec:
    """A frame vector with arithmetic. `age` counts the operations since its lineage was cut."""

    CUT = 6

    def __init__(self, df: DataFrame, age: int = 0):
        if age >= self.CUT:
            df, age = written(df, "vec"), 0
        self.df, self.age = df, age

    def __add__(self, y: Vec) -> Vec:
        return Vec(vec.axpby(1.0, self.df, 1.0, y.df), max(self.age, y.age) + 1)

    def __sub__(self, y: Vec) -> Vec:
        return Vec(vec.axpby(1.0, self.df, -1.0, y.df), max(self.age, y.age) + 1)

    def __mul__(self, a: float) -> Vec:
        return Vec(vec.scale(self.df, a), self.age)

    __rmul__ = __mul__

    def inner(self, y: Vec) -> float:
        return vec.inner(self.df, y.df).first()[0]

    def to_numpy(self, n: int) -> np.ndarray:
        return vec.gather(self.df, n)


def dot(x, y) -> float:
    return x.inner(y) if isinstance(x, Vec) else float(x @ y)


def norm(x) -> float:
    return math.sqrt(max(dot(x, x), 0.0))


def frame_operator(a: DataFrame) -> Callable[[Vec], Vec]:
    """A sparse matrix frame as an operator on Vec."""
    return lambda x: Vec(mx.spmv(a, x.df), x.age + 1)


def jacobi(a: DataFrame) -> Callable[[Vec], Vec]:
    d = written(mx.diagonal(a), "diagonal")
    return lambda r: Vec(vec.pointwise_divide(r.df, d), r.age + 1)


class NotConverged(RuntimeError):
    pass


@dataclass
class Solution:
    x: object
    iterations: int
    residual: float
    reason: str = "converged"


def cg(a, b, precond=lambda r: r, rel: float = 1e-12, absolute: float = 1e-20, max_iter: int = 1000) -> Solution:
    """Preconditioned conjugate gradients; raises if the residual is not reached."""
    x, r = b * 0.0, b
    tol = max(rel * norm(b), absolute)
    z = precond(r)
    p, rz, res = z, dot(r, z), norm(r)
    for k in range(max_iter):
        if res <= tol:
            return Solution(x, k, res)
        ap = a(p)
        alpha = rz / dot(p, ap)
        x, r = x + p * alpha, r - ap * alpha
        z = precond(r)
        fresh, res = dot(r, z), norm(r)
        p, rz = z + p * (fresh / rz), fresh
    if res <= tol:
        return Solution(x, max_iter, res)
    raise NotConverged(f"residual {res:g} after {max_iter} iterations")


def refined(a, solve, b, rel: float = 1e-12, most: int = 10) -> Solution:
    """Iterative refinement of an inexact solver against the true residual; raises if it stops helping short of `rel`."""
    x, r, size = solve(b), None, math.inf
    tol = rel * norm(b)
    for k in range(most + 1):
        r = b - a(x)
        if (now := norm(r)) <= tol:
            return Solution(x, k, now)
        if now > 0.5 * size:
            break
        x, size = x + solve(r), now
    raise NotConverged(f"residual {norm(r):g} after refinement")


def bicgstab(a, b, precond=lambda r: r, rel: float = 1e-12, absolute: float = 1e-20, max_iter: int = 1000) -> Solution:
    x, r = b * 0.0, b
    tol, shadow = max(rel * norm(b), absolute), b
    rho, p = dot(shadow, r), r
    for k in range(max_iter):
        if (res := norm(r)) <= tol:
            return Solution(x, k, res)
        ph = precond(p)
        v = a(ph)
        alpha = rho / dot(shadow, v)
        s = r - v * alpha
        if norm(s) <= tol:
            return Solution(x + ph * alpha, k + 1, norm(s))
        sh = precond(s)
        t = a(sh)
        omega = dot(t, s) / dot(t, t)
        x, r = x + ph * alpha + sh * omega, s - t * omega
        fresh = dot(shadow, r)
        p, rho = r + (p - v * omega) * (fresh / rho * alpha / omega), fresh
    raise NotConverged(f"residual {norm(r):g} after {max_iter} iterations")


def gmres(a, b, precond=lambda r: r, restart: int = 50, rel: float = 1e-12, absolute: float = 1e-20, max_iter: int = 1000) -> Solution:
    """Right-preconditioned restarted GMRES: the residual it tests is the true one."""
    x, total = b * 0.0, 0
    tol = max(rel * norm(b), absolute)
    while True:
        r = b - a(x)
        beta = norm(r)
        if beta <= tol:
            return Solution(x, total, beta)
        if total >= max_iter:
            raise NotConverged(f"residual {beta:g} after {total} iterations")
        basis, z, h = [r * (1 / beta)], [], np.zeros((restart + 1, restart))
        for k in range(restart):
            z.append(precond(basis[k]))
            w = a(z[k])
            for _ in range(2):  # orthogonalised twice
                for i in range(k + 1):
                    c = dot(basis[i], w)
                    h[i, k] += c
                    w = w - basis[i] * c
            h[k + 1, k] = norm(w)
            total += 1
            e = np.zeros(k + 2)
            e[0] = beta
            y = np.linalg.lstsq(h[: k + 2, : k + 1], e, rcond=None)[0]
            if np.linalg.norm(h[: k + 2, : k + 1] @ y - e) <= 0.5 * tol or h[k + 1, k] <= 1e-14 * beta:
                break
            basis.append(w * (1 / h[k + 1, k]))
        for c, v in zip(y, z, strict=True):
            x = x + v * float(c)


def minres(a, b, rel: float = 1e-12, absolute: float = 1e-20, max_iter: int = 1000) -> Solution:
    """Minimal residuals of a symmetric, possibly indefinite operator, by Lanczos with a least-squares step."""
    x, beta = b * 0.0, norm(b)
    tol = max(rel * beta, absolute)
    if beta <= tol:
        return Solution(x, 0, beta)
    old, v, w1, w2 = b * 0.0, b * (1 / beta), b * 0.0, b * 0.0
    c1 = c2 = 1.0
    s1 = s2 = below = 0.0
    eta = beta
    for k in range(max_iter):
        p = a(v) - old * below
        alpha = dot(v, p)
        p = p - v * alpha
        after = norm(p)
        r1, r2, r3 = c1 * alpha - c2 * s1 * below, s1 * alpha + c2 * c1 * below, s2 * below
        rr = math.hypot(r1, after)
        c, s = r1 / rr, after / rr
        w = (v - w2 * r3 - w1 * r2) * (1 / rr)
        x = x + w * (c * eta)
        eta = -s * eta
        if abs(eta) <= tol or after == 0:
            return Solution(x, k + 1, abs(eta))
        old, v, w2, w1 = v, p * (1 / after), w1, w
        c2, c1, s2, s1, below = c1, c, s1, s, after
    raise NotConverged(f"residual {abs(eta):g} after {max_iter} iterations")


def lanczos(a, start, k: int) -> tuple[list, np.ndarray]:
    """Basis and tridiagonal matrix of k steps, orthogonalised in full."""
    basis, t = [start * (1 / norm(start))], np.zeros((k, k))
    for i in range(k):
        w = a(basis[i])
        t[i, i] = dot(basis[i], w)
        for _ in range(2):
            for q in basis:
                w = w - q * dot(q, w)
        beta = norm(w)
        if i + 1 == k or beta < 1e-13 * max(abs(t[i, i]), 1e-300):
            return basis, t[: i + 1, : i + 1]
        t[i, i + 1] = t[i + 1, i] = beta
        basis.append(w * (1 / beta))
    return basis, t


def lanczos_function(a, z, f: Callable[[np.ndarray], np.ndarray], k: int):
    """f(A) z of a symmetric operator, e.g. its square root."""
    basis, t = lanczos(a, z, k)
    d, q = np.linalg.eigh(t)
    y = norm(z) * (q @ (f(d) * q[0]))
    out = z * 0.0
    for c, v in zip(y, basis, strict=True):
        out = out + v * float(c)
    return out


def chebyshev(a, b, lo: float, hi: float, degree: int, precond=lambda r: r):
    """Fixed-degree Chebyshev iteration on [lo, hi]: no inner products and no test, so on frames it is one lazy plan."""
    theta, delta = (hi + lo) / 2, (hi - lo) / 2
    sigma = theta / delta
    rho, r = 1 / sigma, b
    d = precond(r) * (1 / theta)
    x = d
    for _ in range(degree - 1):
        r = r - a(d)
        fresh = 1 / (2 * sigma - rho)
        d = d * (fresh * rho) + precond(r) * (2 * fresh / delta)
        x, rho = x + d, fresh
    return x


def chebyshev_bound(lo: float, hi: float, degree: int) -> float:
    """Bound of the relative error in the operator's norm."""
    return 1 / math.cosh(degree * math.acosh((hi + lo) / (hi - lo)))


def steihaug(a, b, precond=lambda r: r, rel: float = 1e-9, absolute: float = 1e-12, max_iter: int = 1000, radius: float | None = None, b_op=lambda x: x) -> Solution:
    """CG for a quadratic model, cut at negative curvature or at the ball x^T B x <= radius^2.

    Reasons: "converged", "max_iter", "negative", "boundary". Without a ball, negative curvature gives the whole first
    direction at the first iteration and the iterate so far later; with one, the step to the sphere along the
    direction that lowers the model.
    """
    x, r = b * 0.0, b
    z = precond(r)
    p, rz = z, dot(r, z)
    tol = max(rel * rel * rz, absolute * absolute)

    def to_sphere(x, p) -> tuple[float, float]:
        bp = b_op(p)
        aa, bb, cc = dot(p, bp), 2 * dot(x, bp), dot(x, b_op(x)) - radius**2
        root = math.sqrt(max(bb * bb - 4 * aa * cc, 0.0))
        return (-bb + root) / (2 * aa), (-bb - root) / (2 * aa)

    def model(x) -> float:
        return 0.5 * dot(x, a(x)) - dot(b, x)

    for k in range(max_iter):
        if rz < tol or rz == 0:
            return Solution(x, k, math.sqrt(max(rz, 0.0)))
        ap = a(p)
        curvature = dot(p, ap)
        if curvature <= 0:
            if radius is None:
                return Solution(p if k == 0 else x, k + 1, math.sqrt(rz), "negative")
            return Solution(min((x + p * t for t in to_sphere(x, p)), key=model), k + 1, math.sqrt(rz), "negative")
        alpha = rz / curvature
        ahead = x + p * alpha
        if radius is not None and dot(ahead, b_op(ahead)) >= radius**2:
            return Solution(x + p * to_sphere(x, p)[0], k + 1, math.sqrt(rz), "boundary")
        x, r = ahead, r - ap * alpha
        z = precond(r)
        fresh = dot(r, z)
        p, rz = z + p * (fresh / rz), fresh
    return Solution(x, max_iter, math.sqrt(max(rz, 0.0)), "max_iter")


def cg_sample(a, b, normals, rel: float = 1e-9, max_iter: int = 1000):
    """A draw of N(0, A^-1) on the Krylov space of b: sum of z / sqrt(p'Ap) p over CG's directions."""
    s, r, p, draws = b * 0.0, b, b, iter(normals)
    rr = dot(r, r)
    stop = rel * rel * rr
    for _ in range(max_iter):
        ap = a(p)
        curvature = dot(p, ap)
        if curvature <= 0 or rr <= stop:
            break
        z = next(draws, None)
        if z is None:
            raise ValueError("too few normal numbers")
        s = s + p * (float(z) / math.sqrt(curvature))
        r = r - ap * (rr / curvature)
        fresh = dot(r, r)
        p, rr = r + p * (fresh / rr), fresh
    return s


def frame_cg(a: DataFrame, b: DataFrame, rel: float = 1e-8, max_iter: int = 1000) -> Solution:
    """Conjugate gradients with Jacobi on frames, one job per iteration.

    All vectors are columns of one frame. The job that writes A p beside them observes every sum from which the next
    step's scalars follow, so no job is spent on an inner product.
    """
    a = written(a, "matrix")
    d = mx.diagonal(a).withColumnRenamed("v", "d")
    state = written(b.join(d, "i").select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), (F.col("v") / F.col("d")).alias("p"), "d"), "cg")
    first = state.agg(F.sum(F.col("r") * F.col("p")), F.sum(F.col("r") * F.col("r"))).first()
    rz, rr = first[0] or 0.0, first[1] or 0.0
    start = rr
    for k in range(max_iter):
        if rr <= rel * rel * start or rz <= 0:
            return Solution(state.select("i", F.col("x").alias("v")), k, math.sqrt(max(rr, 0.0)))
        product = mx.spmv(a, state.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "ap")
        seen = Observation()
        p, r, ap = F.col("p"), F.col("r"), F.col("ap")
        sums = {"pap": p * ap, "rad": r * ap / F.col("d"), "aad": ap * ap / F.col("d"), "ra": r * ap, "aa": ap * ap}
        both = written(state.join(product, "i").observe(seen, *[F.sum(c).alias(n) for n, c in sums.items()]), "cg")
        m = seen.get
        alpha = rz / m["pap"]
        ahead = rz - 2 * alpha * m["rad"] + alpha**2 * m["aad"]
        rr = rr - 2 * alpha * m["ra"] + alpha**2 * m["aa"]
        fresh = r - F.lit(alpha) * ap
        state = both.select("i", (F.col("x") + F.lit(alpha) * p).alias("x"), fresh.alias("r"), (fresh / F.col("d") + F.lit(ahead / rz) * p).alias("p"), "d")
        rz = ahead
    raise NotConverged(f"residual {math.sqrt(max(rr, 0.0)):g} after {max_iter} iterations")


def frame_chebyshev(a: DataFrame, b: DataFrame, lo: float, hi: float, degree: int) -> DataFrame:
    """chebyshev() with all vectors as columns of one frame: a step is one product and one join."""
    theta, delta = (hi + lo) / 2, (hi - lo) / 2
    sigma, rho = theta / delta, delta / theta
    first = F.col("v") / F.lit(theta)
    state = b.select("i", F.col("v").alias("r"), first.alias("d"), first.alias("x"))
    for k in range(degree - 1):
        fresh = 1 / (2 * sigma - rho)
        product = mx.spmv(a, state.select("i", F.col("d").alias("v"))).withColumnRenamed("v", "ad")
        r = F.col("r") - F.coalesce("ad", F.lit(0.0))
        d = F.col("d") * F.lit(fresh * rho) + r * F.lit(2 * fresh / delta)
        state, rho = state.join(product, "i", "left").select("i", r.alias("r"), d.alias("d"), (F.col("x") + d).alias("x")), fresh
        if k % 3 == 2:
            state = written(state, "chebyshev")
    return state.select("i", F.col("x").alias("v"))


def frame_jacobi(a: DataFrame, b: DataFrame, weight: float, sweeps: int) -> DataFrame:
    """Damped Jacobi sweeps from D^-1 b: a sweep is one product and one join."""
    d = mx.diagonal(a).withColumnRenamed("v", "d")
    state = b.join(d, "i").select("i", F.col("v").alias("b"), "d", (F.col("v") / F.col("d")).alias("x"))
    for k in range(sweeps):
        product = mx.spmv(a, state.select("i", F.col("x").alias("v"))).withColumnRenamed("v", "ax")
        x = F.col("x") + F.lit(weight) * (F.col("b") - F.coalesce("ax", F.lit(0.0))) / F.col("d")
        state = state.join(product, "i", "left").select("i", "b", "d", x.alias("x"))
        if k % 3 == 2:
            state = written(state, "jacobi")
    return state.select("i", F.col("x").alias("v"))


def to_dense(a: DataFrame, n: int, limit: int = 5000) -> np.ndarray:
    """A frame matrix on the driver; refused above `limit` rows."""
    if n > limit:
        raise ValueError(f"{n} rows are more than {limit}")
    out = np.zeros((n, n))
    for r in a.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def auto_solve(a: DataFrame, b: DataFrame, n: int, limit: int = 2000) -> DataFrame:
    """Direct on the driver below `limit` unknowns, else conjugate gradients with Jacobi on frames."""
    if n > limit:
        return frame_cg(a, b).x
    x = np.linalg.solve(to_dense(a, n, limit), Vec(b).to_numpy(n))
    return b.sparkSession.createDataFrame(list(enumerate(x.tolist())), "i long, v double")


def two_level(a, smoother, restrict, prolong, coarse_solve, sweeps: int = 2):
    """A symmetric V-cycle as a preconditioner: smooth, correct on the coarse space, smooth."""

    def apply(r):
        x = r * 0.0
        for _ in range(sweeps):
            x = x + smoother(r - a(x))
        x = x + prolong(coarse_solve(restrict(r - a(x))))
        for _ in range(sweeps):
            x = x + smoother(r - a(x))
        return x

    return apply
