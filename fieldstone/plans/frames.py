"""A diffusion inverse problem on sparse frames: -div(exp(m) grad u) = f with essential values, observed at points.

State, parameter and adjoint are vectors (i, v) of linear functions on triangles; the coefficient is exp of the mean of m
on each element, so every second derivative is a grouped sum over elements. Solves are conjugate gradients on frames.
Nothing but scalars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.operators import krylov
from fieldstone.operators import matrix as mx
from fieldstone.operators import vector as vec
from fieldstone.shared import written
from fieldstone.sources import mesh


def _field(elements: DataFrame, u: DataFrame, name: str) -> DataFrame:
    """(e, {name}, {name}x, {name}y): mean and gradient of a linear function on each element; a missing entry is zero."""
    rows = elements.select("e", F.posexplode("v").alias("a", "i"), "gx", "gy").join(u, "i")
    value = F.col("v")
    return rows.groupBy("e").agg(
        (F.sum(value) / 3).alias(name), F.sum(value * F.col("gx")[F.col("a")]).alias(f"{name}x"), F.sum(value * F.col("gy")[F.col("a")]).alias(f"{name}y")
    )


class Diffusion:
    """elements: triangles of sources.mesh; ess: (i, value); load: (i, v)."""

    def __init__(self, elements: DataFrame, ess: DataFrame, load: DataFrame | None = None, rel: float = 1e-10):
        self.geometry = written(mesh.geometry(elements).select("e", "v", "area", "gx", "gy"), "geometry")
        self.ess, self.load, self.rel = written(ess, "essential"), load, rel

    def _with(self, **fields: DataFrame) -> DataFrame:
        out = self.geometry
        for name, u in fields.items():
            out = out.join(_field(self.geometry, u, name), "e", "left").fillna(0.0, [name, f"{name}x", f"{name}y"])
        return out

    @staticmethod
    def _g(a: str) -> tuple[Column, Column]:
        return F.col("gx")[F.col(a)], F.col("gy")[F.col(a)]

    def _pairs(self, rows: DataFrame, value: Column) -> DataFrame:
        first = rows.select("*", F.posexplode("v").alias("a", "i"))
        return mx.scatter_add(first.select("*", F.posexplode("v").alias("b", "j")).select("i", "j", value.alias("v")))

    def raw_stiffness(self, m: DataFrame) -> DataFrame:
        (ax, ay), (bx, by) = self._g("a"), self._g("b")
        return self._pairs(self._with(m=m), F.col("area") * F.exp("m") * (ax * bx + ay * by))

    def block_c(self, m: DataFrame, u: DataFrame) -> DataFrame:
        """d2R / dp dm: (i: adjoint, j: parameter)."""
        ax, ay = self._g("a")
        return self._pairs(self._with(m=m, u=u), F.col("area") * F.exp("m") / 3 * (F.col("ux") * ax + F.col("uy") * ay))

    def block_wmm(self, m: DataFrame, u: DataFrame, p: DataFrame) -> DataFrame:
        dots = F.col("ux") * F.col("px") + F.col("uy") * F.col("py")
        return self._pairs(self._with(m=m, u=u, p=p), F.col("area") * F.exp("m") / 9 * dots)

    def block_wum(self, m: DataFrame, p: DataFrame) -> DataFrame:
        """d2R / du dm, which is block_c() at p."""
        return self.block_c(m, p)

    def functional(self, m: DataFrame, u: DataFrame, p: DataFrame) -> DataFrame:
        """One row: R(u, m, p) without the load."""
        dots = F.col("ux") * F.col("px") + F.col("uy") * F.col("py")
        return self._with(m=m, u=u, p=p).agg(F.sum(F.col("area") * F.exp("m") * dots).alias("value"))

    def gradient_parameter(self, m: DataFrame, u: DataFrame, p: DataFrame) -> DataFrame:
        """(i, v): dR / dm, without a matrix."""
        dots = F.col("ux") * F.col("px") + F.col("uy") * F.col("py")
        rows = self._with(m=m, u=u, p=p).select(F.explode("v").alias("i"), (F.col("area") * F.exp("m") / 3 * dots).alias("v"))
        return mx.scatter_vector(rows)

    def matrix(self, m: DataFrame) -> DataFrame:
        """The stiffness matrix without essential rows and columns, whose diagonal is one."""
        return written(mx.eliminate(self.raw_stiffness(m), self.ess, "one"), "stiffness")

    def _free(self, v: DataFrame) -> DataFrame:
        return v.join(self.ess.select("i"), "i", "left_anti")

    def _solve(self, a: DataFrame, b: DataFrame) -> DataFrame:
        everywhere = a.select("i").distinct().join(self._free(b), "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
        return krylov.frame_cg(a, everywhere, self.rel).x

    def forward(self, m: DataFrame) -> DataFrame:
        """The state: essential values lifted, the rest by conjugate gradients."""
        lift = self.ess.select("i", F.col("value").alias("v"))
        b = vec.scale(mx.spmv(self.raw_stiffness(m), lift), -1.0)
        if self.load is not None:
            b = vec.axpy(b, 1.0, self.load)
        u = self._solve(self.matrix(m), b)
        return written(self._free(u).unionByName(lift), "state")

    def adjoint(self, m: DataFrame, source: DataFrame) -> DataFrame:
        """A p = source with zero essential values."""
        return written(self._solve(self.matrix(m), source), "adjoint")

    # The misfit |B u - d|^2 / (2 s^2) of an observation matrix B.

    def misfit_source(self, b: DataFrame, u: DataFrame, data: DataFrame, variance: float) -> DataFrame:
        return vec.scale(mx.spmv_transpose(b, vec.axpy(mx.spmv(b, u), -1.0, data)), -1.0 / variance)

    def reduced_gradient(self, b: DataFrame, m: DataFrame, data: DataFrame, variance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(gradient of the misfit, state, adjoint)."""
        u = self.forward(m)
        p = self.adjoint(m, self.misfit_source(b, u, data, variance))
        return written(self.gradient_parameter(m, u, p), "gradient"), u, p

    def hessian(self, b: DataFrame, variance: float, m: DataFrame, u: DataFrame, p: DataFrame, dm: DataFrame, gauss_newton: bool = False) -> DataFrame:
        """The misfit's Hessian on dm: an incremental forward and an incremental adjoint solve, and block products."""
        c = written(self.block_c(m, u), "block")
        du = self.adjoint(m, vec.scale(mx.spmv(c, dm), -1.0))
        source = vec.scale(mx.spmv_transpose(b, mx.spmv(b, du)), -1.0 / variance)
        if not gauss_newton:
            wum = written(self.block_wum(m, p), "block")
            source = vec.axpy(source, -1.0, mx.spmv(wum, dm))
        dp = self.adjoint(m, source)
        out = mx.spmv_transpose(c, dp)
        if gauss_newton:
            return out
        more = mx.spmv_transpose(wum, du).unionByName(mx.spmv(self.block_wmm(m, u, p), dm))
        return mx.scatter_vector(out.unionByName(more))


# A square-root factor of c0^2 M + c1^2 K, and the prior R = A M^-1 A with A = gamma K + delta M.


def sqrt_precision(elements: DataFrame, c0: float, c1: float) -> DataFrame:
    """S (i, j, v) with S S^T = c0^2 M + c1^2 K: columns 5 e + 0, 1, 2 for the edge midpoints of an element and 3, 4 for the
    directions of its gradients."""
    geo = mesh.geometry(elements)
    third = F.sqrt(F.col("area") / 3) * (0.5 * c0)
    terms = [F.struct(F.lit(c).alias("c"), F.col("v")[k].alias("i"), third.alias("v")) for c in range(3) for k in (c, (c + 1) % 3)]
    terms += [F.struct(F.lit(3 + d).alias("c"), F.col("v")[k].alias("i"), (F.sqrt("area") * F.lit(float(c1)) * F.col(g)[k]).alias("v")) for d, g in enumerate(("gx", "gy")) for k in range(3)]
    return geo.select("e", F.explode(F.array(*terms)).alias("t")).select("t.i", (5 * F.col("e") + F.col("t.c")).alias("j"), "t.v")


def prior_operator(elements: DataFrame, gamma: float, delta: float) -> tuple[DataFrame, DataFrame]:
    """(A, lumped M)."""
    mass = mx.scatter_add(mesh.mass_entries(elements))
    return mx.add(mx.scatter_add(mesh.stiffness_entries(elements)), mass, gamma, delta), mx.row_sums(mass)


def prior_gradient(a: DataFrame, lumped: DataFrame, away: DataFrame) -> DataFrame:
    """R (m - mean) = A M^-1 A (m - mean), matrix by matrix."""
    return mx.spmv(a, vec.pointwise_divide(mx.spmv(a, away), lumped))


def prior_cost(a: DataFrame, lumped: DataFrame, away: DataFrame) -> DataFrame:
    """One row: half of (m - mean)^T R (m - mean)."""
    y = mx.spmv(a, away).join(lumped.withColumnRenamed("v", "w"), "i")
    return y.agg((0.5 * F.sum(F.col("v") * F.col("v") / F.col("w"))).alias("cost"))
