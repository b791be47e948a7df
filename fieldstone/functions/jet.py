"""Differentiable pointwise densities: second-order jets and the element kernels built on them.

A density is a function of the fields' values and gradients at a point. It is evaluated once per batch of quadrature
points on jets, which carry value, gradient and Hessian with respect to all pointwise arguments; element vectors and
matrices follow by contraction with basis tables. Third derivatives in a direction are complex-step derivatives of the
Hessian, exact to rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np


class Jet:
    """Value v (n,), gradient g (n, k) and Hessian h (n, k, k) of an expression."""

    __array_priority__ = 100

    def __init__(self, v: np.ndarray, g: np.ndarray, h: np.ndarray):
        self.v, self.g, self.h = v, g, h

    def _with(self, f, df, ddf) -> Jet:
        """f of the expression, from its first two derivatives there."""
        outer = self.g[:, :, None] * self.g[:, None, :]
        return Jet(f, df[:, None] * self.g, df[:, None, None] * self.h + ddf[:, None, None] * outer)

    def _lift(self, y) -> Jet:
        return y if isinstance(y, Jet) else Jet(np.broadcast_to(y, self.v.shape), np.zeros_like(self.g), np.zeros_like(self.h))

    def __add__(self, y):
        y = self._lift(y)
        return Jet(self.v + y.v, self.g + y.g, self.h + y.h)

    __radd__ = __add__

    def __neg__(self):
        return Jet(-self.v, -self.g, -self.h)

    def __sub__(self, y):
        return self + (-self._lift(y))

    def __rsub__(self, y):
        return self._lift(y) - self

    def __mul__(self, y):
        y = self._lift(y)
        cross = self.g[:, :, None] * y.g[:, None, :]
        return Jet(self.v * y.v, self.v[:, None] * y.g + y.v[:, None] * self.g, self.v[:, None, None] * y.h + y.v[:, None, None] * self.h + cross + cross.transpose(0, 2, 1))

    __rmul__ = __mul__

    def __truediv__(self, y):
        return self * self._lift(y).power(-1.0)

    def __rtruediv__(self, y):
        return self._lift(y) / self

    def power(self, a: float) -> Jet:
        return self._with(self.v**a, a * self.v ** (a - 1), a * (a - 1) * self.v ** (a - 2))

    def __pow__(self, a: float) -> Jet:
        return self.power(float(a)) if a not in (0, 1, 2) else (self._lift(1.0), self, self * self)[int(a)]


def exp(x):
    return x._with(e := np.exp(x.v), e, e) if isinstance(x, Jet) else np.exp(x)


def log(x):
    return x._with(np.log(x.v), 1 / x.v, -1 / x.v**2) if isinstance(x, Jet) else np.log(x)


def sin(x):
    return x._with(np.sin(x.v), np.cos(x.v), -np.sin(x.v)) if isinstance(x, Jet) else np.sin(x)


def cos(x):
    return x._with(np.cos(x.v), -np.sin(x.v), -np.cos(x.v)) if isinstance(x, Jet) else np.cos(x)


def sqrt(x):
    return x.power(0.5) if isinstance(x, Jet) else np.sqrt(x)


def tanh(x):
    if not isinstance(x, Jet):
        return np.tanh(x)
    t = np.tanh(x.v)
    return x._with(t, 1 - t * t, -2 * t * (1 - t * t))


@dataclass
class Field:
    """A scalar field at points: its value and gradient components."""

    val: object
    grad: tuple


def inner(a, b):
    """Full contraction of two gradients (tuples)."""
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def norm2(a):
    return inner(a, a)


@cache
def triangle_rule(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Points (q, 2) and weights of a rule on the unit triangle that is exact to `degree`: Gauss products, collapsed."""
    n = degree // 2 + 1
    t, w = np.polynomial.legendre.leggauss(n + 1)
    t, w = (t + 1) / 2, w / 2
    x, y = t[:, None], t[None, :] * (1 - t[:, None])
    return np.stack([np.broadcast_to(x, y.shape).ravel(), y.ravel()], axis=1), (w[:, None] * w[None, :] * (1 - t[:, None])).ravel()


def basis(order: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lagrange basis of order 1 or 2 on the unit triangle: values (q, a) and gradients (q, a, 2). Midpoints follow vertices."""
    x, y = points[:, 0], points[:, 1]
    lam = np.stack([1 - x - y, x, y], axis=1)
    dlam = np.array([[-1.0, -1.0], [1.0, 0.0], [0.0, 1.0]])
    if order == 1:
        return lam, np.broadcast_to(dlam, (len(x), 3, 2)).copy()
    pairs = [(0, 1), (1, 2), (2, 0)]
    value = np.concatenate([lam * (2 * lam - 1), np.stack([4 * lam[:, i] * lam[:, j] for i, j in pairs], axis=1)], axis=1)
    vertex = (4 * lam - 1)[:, :, None] * dlam
    mid = np.stack([4 * (lam[:, i, None] * dlam[j] + lam[:, j, None] * dlam[i]) for i, j in pairs], axis=1)
    return value, np.concatenate([vertex, mid], axis=1)


class ElementKernel:
    """Integrals of a density and its derivatives over a batch of triangles.

    density(u, m, p, x) gets a Field per slot and the coordinates; slots are named by `orders`.
    """

    def __init__(self, density: Callable, orders: tuple[int, ...], degree: int | None = None):
        self.density, self.orders = density, orders
        self.points, self.weights = triangle_rule(2 * max(orders) + 2 if degree is None else degree)
        self.tables = [basis(k, self.points) for k in orders]

    def _geometry(self, x: np.ndarray):
        """Weights (e, q), coordinates (e, q, 2) and tables (e, q, a, 3) of triangles with vertices x (e, 3, 2)."""
        jac = np.stack([x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]], axis=2)
        det = jac[:, 0, 0] * jac[:, 1, 1] - jac[:, 0, 1] * jac[:, 1, 0]
        inverse = np.linalg.inv(jac)
        at = x[:, None, 0] + np.einsum("eij,qj->eqi", jac, self.points)
        out = []
        for value, grad in self.tables:
            g = np.einsum("qaj,ejd->eqad", grad, inverse)
            out.append(np.concatenate([np.broadcast_to(value[None, :, :, None], (*g.shape[:3], 1)), g], axis=3))
        return np.abs(det)[:, None] * self.weights, at, out

    def _points(self, x):
        """(weights, tables, what the density gets besides the fields)."""
        w, at, tables = self._geometry(x)
        return w, tables, ((at[..., 0].ravel(), at[..., 1].ravel()),)

    def _fields(self, fields: list[Field]) -> list:
        """The density's arguments from one field per slot."""
        return fields

    def _evaluate(self, x, dofs: list[np.ndarray]):
        """(weights, tables, jet of the density) with the pointwise arguments in order: value, d/dx, d/dy of each slot."""
        w, tables, rest = self._points(x)
        ne, nq = w.shape
        k = 3 * len(self.orders)
        unit, flat = np.eye(k), np.zeros((ne * nq, k, k))
        fields = []
        for s, (table, d) in enumerate(zip(tables, dofs, strict=True)):
            z = np.einsum("eqak,ea->eqk", table, d).reshape(ne * nq, 3)
            jets = [Jet(z[:, c], np.broadcast_to(unit[3 * s + c], (ne * nq, k)), flat) for c in range(3)]
            fields.append(Field(jets[0], (jets[1], jets[2])))
        out = self.density(*self._fields(fields), *rest)
        return w, tables, out if isinstance(out, Jet) else jets[0]._lift(out)

    def values(self, x, dofs) -> np.ndarray:
        w, _, f = self._evaluate(x, dofs)
        return (w * f.v.reshape(w.shape)).sum(axis=1)

    def vector(self, slot: int, x, dofs) -> np.ndarray:
        """(e, a): derivative with respect to a slot's dofs."""
        w, tables, f = self._evaluate(x, dofs)
        g = f.g.reshape(*w.shape, -1)[..., 3 * slot : 3 * slot + 3]
        return np.einsum("eq,eqk,eqak->ea", w, g, tables[slot])

    def matrices(self, pairs: list[tuple[int, int]], x, dofs) -> dict[tuple[int, int], np.ndarray]:
        """(e, a, b) of several blocks from one pass."""
        w, tables, f = self._evaluate(x, dofs)
        h = f.h.reshape(*w.shape, *f.h.shape[1:])
        return {(i, j): np.einsum("eq,eqkl,eqak,eqbl->eab", w, h[..., 3 * i : 3 * i + 3, 3 * j : 3 * j + 3], tables[i], tables[j], optimize=True) for i, j in pairs}

    def third(self, i: int, j: int, x, dofs, direction, step: float = 1e-30) -> np.ndarray:
        """(e, a, b): derivative of block (i, j) along `direction` (dofs of every slot), by a complex step."""
        moved = [d + 1j * step * t for d, t in zip(dofs, direction, strict=True)]
        return self.matrices([(i, j)], x, moved)[i, j].imag / step

    def product(self, i: int, j: int, x, dofs, direction: np.ndarray) -> np.ndarray:
        """(e, a): block (i, j) times dofs of slot j, without forming the block."""
        w, tables, f = self._evaluate(x, dofs)
        h = f.h.reshape(*w.shape, *f.h.shape[1:])[..., 3 * i : 3 * i + 3, 3 * j : 3 * j + 3]
        z = np.einsum("eqbl,eb->eql", tables[j], direction)
        return np.einsum("eq,eqkl,eql,eqak->ea", w, h, z, tables[i], optimize=True)

    def third_product(self, i: int, j: int, k: int, x, dofs, first: np.ndarray, second: np.ndarray, step: float = 1e-30) -> np.ndarray:
        """(e, a): the third derivative in slots i, j and k with a direction in j and one in k."""
        moved = [d + 1j * step * second if s == k else d + 0j for s, d in enumerate(dofs)]
        return self.product(i, j, x, moved, first).imag / step

    def second_directional(self, i: int, x, dofs, directions: list[list[np.ndarray]], weights, step: float = 1e-30) -> np.ndarray:
        """(e, a): sum over directions t (dofs of every slot) of their weight times D^2 (d_i R)[t, t]."""
        out = 0.0
        for t, c in zip(directions, weights, strict=True):
            moved = [d + 1j * step * v for d, v in zip(dofs, t, strict=True)]
            out = out + c * sum(self.product(i, j, x, moved, t[j]).imag for j in range(len(self.orders))) / step
        return out

    def in_chunks(self, method: str, size: int, x: np.ndarray, dofs: list[np.ndarray], *before) -> np.ndarray:
        """A method's rows, from `size` elements at a time."""
        parts = [getattr(self, method)(*before, x[k : k + size], [d[k : k + size] for d in dofs]) for k in range(0, len(x), size)]
        return np.concatenate(parts)


@cache
def segment_rule(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss points and weights on [0, 1], exact to `degree`."""
    t, w = np.polynomial.legendre.leggauss(degree // 2 + 1)
    return (t + 1) / 2, w / 2


CORNERS = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])


class _EdgeKernel(ElementKernel):
    """What boundary and facet kernels share: points on edge k of a triangle, from corner k to corner k + 1."""

    def __init__(self, density: Callable, orders: tuple[int, ...], degree: int | None = None):
        self.density, self.orders = density, orders
        self.s, self.weights = segment_rule(2 * max(orders) + 2 if degree is None else degree)

    def _side(self, x: np.ndarray, edge: np.ndarray, s: np.ndarray, orders) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(tangents, coordinates (e, q, 2), tables (e, q, a, 3)) of points s on an edge of each triangle x (e, 3, 2)."""
        a, b = CORNERS, np.roll(CORNERS, -1, axis=0)
        reference = a[:, None] + s[None, :, None] * (b - a)[:, None]
        jac = np.stack([x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]], axis=2)
        inverse = np.linalg.inv(jac)
        at = x[:, None, 0] + np.einsum("eij,eqj->eqi", jac, reference[edge])
        tables = []
        for order in orders:
            found = [basis(order, p) for p in reference]
            value, grad = (np.stack([f[c] for f in found])[edge] for c in (0, 1))
            tables.append(np.concatenate([value[..., None], np.einsum("eqaj,ejd->eqad", grad, inverse)], axis=3))
        rows = np.arange(len(x))
        return x[rows, (edge + 1) % 3] - x[rows, edge], at, tables


class BoundaryKernel(_EdgeKernel):
    """Integrals over boundary edges of a density(u, m, p, x, n) with full gradients and the outward normal n.

    The first argument of the methods is (corners (b, 3, 2) of the elements beside the edges, counter-clockwise, and each
    edge's number in its element (b,)); dofs are the elements'.
    """

    def _points(self, x):
        corners, edge = x
        t, at, tables = self._side(corners, edge, self.s, self.orders)
        size = np.linalg.norm(t, axis=1)
        n = np.repeat(np.stack([t[:, 1], -t[:, 0]], axis=1) / size[:, None], len(self.s), axis=0)
        return size[:, None] * self.weights, tables, ((at[..., 0].ravel(), at[..., 1].ravel()), (n[:, 0], n[:, 1]))


@dataclass
class FacetField:
    """A field on both sides of a facet."""

    minus: Field
    plus: Field


def jump(f: FacetField):
    return f.minus.val - f.plus.val


def avg(f: FacetField):
    return (f.minus.val + f.plus.val) * 0.5


def jump_grad(f: FacetField) -> tuple:
    return tuple(a - b for a, b in zip(f.minus.grad, f.plus.grad, strict=True))


def avg_grad(f: FacetField) -> tuple:
    return tuple((a + b) * 0.5 for a, b in zip(f.minus.grad, f.plus.grad, strict=True))


class FacetKernel(_EdgeKernel):
    """Integrals over interior facets of a density of FacetFields, x and the normal n out of the minus side.

    The first argument of the methods is (corners of the minus and the plus elements, the facet's number in either). Slots
    come in pairs: 2 s is the minus side of field s and 2 s + 1 its plus side.
    """

    def __init__(self, density: Callable, orders: tuple[int, ...], degree: int | None = None):
        super().__init__(density, tuple(o for order in orders for o in (order, order)), degree)

    def _points(self, x):
        minus, plus, left, right = x
        t, at, first = self._side(minus, left, self.s, self.orders[::2])
        _, other, second = self._side(plus, right, 1 - self.s, self.orders[::2])
        if not np.allclose(at, other):
            raise ValueError("the sides of a facet do not meet")
        size = np.linalg.norm(t, axis=1)
        n = np.repeat(np.stack([t[:, 1], -t[:, 0]], axis=1) / size[:, None], len(self.s), axis=0)
        tables = [table for pair in zip(first, second, strict=True) for table in pair]
        return size[:, None] * self.weights, tables, ((at[..., 0].ravel(), at[..., 1].ravel()), (n[:, 0], n[:, 1]))

    def _fields(self, fields: list[Field]) -> list:
        return [FacetField(fields[k], fields[k + 1]) for k in range(0, len(fields), 2)]


def facet_symmetry_defect(density: Callable, fields: int, seed: int = 1) -> float:
    """How much a facet density changes, relative to its size, when the sides are exchanged and the normal is turned."""
    r = np.random.default_rng(seed)
    side = lambda: Field(r.normal(size=20), (r.normal(size=20), r.normal(size=20)))
    pairs = [(side(), side()) for _ in range(fields)]
    x, angle = (r.random(20), r.random(20)), r.random(20) * 2 * np.pi
    n = (np.cos(angle), np.sin(angle))
    here = density(*(FacetField(a, b) for a, b in pairs), x, n)
    there = density(*(FacetField(b, a) for a, b in pairs), x, (-n[0], -n[1]))
    return float(np.abs(here - there).max() / max(np.abs(here).max(), 1e-300))
