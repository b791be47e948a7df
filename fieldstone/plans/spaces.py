"""Meshes and Lagrange spaces as arrays, for problems that fit one process, and their assembly over frames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.functions.jet import ElementKernel


@dataclass
class Square:
    """The triangulated unit square with n cells per side, numbered as sources.mesh numbers it."""

    n: int

    def __post_init__(self) -> None:
        m = self.n + 1
        k = np.arange(m * m)
        self.vertices = np.stack([(k % m) / self.n, (k // m) / self.n], axis=1)
        c = np.arange(self.n**2)
        low = (c // self.n) * m + c % self.n
        pair = np.stack([np.stack([low, low + 1, low + m + 1], 1), np.stack([low, low + m + 1, low + m], 1)], axis=1)
        self.triangles = pair.reshape(-1, 3)
        self.corners = self.vertices[self.triangles]


@dataclass
class Space:
    """Continuous Lagrange functions of order 1 or 2: dofs are vertices, then edge midpoints."""

    mesh: Square
    order: int = 1

    def __post_init__(self) -> None:
        t = self.mesh.triangles
        self.dofs, self.coordinates = t, self.mesh.vertices
        if self.order == 2:
            ends = np.sort(np.stack([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]], axis=1), axis=2)
            edges, inverse = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
            self.dofs = np.concatenate([t, len(self.mesh.vertices) + inverse.reshape(-1, 3)], axis=1)
            self.coordinates = np.concatenate([self.mesh.vertices, self.mesh.vertices[edges].mean(axis=1)])
        self.dim = len(self.coordinates)

    def project(self, f) -> np.ndarray:
        return np.broadcast_to(f(self.coordinates[:, 0], self.coordinates[:, 1]), self.dim).astype(float)

    def on_boundary(self, *attributes: int) -> np.ndarray:
        """Dofs on sides 1 bottom, 2 right, 3 top, 4 left."""
        x, y = self.coordinates.T
        sides = {1: y == 0, 2: x == 1, 3: y == 1, 4: x == 0}
        return np.flatnonzero(np.logical_or.reduce([sides[a] for a in attributes]))

    def observation(self, targets: np.ndarray) -> np.ndarray:
        """Rows that evaluate a function at points; the smallest element that holds a point owns it."""
        from fieldstone.functions.jet import basis

        out = np.zeros((len(targets), self.dim))
        base, jac = self.mesh.corners[:, 0], np.stack([self.mesh.corners[:, 1] - self.mesh.corners[:, 0], self.mesh.corners[:, 2] - self.mesh.corners[:, 0]], axis=2)
        inverse = np.linalg.inv(jac)
        for k, x in enumerate(targets):
            xi = np.einsum("eij,ej->ei", inverse, x - base)
            inside = np.flatnonzero((xi >= -1e-12).all(axis=1) & (xi.sum(axis=1) <= 1 + 1e-12))
            if not len(inside):
                raise ValueError(f"the point {x} is not in the mesh")
            out[k, self.dofs[inside[0]]] = basis(self.order, xi[inside[:1]])[0][0]
        return out


def scatter(shape: tuple[int, int], rows: np.ndarray, cols: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(shape)
    np.add.at(out, (rows[:, :, None], cols[:, None, :]), blocks)
    return out


def mass(space: Space, coefficient: float = 1.0) -> np.ndarray:
    k = ElementKernel(lambda u, x: 0.5 * coefficient * u.val * u.val, (space.order,))
    return scatter((space.dim,) * 2, space.dofs, space.dofs, k.matrices([(0, 0)], space.mesh.corners, [np.zeros(space.dofs.shape)])[0, 0])


def stiffness(space: Space, theta: tuple = ((1.0, 0.0), (0.0, 1.0))) -> np.ndarray:
    (a, b), (c, d) = theta
    k = ElementKernel(lambda u, x: 0.5 * (a * u.grad[0] * u.grad[0] + (b + c) * u.grad[0] * u.grad[1] + d * u.grad[1] * u.grad[1]), (space.order,))
    return scatter((space.dim,) * 2, space.dofs, space.dofs, k.matrices([(0, 0)], space.mesh.corners, [np.zeros(space.dofs.shape)])[0, 0])


def boundary_mass(space: Space) -> np.ndarray:
    """Mass matrix of the boundary of the square, order 1."""
    n, m = space.mesh.n, space.mesh.n + 1
    k = np.arange(n)
    edges = np.concatenate([np.stack(p, 1) for p in ((k, k + 1), (k * m + n, (k + 1) * m + n), (n * m + k, n * m + k + 1), (k * m, (k + 1) * m))])
    local = np.broadcast_to(np.array([[2.0, 1.0], [1.0, 2.0]]) / (6 * n), (len(edges), 2, 2))
    return scatter((space.dim,) * 2, edges, edges, local)


def boundary_edges(mesh: Square, *attributes: int) -> tuple[np.ndarray, np.ndarray]:
    """(element, edge in it) of the boundary edges on sides 1 bottom, 2 right, 3 top, 4 left."""
    n = mesh.n
    c = np.arange(n)
    sides = {1: (2 * c, 0), 2: (2 * (c * n + n - 1), 1), 3: (2 * (n * (n - 1) + c) + 1, 1), 4: (2 * c * n + 1, 2)}
    found = [(sides[a][0], np.full(n, sides[a][1])) for a in attributes]
    return np.concatenate([e for e, _ in found]), np.concatenate([k for _, k in found])


def facets(mesh: Square) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minus, plus, edge in minus, edge in plus) of the interior facets; minus is the smaller element."""
    t = mesh.triangles
    ends = np.sort(np.stack([t, np.roll(t, -1, axis=1)], axis=2).reshape(-1, 2), axis=1)
    order = np.lexsort((np.arange(len(ends)), ends[:, 1], ends[:, 0]))
    same = np.flatnonzero((ends[order[1:]] == ends[order[:-1]]).all(axis=1))
    a, b = order[same], order[same + 1]
    return a // 3, b // 3, a % 3, b % 3


# Assembly over frames: elements (e, x: six coordinates, d0, d1, ...: dofs of each slot).


def element_frame(spark: SparkSession, spaces: list[Space], parts: int = 8) -> DataFrame:
    mesh = spaces[0].mesh
    columns = {"e": pa.array(np.arange(len(mesh.triangles))), "x": pa.array(list(mesh.corners.reshape(-1, 6)))}
    columns |= {f"d{k}": pa.array(list(s.dofs.astype(np.int64))) for k, s in enumerate(spaces)}
    return spark.createDataFrame(pa.table(columns)).repartition(parts, "e")


def gather(elements: DataFrame, slot: int, values: DataFrame) -> DataFrame:
    """elements with v{slot}: the values (i, v) of the slot's dofs of each element, by one join and one grouped collect."""
    rows = elements.select("e", F.posexplode(f"d{slot}").alias("a", "i")).join(values, "i")
    lists = rows.groupBy("e").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "v"))), lambda s: s["v"]).alias(f"v{slot}"))
    return elements.join(lists, "e")


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assemble_vector(elements: DataFrame, kernel: ElementKernel, slot: int) -> DataFrame:
    """(i, v): the residual of a slot from elements with gathered values, kernels over Arrow batches and a grouped sum."""
    n = len(kernel.orders)

    def run(batches):
        for b in batches:
            get = lambda c, b=b: _stack(b.column(b.schema.get_field_index(c)))
            if b.num_rows:
                out = kernel.vector(slot, get("x").reshape(-1, 3, 2), [get(f"v{k}") for k in range(n)])
                yield pa.RecordBatch.from_arrays([pa.array(get(f"d{slot}").ravel()), pa.array(out.ravel())], ["i", "v"])

    return elements.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))


def assemble_matrices(elements: DataFrame, kernel: ElementKernel, pairs: list[tuple[int, int]]) -> DataFrame:
    """(block, i, j, v): several second-derivative blocks from one pass over the elements and one grouped sum."""
    n = len(kernel.orders)

    def run(batches):
        for b in batches:
            get = lambda c, b=b: _stack(b.column(b.schema.get_field_index(c)))
            if not b.num_rows:
                continue
            out = kernel.matrices(pairs, get("x").reshape(-1, 3, 2), [get(f"v{k}") for k in range(n)])
            for (i, j), m in out.items():
                rows, cols = np.broadcast_to(get(f"d{i}")[:, :, None], m.shape), np.broadcast_to(get(f"d{j}")[:, None, :], m.shape)
                yield pa.RecordBatch.from_arrays([pa.array([f"{i}{j}"] * m.size), pa.array(rows.ravel()), pa.array(cols.ravel()), pa.array(m.ravel())], ["block", "i", "j", "v"])

    return elements.mapInArrow(run, "block string, i long, j long, v double").groupBy("block", "i", "j").agg(F.sum("v").alias("v"))
