"""Registered queries of other cells, spaces, boundaries and facets, beside those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.catalogue import _BDR, _EDGE, _FACETS, _GRAD, _LOC, _MID, N, _d, _r, query
from fieldstone.operators import matrix as mx
from fieldstone.operators import transfer
from fieldstone.sources import cells, mesh

_M = N + 1
_H = _d(1 / N)
_AREA = _d(0.5 / N / N)


def _u(spark):
    """Values of a function at the vertices."""
    return mesh.vertices(spark, N).select(F.col("vid").alias("i"), (F.col("vid") % 7 - F.col("vid") % 5).cast("double").alias("v"))


_U = f"SELECT v AS i, (v % 7 - v % 5)::DOUBLE AS v FROM range({_M * _M}) r(v)"


# Squares and cubes: products of factors of one direction.


def _cell_sql(n: int, dim: int) -> str:
    at = " + ".join(f"(c // {n**d} % {n} + a // {2**d} % 2) * {(n + 1) ** d}" for d in range(dim))
    return f"SELECT c AS e, a, {at} AS i FROM range({n**dim}) r(c) CROSS JOIN range({2**dim}) k(a)"


def _tensor_sql(n: int, dim: int, kind: str) -> str:
    h = 1 / n
    same = [f"(p.a // {2**d} % 2 = q.a // {2**d} % 2)" for d in range(dim)]
    m = [f"(CASE WHEN {s} THEN {_d(h / 3)} ELSE {_d(h / 6)} END)" for s in same]
    k = [f"(CASE WHEN {s} THEN {_d(1 / h)} ELSE {_d(-1 / h)} END)" for s in same]
    value = " * ".join(m) if kind == "mass" else " + ".join(" * ".join(k[d] if d == c else m[d] for d in range(dim)) for c in range(dim))
    return f"SELECT p.i, q.i AS j, round(sum({value}), 12) + 0.0 AS v FROM ({_cell_sql(n, dim)}) p JOIN ({_cell_sql(n, dim)}) q ON p.e = q.e GROUP BY 1, 2"


def _summed(entries, digits: int = 12):
    return mx.scatter_add(entries).select("i", "j", (F.round("v", digits) + 0.0).alias("v"))


@query(f"SELECT e, a::INT AS a, i FROM ({_cell_sql(N, 2)})")
def quad_dofs(spark, d):
    return cells.lattice_cells(spark, N, 2).select("e", F.posexplode("v").alias("a", "i"))


@query(_tensor_sql(N, 2, "mass"))
def quad_mass(spark, d):
    return _summed(cells.tensor_mass_entries(cells.lattice_cells(spark, N, 2), 2, 1 / N))


@query(_tensor_sql(N, 2, "stiffness"))
def quad_stiffness(spark, d):
    return _summed(cells.tensor_stiffness_entries(cells.lattice_cells(spark, N, 2), 2, 1 / N))


@query(_tensor_sql(5, 3, "mass"))
def hex_mass(spark, d):
    return _summed(cells.tensor_mass_entries(cells.lattice_cells(spark, 5, 3), 3, 0.2))


@query(_tensor_sql(5, 3, "stiffness"))
def hex_stiffness(spark, d):
    return _summed(cells.tensor_stiffness_entries(cells.lattice_cells(spark, 5, 3), 3, 0.2))


# Tetrahedra: the gradients along a path of cube edges are differences of unit vectors.

_PATHS = "VALUES " + ", ".join(f"({k}, [{', '.join(map(str, p))}])" for k, p in enumerate(cells.PATHS))
_TN = 4


def _tet_sql() -> str:
    at = " + ".join(f"(c // {_TN**d} % {_TN} + CASE WHEN list_contains(p[1:s], {d}) THEN 1 ELSE 0 END) * {(_TN + 1) ** d}" for d in range(3))
    g = ", ".join(f"{_TN}e0 * (CASE WHEN s >= 1 AND p[s] = {d} THEN 1 ELSE 0 END - CASE WHEN s <= 2 AND p[s + 1] = {d} THEN 1 ELSE 0 END) AS g{d}" for d in range(3))
    return f"SELECT 6 * c + k AS e, s, {at} AS i, {g} FROM range({_TN**3}) r(c) CROSS JOIN ({_PATHS}) w(k, p) CROSS JOIN range(4) t(s)"


_VOL = 1 / _TN**3 / 6


@query(f"SELECT e, s::INT AS a, i FROM ({_tet_sql()})")
def tet_dofs(spark, d):
    return cells.tetrahedra(spark, _TN).select("e", F.posexplode("v").alias("a", "i"))


@query(f"SELECT p.i, q.i AS j, round(sum(CASE WHEN p.s = q.s THEN {_d(_VOL / 10)} ELSE {_d(_VOL / 20)} END), 12) AS v FROM ({_tet_sql()}) p JOIN ({_tet_sql()}) q ON p.e = q.e GROUP BY 1, 2")
def tet_mass(spark, d):
    return _summed(cells.tet_mass_entries(cells.tetrahedra(spark, _TN)))


@query(f"SELECT p.i, q.i AS j, round(sum({_d(_VOL)} * (p.g0 * q.g0 + p.g1 * q.g1 + p.g2 * q.g2)), 10) + 0.0 AS v FROM ({_tet_sql()}) p JOIN ({_tet_sql()}) q ON p.e = q.e GROUP BY 1, 2")
def tet_stiffness(spark, d):
    return _summed(cells.tet_stiffness_entries(cells.tetrahedra(spark, _TN)), 10)


_LEFT = f"e // 2 % {N} < {N // 2}"
_QUADS = f"SELECT * FROM ({_cell_sql(N, 2)}) WHERE e % {N} >= {N // 2}"


@query(
    f"SELECT i, j, round(sum(v), 12) + 0.0 AS v FROM (SELECT p.i, q.i AS j, (p.gx * q.gx + p.gy * q.gy) * {_AREA} AS v FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e WHERE p.{_LEFT} UNION ALL "
    f"SELECT p.i, q.i, (CASE WHEN p.a % 2 = q.a % 2 THEN 1 ELSE -1 END) * (CASE WHEN p.a // 2 = q.a // 2 THEN {_d(1 / 3)} ELSE {_d(1 / 6)} END) + (CASE WHEN p.a // 2 = q.a // 2 THEN 1 ELSE -1 END) * (CASE WHEN p.a % 2 = q.a % 2 THEN {_d(1 / 3)} ELSE {_d(1 / 6)} END) "
    f"FROM ({_QUADS}) p JOIN ({_QUADS}) q ON p.e = q.e) GROUP BY 1, 2"
)
def mixed_stiffness(spark, d):
    triangles, squares = cells.mixed_halves(spark, N)
    entries = mesh.stiffness_entries(triangles).select("i", "j", "v").unionByName(cells.tensor_stiffness_entries(squares, 2, 1 / N).select("i", "j", "v"))
    return _summed(entries)


@query(f"SELECT 3 * p.e + p.k AS i, 3 * q.e + q.k AS j, CASE WHEN p.k = q.k THEN {_d(round(0.5 / N / N / 6, 12))} ELSE {_d(round(0.5 / N / N / 12, 12))} END AS v FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e")
def broken_mass(spark, d):
    """The mass matrix of discontinuous linear functions."""
    return _summed(mesh.mass_entries(cells.broken(mesh.triangles(spark, N))))


# Edge spaces.

_ED = (
    f"SELECT a.e, least(a.i, b.i) * {_M * _M} + greatest(a.i, b.i) AS dof, CASE WHEN a.i < b.i THEN 1 ELSE -1 END AS sg, a.k AS s, b.k AS t, a.gx AS sx, a.gy AS sy, b.gx AS tx, b.gy AS ty "
    f"FROM ({_GRAD}) a JOIN ({_GRAD}) b ON a.e = b.e AND b.k = (a.k + 1) % 3"
)


def _share(a: str, b: str) -> str:
    return f"(CASE WHEN p.{a} = q.{b} THEN {_d(1 / 6)} ELSE {_d(1 / 12)} END)"


_EDGE_MASS = (
    f"SELECT p.dof AS i, q.dof AS j, round(sum(p.sg * q.sg * {_AREA} * ({_share('s', 's')} * (p.tx * q.tx + p.ty * q.ty) - {_share('s', 't')} * (p.tx * q.sx + p.ty * q.sy) "
    f"- {_share('t', 's')} * (p.sx * q.tx + p.sy * q.ty) + {_share('t', 't')} * (p.sx * q.sx + p.sy * q.sy))), 11) + 0.0 AS v FROM ({_ED}) p JOIN ({_ED}) q ON p.e = q.e GROUP BY 1, 2"
)
_EDGE_DERIVATIVE = f"SELECT p.dof AS i, q.dof AS j, round(sum({_AREA} * 4 * p.sg * q.sg * (p.sx * p.ty - p.sy * p.tx) * (q.sx * q.ty - q.sy * q.tx)), 8) + 0.0 AS v FROM ({_ED}) p JOIN ({_ED}) q ON p.e = q.e GROUP BY 1, 2"


@query(_EDGE_MASS)
def curl_mass(spark, d):
    return _summed(cells.edge_mass_entries(mesh.triangles(spark, N), _M * _M, "curl"), 11)


@query(_EDGE_MASS)
def div_mass(spark, d):
    """Turning both functions by a right angle changes no product."""
    return _summed(cells.edge_mass_entries(mesh.triangles(spark, N), _M * _M, "div"), 11)


@query(_EDGE_DERIVATIVE)
def curl_curl(spark, d):
    return _summed(cells.edge_derivative_entries(mesh.triangles(spark, N), _M * _M), 8)


def _edge_coefficients(spark):
    rows = cells.edges(mesh.triangles(spark, N), _M * _M).select(F.explode("edge").alias("p")).select(F.col("p.dof").alias("i")).distinct()
    return rows.select("i", (F.col("i") % 7 - 3).cast("double").alias("v"))


@query(f"SELECT e, round(sum((dof % 7 - 3) * sg * (tx - sx) / 3), 9) + 0.0 AS vx, round(sum((dof % 7 - 3) * sg * (ty - sy) / 3), 9) + 0.0 AS vy, round(sum((dof % 7 - 3) * sg * 2 * (sx * ty - sy * tx)), 7) + 0.0 AS der FROM ({_ED}) GROUP BY e")
def curl_field(spark, d):
    f = cells.edge_field(mesh.triangles(spark, N), _M * _M, _edge_coefficients(spark), "curl")
    return f.select("e", (F.round(F.col("val")[0], 9) + 0.0).alias("vx"), (F.round(F.col("val")[1], 9) + 0.0).alias("vy"), (F.round("der", 7) + 0.0).alias("der"))


@query(f"SELECT e, round(sum((dof % 7 - 3) * sg * (ty - sy) / 3), 9) + 0.0 AS vx, round(sum((dof % 7 - 3) * sg * (sx - tx) / 3), 9) + 0.0 AS vy, round(sum((dof % 7 - 3) * sg * 2 * (sx * ty - sy * tx)), 7) + 0.0 AS der FROM ({_ED}) GROUP BY e")
def div_field(spark, d):
    f = cells.edge_field(mesh.triangles(spark, N), _M * _M, _edge_coefficients(spark), "div")
    return f.select("e", (F.round(F.col("val")[0], 9) + 0.0).alias("vx"), (F.round(F.col("val")[1], 9) + 0.0).alias("vy"), (F.round("der", 7) + 0.0).alias("der"))


# The boundary.

_NX, _NY = "CASE attr WHEN 2 THEN 1e0 WHEN 4 THEN -1e0 ELSE 0e0 END", "CASE attr WHEN 1 THEN -1e0 WHEN 3 THEN 1e0 ELSE 0e0 END"


@query(
    f"SELECT b, attr, q::INT AS q, {_d(0.5 / N)} AS w, {_NX} AS nx, {_NY} AS ny, round((v0 % {_M} + s * (v1 % {_M} - v0 % {_M})) * {_H}, 12) AS x, round((v0 // {_M} + s * (v1 // {_M} - v0 // {_M})) * {_H}, 12) AS y "
    f"FROM ({_BDR}) CROSS JOIN (VALUES (0, 0.5e0 - 0.5e0 / sqrt(3e0)), (1, 0.5e0 + 0.5e0 / sqrt(3e0))) p(q, s)"
)
def boundary_quadrature(spark, d):
    return _r(cells.boundary_quadrature(spark, N), 12, "x", "y")


_BEL = f"SELECT b, attr, length, v0, v1, g.e FROM ({_BDR}) k JOIN ({_EDGE}) g(e, a, c) ON g.a = least(k.v0, k.v1) AND g.c = greatest(k.v0, k.v1)"


@query(f"SELECT b, attr, e FROM ({_BEL})")
def boundary_elements(spark, d):
    return cells.boundary_elements(mesh.boundary(spark, N), mesh.triangles(spark, N)).select("b", "attr", "e")


@query(f"SELECT b, attr IN (1, 4) AS marked, true AS \"all\", false AS none FROM ({_BDR})")
def boundary_marker(spark, d):
    return mesh.boundary(spark, N).select("b", cells.boundary_marker([1, 4]).alias("marked"), cells.boundary_marker("all").alias("all"), cells.boundary_marker(None).alias("none"))


@query(f"SELECT i, round(sum(g * {_d(0.5 / N)}), 12) AS v FROM (SELECT unnest([v0, v1]) AS i, 1 + ((v0 // {_M} + v1 // {_M}) * {_d(0.5 / N)}) ^ 2 AS g FROM ({_BDR}) WHERE attr = 2) GROUP BY i")
def boundary_load(spark, d):
    edges = mesh.boundary(spark, N).filter(cells.boundary_marker([2]))
    return _r(mx.scatter_vector(cells.boundary_load_entries(edges, N, 1 + F.col("y") * F.col("y"))), 12, "v")


_GU = f"SELECT g.e, sum(u.v * g.gx) AS ux, sum(u.v * g.gy) AS uy FROM ({_GRAD}) g JOIN ({_U}) u ON u.i = g.i GROUP BY g.e"


@query(f"SELECT attr, round(sum(length * (ux * ({_NX}) + uy * ({_NY}))), 8) + 0.0 AS flux FROM ({_BEL}) JOIN ({_GU}) USING (e) GROUP BY attr")
def boundary_flux(spark, d):
    return cells.boundary_flux(mesh.boundary(spark, N), mesh.triangles(spark, N), _u(spark)).select("attr", (F.round("flux", 8) + 0.0).alias("flux"))


@query(
    f"WITH x AS (SELECT b, 0 AS a, v0 AS i FROM ({_BDR}) UNION ALL SELECT b, 1, v1 FROM ({_BDR})) SELECT i, j, round(sum(v), 10) + 0.0 AS v FROM (SELECT p.i, q.i AS j, (p.gx * q.gx + p.gy * q.gy) * {_AREA} AS v FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e "
    f"UNION ALL SELECT p.i, q.i, 2.5e0 * {_H} / CASE WHEN p.a = q.a THEN 3e0 ELSE 6e0 END FROM x p JOIN x q ON p.b = q.b) GROUP BY 1, 2"
)
def robin_matrix(spark, d):
    """Boundary entries added to domain entries before the one sum."""
    inside = mesh.stiffness_entries(mesh.triangles(spark, N)).select("i", "j", "v")
    return _summed(inside.unionByName(mesh.boundary_mass_entries(mesh.boundary(spark, N)).select("i", "j", (2.5 * F.col("v")).alias("v"))), 10)


# Interior facets.

_FG = (
    f"SELECT v0, v1, minus, plus, sqrt(tx * tx + ty * ty) AS length, sgn * ty / sqrt(tx * tx + ty * ty) AS nx, -sgn * tx / sqrt(tx * tx + ty * ty) AS ny FROM ("
    f"SELECT *, CASE WHEN (mx - cx) * ty - (my - cy) * tx > 0 THEN 1 ELSE -1 END AS sgn FROM (SELECT f.*, (v1 % {_M} - v0 % {_M}) * {_H} AS tx, (v1 // {_M} - v0 // {_M}) * {_H} AS ty, "
    f"(v1 % {_M} + v0 % {_M}) * {_H} / 2 AS mx, (v1 // {_M} + v0 // {_M}) * {_H} / 2 AS my, m.cx, m.cy FROM ({_FACETS}) f JOIN ({_MID}) m ON m.e = f.minus))"
)
_FS = f"SELECT f.v0, f.v1, f.length, s.side, g.i, g.gx * f.nx + g.gy * f.ny AS dn FROM ({_FG}) f CROSS JOIN (VALUES (1e0), (-1e0)) s(side) JOIN ({_GRAD}) g ON g.e = CASE WHEN s.side = 1 THEN f.minus ELSE f.plus END"


@query(f"SELECT v0, v1, minus, plus, round(length, 10) AS length, round(nx, 10) + 0.0 AS nx, round(ny, 10) + 0.0 AS ny FROM ({_FG})")
def facet_geometry(spark, d):
    f = cells.facet_geometry(mesh.triangles(spark, N), N)
    return f.select("v0", "v1", "minus", "plus", F.round("length", 10).alias("length"), (F.round("nx", 10) + 0.0).alias("nx"), (F.round("ny", 10) + 0.0).alias("ny"))


@query(f"SELECT p.i, q.i AS j, round(sum(p.length * p.side * p.dn * q.side * q.dn), 6) + 0.0 AS v FROM ({_FS}) p JOIN ({_FS}) q ON p.v0 = q.v0 AND p.v1 = q.v1 GROUP BY 1, 2")
def facet_penalty(spark, d):
    return _summed(cells.facet_penalty_entries(mesh.triangles(spark, N), N), 6)


_FJ = f"SELECT f.v0, f.v1, sum(f.side * f.dn * u.v) AS jump, sum(f.dn * u.v) / 2 AS avg FROM ({_FS}) f JOIN ({_U}) u ON u.i = f.i GROUP BY 1, 2"


@query(f"SELECT v0, v1, round(jump, 6) + 0.0 AS jump, round(avg, 6) + 0.0 AS avg FROM ({_FJ})")
def facet_jumps(spark, d):
    f = cells.facet_jumps(mesh.triangles(spark, N), N, _u(spark))
    return f.select("v0", "v1", (F.round("jump", 6) + 0.0).alias("jump"), (F.round("avg", 6) + 0.0).alias("avg"))


@query(f"SELECT f.i, round(sum(f.length * j.jump * f.side * f.dn), 5) + 0.0 AS v FROM ({_FS}) f JOIN ({_FJ}) j ON f.v0 = j.v0 AND f.v1 = j.v1 GROUP BY 1")
def facet_residual(spark, d):
    return mx.scatter_vector(cells.facet_residual_entries(mesh.triangles(spark, N), N, _u(spark))).select("i", (F.round("v", 5) + 0.0).alias("v"))


# Forms without a matrix, gathers, boxes.


@query(f"SELECT p.i, round(sum(CASE WHEN p.k = q.k THEN {_d(0.5 / N / N / 6)} ELSE {_d(0.5 / N / N / 12)} END * u.v), 11) + 0.0 AS v FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e JOIN ({_U}) u ON u.i = q.i GROUP BY p.i")
def mass_functional(spark, d):
    return mx.scatter_vector(cells.mass_functional_entries(mesh.triangles(spark, N), _u(spark))).select("i", (F.round("v", 11) + 0.0).alias("v"))


@query(f"SELECT round(sum({_AREA} * cx * (1 + cy)), 10) AS value FROM ({_MID})")
def assemble_scalar(spark, d):
    mid = lambda c: (F.col(c)[0] + F.col(c)[1] + F.col(c)[2]) / 3
    return _r(cells.integral(mesh.triangles(spark, N), mid("x") * (1 + mid("y"))), 10, "value")


@query(f"SELECT l.e, l.k::INT AS a, l.i, u.v FROM ({_LOC}) l JOIN ({_U}) u ON u.i = l.i")
def gather_rows(spark, d):
    """Element values of a vector."""
    return mesh.elem_dofs(mesh.triangles(spark, N)).join(_u(spark), "i").select("e", "a", "i", "v")


@query(f"SELECT l.i, sum(u.v * (l.k + 1)) AS v FROM ({_LOC}) l JOIN ({_U}) u ON u.i = l.i GROUP BY l.i")
def assemble_dual(spark, d):
    """Element values summed to their dofs."""
    rows = mesh.elem_dofs(mesh.triangles(spark, N)).join(_u(spark), "i")
    return mx.scatter_vector(rows.select("i", (F.col("v") * (F.col("a") + 1)).alias("v")))


@query(
    "SELECT r::INT AS ranks, a::INT AS px, b::INT AS py, c::INT AS pz FROM (SELECT r.r, a.a, b.b, c.c, row_number() OVER (PARTITION BY r.r ORDER BY a.a + b.b + c.c, c.c) AS n FROM range(1, 41) r(r) "
    "JOIN range(1, 41) a(a) ON r.r % a.a = 0 JOIN range(1, 41) b(b) ON b.b >= a.a AND r.r % (a.a * b.b) = 0 JOIN range(1, 41) c(c) ON c.c >= b.b AND a.a * b.b * c.c = r.r) WHERE n = 1"
)
def rank_grid(spark, d):
    return spark.createDataFrame([(r, *cells.rank_grid(r)) for r in range(1, 41)], "ranks int, px int, py int, pz int")


@query("SELECT c AS e, ((c % 6) * 2 // 6 + 2 * ((c // 6 % 6) * 2 // 6 + 2 * ((c // 36) * 3 // 6)))::INT AS rank FROM range(216) r(c)")
def box_owner(spark, d):
    return cells.box_owner(mesh.box(spark, 6), 6, 12)


# Transfers.

_EDGE_NO = f"SELECT v0, v1, {_M * _M} + row_number() OVER (ORDER BY v0, v1) - 1 AS i FROM (SELECT DISTINCT v0, v1 FROM ({_EDGE}))"


@query(f"SELECT v AS i, v AS j, 1e0 AS v FROM range({_M * _M}) r(v) UNION ALL SELECT i, unnest([v0, v1]), 0.5e0 FROM ({_EDGE_NO})")
def interpolation(spark, d):
    return transfer.interpolation(mesh.triangles(spark, N), _M * _M)


_FX, _FY, _FM = f"(f % {2 * N + 1})", f"(f // {2 * N + 1})", f"range({(2 * N + 1) ** 2}) r(f)"
_CV = lambda x, y: f"(({y}) // 2) * {_M} + ({x}) // 2"


@query(
    f"SELECT f AS i, {_CV(_FX, _FY)} AS j, 1e0 AS v FROM {_FM} WHERE {_FX} % 2 = 0 AND {_FY} % 2 = 0 UNION ALL "
    f"SELECT f, unnest([{_CV(f'{_FX} - {_FX} % 2', f'{_FY} - {_FY} % 2')}, {_CV(f'{_FX} + {_FX} % 2', f'{_FY} + {_FY} % 2')}]), 0.5e0 FROM {_FM} WHERE {_FX} % 2 = 1 OR {_FY} % 2 = 1"
)
def refinement(spark, d):
    return transfer.refinement(spark, N)


@query(f"SELECT f AS i, {_CV(_FX, _FY)} AS j, 1e0 AS v FROM {_FM} WHERE {_FX} % 2 = 0 AND {_FY} % 2 = 0 AND {_FY} > 0 UNION ALL "
       f"SELECT f, unnest([{_CV(f'{_FX} - {_FX} % 2', f'{_FY} - {_FY} % 2')}, {_CV(f'{_FX} + {_FX} % 2', f'{_FY} + {_FY} % 2')}]), 0.5e0 FROM {_FM} WHERE ({_FX} % 2 = 1 OR {_FY} % 2 = 1) AND {_FY} > 0")  # fmt: skip
def refinement_free(spark, d):
    """Without the rows of essential fine vertices."""
    bottom = mesh.essential_indices(mesh.boundary(spark, 2 * N), [1])
    return transfer.refinement(spark, N, bottom)
