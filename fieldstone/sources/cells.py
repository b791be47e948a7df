"""Other cells, spaces and parts of meshes as frames: squares, cubes and tetrahedra, mixed meshes, discontinuous and edge
spaces on triangles, and the geometry of boundary edges and interior facets.

Corner a of a lattice cell has the bits of a as its coordinates in the cell: a = bx + 2 by + 4 bz.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.functions import pointwise
from fieldstone.sources import mesh


def lattice_cells(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """(e, v: 2^dim corners) of the n^dim cells of the unit square or cube."""
    m = n + 1
    at = [F.floor(F.col("id") / n**d) % n for d in range(dim)]
    corner = lambda a: sum(((at[d] + (a >> d & 1)) * m**d for d in range(dim)), F.lit(0))
    return spark.range(n**dim).select(F.col("id").alias("e"), F.array(*[corner(a).cast("bigint") for a in range(2**dim)]).alias("v"))


def _pairs(cells: DataFrame) -> DataFrame:
    rows = cells.select("*", F.posexplode("v").alias("a", "i"))
    return rows.select("*", F.posexplode("v").alias("b", "j"))


def _factors(dim: int, h: float) -> tuple[list[Column], list[Column]]:
    """Mass and stiffness of linear functions of one direction, of corners a and b, for each direction."""
    bit = lambda c, d: F.shiftright(F.col(c), d).bitwiseAND(F.lit(1))
    same = [bit("a", d) == bit("b", d) for d in range(dim)]
    return [F.when(s, h / 3).otherwise(h / 6) for s in same], [F.when(s, 1 / h).otherwise(-1 / h) for s in same]


def _product(factors: list[Column]) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out


def tensor_mass_entries(cells: DataFrame, dim: int, h: float) -> DataFrame:
    """(e, i, j, v) of multilinear functions on cells of side h."""
    m, _ = _factors(dim, h)
    return _pairs(cells).select("e", "i", "j", _product(m).alias("v"))


def tensor_stiffness_entries(cells: DataFrame, dim: int, h: float) -> DataFrame:
    m, k = _factors(dim, h)
    terms = [_product([k[d] if d == c else m[d] for d in range(dim)]) for c in range(dim)]
    return _pairs(cells).select("e", "i", "j", sum(terms[1:], terms[0]).alias("v"))


#: The six orders in which a path along cube edges takes the directions.
PATHS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def tetrahedra(spark: SparkSession, n: int) -> DataFrame:
    """(e, v: four vertices, p: their coordinates): six tetrahedra per cell of the unit cube, one for each path from its
    lowest to its highest corner."""
    m = n + 1
    at = [F.floor(F.col("id") / n**d) % n for d in range(3)]

    def path(k: int) -> Column:
        steps, corners = [0, 0, 0], []
        for d in (None, *PATHS[k]):
            if d is not None:
                steps[d] = 1
            corners.append(list(steps))
        vid = [sum(((at[d] + c[d]) * m**d for d in range(3)), F.lit(0)).cast("bigint") for c in corners]
        points = [F.array(*[(at[d] + c[d]) / F.lit(float(n)) for d in range(3)]) for c in corners]
        return F.struct(F.lit(k).alias("k"), F.array(*vid).alias("v"), F.array(*points).alias("p"))

    cells = spark.range(n**3).select("id", F.explode(F.array(*[path(k) for k in range(6)])).alias("t"))
    return cells.select((6 * F.col("id") + F.col("t.k")).alias("e"), F.col("t.v").alias("v"), F.col("t.p").alias("p"))


def tet_geometry(tets: DataFrame) -> DataFrame:
    """tets with volume and g, the gradients of the four linear basis functions."""
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    p = lambda k: F.element_at("p", k + 1)
    df = tets.select("*", *[minus(p(k), p(0)).alias(f"_d{k}") for k in (1, 2, 3)])
    df = df.withColumn("_det", pointwise.dot(F.col("_d1"), pointwise.cross(F.col("_d2"), F.col("_d3"))))
    over = lambda c: F.transform(c, lambda x: x / F.col("_det"))
    df = df.withColumns({f"_g{k}": over(pointwise.cross(F.col(f"_d{k % 3 + 1}"), F.col(f"_d{(k + 1) % 3 + 1}"))) for k in (1, 2, 3)})
    first = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda c: -(F.element_at("_g1", c) + F.element_at("_g2", c) + F.element_at("_g3", c)))
    return df.withColumns({"volume": F.abs("_det") / 6, "g": F.array(first, "_g1", "_g2", "_g3")}).select(*tets.columns, "volume", "g")


def tet_mass_entries(tets: DataFrame) -> DataFrame:
    return _pairs(tet_geometry(tets)).select("e", "i", "j", (F.col("volume") / 20 * F.when(F.col("a") == F.col("b"), 2.0).otherwise(1.0)).alias("v"))


def tet_stiffness_entries(tets: DataFrame) -> DataFrame:
    g = lambda c: F.element_at("g", F.col(c) + 1)
    return _pairs(tet_geometry(tets)).select("e", "i", "j", (F.col("volume") * pointwise.dot(g("a"), g("b"))).alias("v"))


def mixed_halves(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """(triangles, squares) of a mesh of the unit square whose left half is cut into triangles."""
    left = F.floor(F.col("e") / 2) % n < n // 2
    return mesh.triangles(spark, n).filter(left), lattice_cells(spark, n, 2).filter(F.col("e") % n >= n // 2)


# Discontinuous functions.


def broken(elements: DataFrame) -> DataFrame:
    """Triangles whose vertices have a number of their own in each element: 3 e + a."""
    return elements.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda a: 3 * F.col("e") + a))


# Edge functions on triangles: w = p_i grad p_j - p_j grad p_i along the edge from the smaller to the larger vertex, and
# the same turned by a right angle, whose normal component is continuous.


def edges(elements: DataFrame, vertices: int) -> DataFrame:
    """elements with `edge`: structs (dof, sign, s, t) of the three edges; dof is smaller vertex * vertices + larger one."""
    v = lambda k: F.col("v")[k]

    def edge(s: int, t: int) -> Column:
        dof = F.least(v(s), v(t)) * vertices + F.greatest(v(s), v(t))
        return F.struct(dof.alias("dof"), F.when(v(s) < v(t), 1.0).otherwise(-1.0).alias("sign"), F.lit(s).alias("s"), F.lit(t).alias("t"))

    return mesh.geometry(elements).withColumn("edge", F.array(edge(0, 1), edge(1, 2), edge(2, 0)))


def _turned(kind: str) -> tuple[Column, Column]:
    """Gradients whose combinations are the basis functions: as they are, or turned."""
    gx, gy = F.col("gx"), F.col("gy")
    return (gx, gy) if kind == "curl" else (gy, F.transform(gx, lambda g: -g))


def edge_mass_entries(elements: DataFrame, vertices: int, kind: str = "curl") -> DataFrame:
    """(e, i, j, v); kind "curl" or "div"."""
    x, y = _turned(kind)
    both = edges(elements, vertices).select("*", F.explode("edge").alias("p")).select("*", F.explode("edge").alias("q"))
    share = lambda a, b: F.when(F.col(a) == F.col(b), 1 / 6).otherwise(1 / 12)
    gg = lambda a, b: x[F.col(a)] * x[F.col(b)] + y[F.col(a)] * y[F.col(b)]
    s, t, u, w = "p.s", "p.t", "q.s", "q.t"
    value = share(s, u) * gg(t, w) - share(s, w) * gg(t, u) - share(t, u) * gg(s, w) + share(t, w) * gg(s, u)
    return both.select("e", F.col("p.dof").alias("i"), F.col("q.dof").alias("j"), (F.col("p.sign") * F.col("q.sign") * F.col("area") * value).alias("v"))


def _derivative(p: str) -> Column:
    """The curl of an edge function, which is the divergence of the turned one."""
    s, t = F.col(f"{p}.s"), F.col(f"{p}.t")
    return 2 * F.col(f"{p}.sign") * (F.col("gx")[s] * F.col("gy")[t] - F.col("gy")[s] * F.col("gx")[t])


def edge_derivative_entries(elements: DataFrame, vertices: int) -> DataFrame:
    """(e, i, j, v) of the curls of the edge functions, or the divergences of the turned ones."""
    both = edges(elements, vertices).select("*", F.explode("edge").alias("p")).select("*", F.explode("edge").alias("q"))
    return both.select("e", F.col("p.dof").alias("i"), F.col("q.dof").alias("j"), (F.col("area") * _derivative("p") * _derivative("q")).alias("v"))


def edge_field(elements: DataFrame, vertices: int, coefficients: DataFrame, kind: str = "curl") -> DataFrame:
    """(e, val, der): a field with coefficients (i, v) at each element's centre, and its curl or divergence."""
    x, y = _turned(kind)
    rows = edges(elements, vertices).select("*", F.explode("edge").alias("p")).join(coefficients.select(F.col("i").alias("_dof"), F.col("v").alias("c")), F.col("p.dof") == F.col("_dof"))
    s, t = F.col("p.s"), F.col("p.t")
    c = F.col("c") * F.col("p.sign") / 3
    sums = rows.groupBy("e").agg(F.sum(c * (x[t] - x[s])).alias("vx"), F.sum(c * (y[t] - y[s])).alias("vy"), F.sum(F.col("c") * _derivative("p")).alias("der"))
    return sums.select("e", F.array("vx", "vy").alias("val"), "der")


# The boundary.


def boundary_marker(attributes: list[int] | str | None) -> Column:
    """Whether a boundary edge belongs to a condition: "all", none of them, or those of some attributes."""
    if attributes == "all":
        return F.lit(True)
    return F.col("attr").isin(attributes) if attributes else F.lit(False)


def boundary_quadrature(spark: SparkSession, n: int) -> DataFrame:
    """(b, attr, q, w, nx, ny, x, y): two Gauss points on each boundary edge, with outward normals."""
    m, h = n + 1, 1.0 / n
    coordinate = lambda v: ((F.col(v) % m) * h, F.floor(F.col(v) / m) * h)
    (x0, y0), (x1, y1) = coordinate("v0"), coordinate("v1")
    normal = {1: (0.0, -1.0), 2: (1.0, 0.0), 3: (0.0, 1.0), 4: (-1.0, 0.0)}
    pick = lambda c: F.coalesce(*[F.when(F.col("attr") == a, F.lit(v[c])) for a, v in normal.items()])
    points = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(0.5 + (q - 0.5) / math.sqrt(3)).alias("s")) for q in (0, 1)])
    rows = mesh.boundary(spark, n).select("*", F.explode(points).alias("p"))
    s = F.col("p.s")
    return rows.select("b", "attr", F.col("p.q").alias("q"), (F.col("length") / 2).alias("w"), pick(0).alias("nx"), pick(1).alias("ny"), (x0 + s * (x1 - x0)).alias("x"), (y0 + s * (y1 - y0)).alias("y"))


def boundary_elements(boundary: DataFrame, elements: DataFrame) -> DataFrame:
    """boundary with e, the element beside each edge."""
    ends = boundary.select("*", F.least("v0", "v1").alias("_a"), F.greatest("v0", "v1").alias("_b"))
    sides = mesh.edges_of(elements).select("e", F.col("v0").alias("_a"), F.col("v1").alias("_b"))
    return ends.join(sides, ["_a", "_b"]).drop("_a", "_b")


def boundary_load_entries(boundary: DataFrame, n: int, g: Column) -> DataFrame:
    """(b, i, v) of the integral of g p_i over boundary edges, g taken at each edge's middle (columns x, y)."""
    m = n + 1
    mid = lambda f: (f("v0") + f("v1")) / (2.0 * n)
    rows = boundary.withColumns({"x": mid(lambda v: F.col(v) % m), "y": mid(lambda v: F.floor(F.col(v) / m))})
    return rows.select("b", F.explode(F.array("v0", "v1")).alias("i"), (g * F.col("length") / 2).alias("v"))


def gradient(elements: DataFrame, u: DataFrame) -> DataFrame:
    """(e, ux, uy, ...): elements' geometry with the gradient of a linear function u (i, v)."""
    geo = mesh.geometry(elements)
    rows = geo.select("e", F.posexplode("v").alias("a", "i"), "gx", "gy").join(u, "i")
    sums = rows.groupBy("e").agg(F.sum(F.col("v") * F.col("gx")[F.col("a")]).alias("ux"), F.sum(F.col("v") * F.col("gy")[F.col("a")]).alias("uy"))
    return geo.join(sums, "e")


def boundary_flux(boundary: DataFrame, elements: DataFrame, u: DataFrame) -> DataFrame:
    """(attr, flux): the integral of the normal derivative of u, from the elements beside the boundary."""
    normal = {1: (0.0, -1.0), 2: (1.0, 0.0), 3: (0.0, 1.0), 4: (-1.0, 0.0)}
    pick = lambda c: F.coalesce(*[F.when(F.col("attr") == a, F.lit(v[c])) for a, v in normal.items()])
    near = boundary_elements(boundary, elements).select("b", "attr", "length", "e").join(gradient(elements, u).select("e", "ux", "uy"), "e")
    return near.groupBy("attr").agg(F.sum(F.col("length") * (F.col("ux") * pick(0) + F.col("uy") * pick(1))).alias("flux"))


# Interior facets.


def facet_geometry(elements: DataFrame, n: int) -> DataFrame:
    """(v0, v1, minus, plus, length, nx, ny): interior edges with the unit normal that points out of `minus`."""
    m, h = n + 1, 1.0 / n
    x = lambda v: (F.col(v) % m) * h
    y = lambda v: F.floor(F.col(v) / m) * h
    mean = lambda c: (F.col(c)[0] + F.col(c)[1] + F.col(c)[2]) / 3
    centre = elements.select(F.col("e").alias("minus"), mean("x").alias("cx"), mean("y").alias("cy"))
    tx, ty = x("v1") - x("v0"), y("v1") - y("v0")
    length = F.sqrt(tx * tx + ty * ty)
    out = ((x("v0") + x("v1")) / 2 - F.col("cx")) * ty - ((y("v0") + y("v1")) / 2 - F.col("cy")) * tx
    sign = F.when(out > 0, 1.0).otherwise(-1.0)
    return mesh.interior_facets(elements).join(centre, "minus").select("v0", "v1", "minus", "plus", length.alias("length"), (sign * ty / length).alias("nx"), (-sign * tx / length).alias("ny"))


def facet_sides(elements: DataFrame, n: int) -> DataFrame:
    """(v0, v1, length, side, a, i, dn): the normal derivative of each basis function on either side of each facet."""
    facets = facet_geometry(elements, n)
    side = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("e")) for s, c in ((1.0, "minus"), (-1.0, "plus"))])
    rows = facets.select("v0", "v1", "length", "nx", "ny", F.explode(side).alias("s")).select("v0", "v1", "length", "nx", "ny", "s.*")
    geo = mesh.geometry(elements).select("e", F.posexplode("v").alias("a", "i"), "gx", "gy")
    dn = F.col("gx")[F.col("a")] * F.col("nx") + F.col("gy")[F.col("a")] * F.col("ny")
    return rows.join(geo, "e").select("v0", "v1", "length", "side", "a", "i", dn.alias("dn"))


def facet_penalty_entries(elements: DataFrame, n: int) -> DataFrame:
    """(i, j, v) of the integral of the product of the jumps of the normal derivatives: four couplings of the two sides."""
    left = facet_sides(elements, n)
    right = left.select("v0", "v1", F.col("side").alias("s2"), F.col("i").alias("j"), F.col("dn").alias("dn2"))
    return left.join(right, ["v0", "v1"]).select("i", "j", (F.col("length") * F.col("side") * F.col("dn") * F.col("s2") * F.col("dn2")).alias("v"))


def facet_jumps(elements: DataFrame, n: int, u: DataFrame) -> DataFrame:
    """(v0, v1, length, jump, avg) of the normal derivative of u."""
    rows = facet_sides(elements, n).join(u, "i")
    value = F.col("v") * F.col("dn")
    return rows.groupBy("v0", "v1", "length").agg(F.sum(F.col("side") * value).alias("jump"), (F.sum(value) / 2).alias("avg"))


def facet_residual_entries(elements: DataFrame, n: int, u: DataFrame) -> DataFrame:
    """(i, v): the derivative of half the squared jumps, each facet from both its sides."""
    jumps = facet_jumps(elements, n, u).select("v0", "v1", "jump")
    return facet_sides(elements, n).join(jumps, ["v0", "v1"]).select("i", (F.col("length") * F.col("jump") * F.col("side") * F.col("dn")).alias("v"))


# Linear forms without a matrix.


def mass_functional_entries(elements: DataFrame, w: DataFrame) -> DataFrame:
    """(e, i, v) of M w, element by element."""
    geo = mesh.geometry(elements).select("e", "area", F.explode("v").alias("i"))
    rows = geo.join(w, "i")
    total = rows.groupBy("e").agg(F.sum("v").alias("s"))
    return rows.join(total, "e").select("e", "i", (F.col("area") / 12 * (F.col("v") + F.col("s"))).alias("v"))


def integral(elements: DataFrame, f: Column) -> DataFrame:
    """One row: the integral of f, constant on each element (columns area, x, y may be used)."""
    return mesh.geometry(elements).agg(F.sum(F.col("area") * f).alias("value"))


# Boxes of a lattice.


def rank_grid(ranks: int) -> tuple[int, int, int]:
    """The most cubic boxes that `ranks` tasks can share out: factors in ascending order with the smallest sum."""
    triples = [(a, b, ranks // (a * b)) for a in range(1, ranks + 1) if ranks % a == 0 for b in range(a, ranks // a + 1) if ranks // a % b == 0 and ranks // (a * b) >= b]
    return min(triples, key=lambda t: (sum(t), t[2]))


def box_owner(cells: DataFrame, n: int, ranks: int) -> DataFrame:
    """(e, rank) of cells of the cube, by the box of the grid of ranks that holds them."""
    grid = rank_grid(ranks)
    at = [F.floor((F.floor(F.col("e") / n**d) % n) * grid[d] / n) for d in range(3)]
    return cells.select("e", (at[0] + grid[0] * (at[1] + grid[1] * at[2])).cast("int").alias("rank"))
