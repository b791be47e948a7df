"""Registered queries of the sparse diffusion problem, priors, observations and applications, beside those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.catalogue import BLUR, _BDR, _GRAD, _LATTICE, _LOC, _PTS, _TD, N, _d, _lattice, _points, _r, _t, _trajectory, query
from fieldstone.functions import applied, philox
from fieldstone.operators import matrix as mx
from fieldstone.operators import misfits as mf
from fieldstone.plans import frames
from fieldstone.sources import mesh

_M = N + 1
_AREA = _d(0.5 / N / N)


def _vertex(spark, a: int, b: int):
    """(i, v): i % a / b at the vertices."""
    return mesh.vertices(spark, N).select(F.col("vid").alias("i"), ((F.col("vid") % a) / F.lit(float(b))).alias("v"))


def _at(name: str, a: int, b: int) -> str:
    """Mean and gradient on each element of a function that is i % a / b at the vertices."""
    return f"SELECT e, avg((i % {a}) / {b}e0) AS {name}, sum(gx * ((i % {a}) / {b}e0)) AS {name}x, sum(gy * ((i % {a}) / {b}e0)) AS {name}y FROM ({_GRAD}) GROUP BY e"


_FM, _FU, _FP = _at("m", 5, 5), _at("u", 7, 7), _at("p", 3, 3)


def _problem(spark) -> frames.Diffusion:
    ess = mx.essential_where(mesh.vertices(spark, N), F.col("y").isin(0.0, 1.0), F.col("y"))
    return frames.Diffusion(mesh.triangles(spark, N), ess)


def _fields(spark):
    return _vertex(spark, 5, 5), _vertex(spark, 7, 7), _vertex(spark, 3, 3)


def _z(df, digits: int):
    return df.withColumn("v", F.round("v", digits) + 0.0)


@query(f"SELECT p.i, q.i AS j, round(sum({_AREA} * exp(m) * (p.gx * q.gx + p.gy * q.gy)), 8) + 0.0 AS v FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e JOIN ({_FM}) m ON m.e = p.e GROUP BY 1, 2")
def diffusion_stiffness(spark, d):
    return _z(_problem(spark).raw_stiffness(_vertex(spark, 5, 5)), 8)


@query(f"SELECT p.i, q.i AS j, round(sum({_AREA} * exp(m) / 3 * (p.gx * ux + p.gy * uy)), 8) + 0.0 AS v FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e JOIN ({_FM}) m ON m.e = p.e JOIN ({_FU}) u ON u.e = p.e GROUP BY 1, 2")
def diffusion_c(spark, d):
    m, u, _ = _fields(spark)
    return _z(_problem(spark).block_c(m, u), 8)


@query(f"SELECT p.i, q.i AS j, round(sum({_AREA} * exp(m) / 9 * (ux * px + uy * py)), 8) + 0.0 AS v FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e JOIN ({_FM}) m ON m.e = p.e JOIN ({_FU}) u ON u.e = p.e JOIN ({_FP}) w ON w.e = p.e GROUP BY 1, 2")
def diffusion_wmm(spark, d):
    return _z(_problem(spark).block_wmm(*_fields(spark)), 8)


@query(f"SELECT p.i, q.i AS j, round(sum({_AREA} * exp(m) / 3 * (p.gx * px + p.gy * py)), 8) + 0.0 AS v FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e JOIN ({_FM}) m ON m.e = p.e JOIN ({_FP}) w ON w.e = p.e GROUP BY 1, 2")
def diffusion_wum(spark, d):
    m, _, p = _fields(spark)
    return _z(_problem(spark).block_wum(m, p), 8)


@query(f"SELECT l.i, round(sum({_AREA} * exp(m) / 3 * (ux * px + uy * py)), 8) + 0.0 AS v FROM ({_LOC}) l JOIN ({_FM}) m ON m.e = l.e JOIN ({_FU}) u ON u.e = l.e JOIN ({_FP}) w ON w.e = l.e GROUP BY 1")
def diffusion_gradient(spark, d):
    return _z(_problem(spark).gradient_parameter(*_fields(spark)), 8)


@query(f"SELECT round(sum({_AREA} * exp(m) * (ux * px + uy * py)), 6) AS value FROM ({_FM}) m JOIN ({_FU}) u ON m.e = u.e JOIN ({_FP}) w ON w.e = m.e")
def diffusion_functional(spark, d):
    return _r(_problem(spark).functional(*_fields(spark)), 6, "value")


@query(f"SELECT v AS i, round((v // {_M}) / {N}e0, 7) AS v FROM range({_M * _M}) r(v)")
def diffusion_forward(spark, d):
    """With a constant coefficient and u = y on two sides, u is y."""
    m = mesh.vertices(spark, N).select(F.col("vid").alias("i"), F.lit(0.3).alias("v"))
    return _r(_problem(spark).forward(m), 7, "v")


# Priors.

_K2 = f"SELECT p.i, q.i AS j, sum((p.gx * q.gx + p.gy * q.gy) * {_AREA}) AS k, sum(CASE WHEN p.k = q.k THEN {_d(0.5 / N / N / 6)} ELSE {_d(0.5 / N / N / 12)} END) AS m FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e GROUP BY 1, 2"


@query(f"SELECT i, j, round(2.25e0 * m + 0.16e0 * k, 14) + 0.0 AS v FROM ({_K2})")
def sqrt_precision_product(spark, d):
    """S S^T of the square-root factor."""
    s = frames.sqrt_precision(mesh.triangles(spark, N), 1.5, 0.4)
    return _z(mx.matmul(s, mx.transpose(s)), 14)


_S = (
    f"SELECT l.i, 5 * l.e + c.c AS j, {_d((0.5 / N / N / 3) ** 0.5 * 0.5 * 1.5)} AS v FROM ({_LOC}) l CROSS JOIN range(3) c(c) WHERE l.k = c.c OR l.k = (c.c + 1) % 3 UNION ALL "
    f"SELECT i, 5 * e + 3, {_d((0.5 / N / N) ** 0.5 * 0.4)} * gx FROM ({_GRAD}) UNION ALL SELECT i, 5 * e + 4, {_d((0.5 / N / N) ** 0.5 * 0.4)} * gy FROM ({_GRAD})"
)


@query(f"SELECT i, round(sum(v * (j % 11 - 5)), 9) + 0.0 AS v FROM ({_S}) GROUP BY i")
def sqrt_precision_apply(spark, d):
    s = frames.sqrt_precision(mesh.triangles(spark, N), 1.5, 0.4)
    noise = spark.range(10 * N * N).select(F.col("id").alias("i"), (F.col("id") % 11 - 5).cast("double").alias("v"))
    return _z(mx.spmv(s, noise), 9)


@query(f"SELECT j AS i, round(sum(v * (i % 9 - 4)), 9) + 0.0 AS v FROM ({_S}) GROUP BY j")
def sqrt_precision_transpose(spark, d):
    s = frames.sqrt_precision(mesh.triangles(spark, N), 1.5, 0.4)
    v = mesh.vertices(spark, N).select(F.col("vid").alias("i"), (F.col("vid") % 9 - 4).cast("double").alias("v"))
    return _z(mx.spmv_transpose(s, v), 9)


_PRIOR = (
    f"WITH a AS MATERIALIZED (SELECT i, j, 0.1e0 * k + 0.5e0 * m AS v, m FROM ({_K2})), l AS (SELECT i, sum(m) AS w FROM a GROUP BY i), y AS (SELECT i, sum(v * (j % 6)) AS v FROM a GROUP BY i)"
)


@query(f"{_PRIOR} SELECT a.i, round(sum(a.v * y.v / l.w), 5) + 0.0 AS v FROM a JOIN y ON a.j = y.i JOIN l ON l.i = y.i GROUP BY a.i")
def prior_gradient(spark, d):
    a, lumped = frames.prior_operator(mesh.triangles(spark, N), 0.1, 0.5)
    return _z(frames.prior_gradient(a, lumped, _vertex(spark, 6, 1)), 5)


@query(f"{_PRIOR} SELECT round(0.5 * sum(y.v * y.v / l.w), 5) AS cost FROM y JOIN l USING (i)")
def prior_cost(spark, d):
    a, lumped = frames.prior_operator(mesh.triangles(spark, N), 0.1, 0.5)
    return _r(frames.prior_cost(a, lumped, _vertex(spark, 6, 1)), 5, "cost")


@query(f"SELECT v AS i, round(exp(-(power(v % {_M} / {N}e0 - 0.2, 2) + power(v // {_M} / {N}e0 - 0.3, 2)) / 0.04) + exp(-(power(v % {_M} / {N}e0 - 0.7, 2) + power(v // {_M} / {N}e0 - 0.6, 2)) / 0.04), 10) AS v FROM range({_M * _M}) r(v)")
def mollifier(spark, d):
    bump = applied.mollifier(F.col("x"), F.col("y"), [(0.2, 0.3), (0.7, 0.6)], 0.2)
    return mesh.vertices(spark, N).select(F.col("vid").alias("i"), F.round(bump, 10).alias("v"))


# Observations and misfits.


@query(f"SELECT t AS i, round((1 + t % 3) * 3 * x + (2 - t % 2) * -2 * y, 8) + 0.0 AS v FROM ({_PTS})")
def line_of_sight(spark, d):
    """A component of a vector field along a direction of each point's own."""
    b = mesh.observation_matrix(_points(spark), mesh.triangles(spark, N), N)
    directions = _points(spark).select(F.col("t").alias("i"), F.array((1 + F.col("t") % 3).cast("double"), (2 - F.col("t") % 2).cast("double")).alias("w"))
    u = mesh.vertices(spark, N).select(F.explode(F.array(F.struct((2 * F.col("vid")).alias("i"), (3 * F.col("x")).alias("v")), F.struct((2 * F.col("vid") + 1).alias("i"), (-2 * F.col("y")).alias("v")))).alias("s")).select("s.*")
    return _z(mx.spmv(mf.line_of_sight(b, directions, 2), u), 8)


@query("SELECT o_orderkey AS t, o_totalprice AS v FROM orders")
def observations_in_order(spark, d):
    """Values in target order, and back."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("v"))
    return mf.scatter_observations(mf.gather_observations(o, "t"), o.select("t"))


@query(f"SELECT round(sum(CASE WHEN p.k = q.k THEN {_d(0.5 / N / N / 6)} ELSE {_d(0.5 / N / N / 12)} END * (p.i % 7 / 7e0 - p.i % 3 / 3e0) * (q.i % 7 / 7e0 - q.i % 3 / 3e0)) / (2 * 0.04e0), 8) AS cost FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e WHERE p.e % 3 = 1")
def subdomain_misfit(spark, d):
    """Weighted L2 distance of state and data on the elements of an attribute."""
    elements = mesh.triangles(spark, N).withColumn("attr", F.col("e") % 3)
    w = mx.scatter_add(mesh.mass_entries(elements, F.when(F.col("attr") == 1, 1.0).otherwise(0.0)))
    return _r(mf.weighted_l2_cost(w, _vertex(spark, 7, 7), _vertex(spark, 3, 3), 0.04), 8, "cost")


@query(f"WITH x AS (SELECT b, 0 AS a, v0 AS i FROM ({_BDR}) WHERE attr = 3 UNION ALL SELECT b, 1, v1 FROM ({_BDR}) WHERE attr = 3) SELECT round(sum({_d(1 / N)} / CASE WHEN p.a = q.a THEN 3e0 ELSE 6e0 END * (p.i % 7 / 7e0 - p.i % 3 / 3e0) * (q.i % 7 / 7e0 - q.i % 3 / 3e0)) / 2, 8) AS cost FROM x p JOIN x q ON p.b = q.b")
def boundary_misfit(spark, d):
    w = mx.scatter_add(mesh.boundary_mass_entries(mesh.boundary(spark, N).filter("attr = 3")))
    return _r(mf.weighted_l2_cost(w, _vertex(spark, 7, 7), _vertex(spark, 3, 3), 1.0), 8, "cost")


@query(f"WITH x AS ({_TD}) SELECT k, round(sum((v - 1.1 * v - i % 5) ^ 2) / 2e2, 5) AS cost FROM x WHERE k % 3 = 0 GROUP BY k")
def td_misfit(spark, d):
    """One misfit per observed level; the others are not observed."""
    x = _trajectory(spark, d)
    data = x.filter("k % 3 = 0").select("k", F.col("i"), (1.1 * F.col("v") + F.col("i") % 5).alias("d"))
    return _r(mf.per_level(x, data, 1e2), 5, "cost")


# Random numbers: the ten rounds written out on unsigned integers of 128 bits.


def _philox_sql(seed: int, n: int) -> str:
    mask = "& 18446744073709551615::UHUGEINT"
    out = f"WITH c0 AS (SELECT i, (i // 4 + 1)::UHUGEINT AS a, 0::UHUGEINT AS b, 0::UHUGEINT AS c, 0::UHUGEINT AS d FROM range({n}) r(i))"
    k0, k1 = seed & (2**64 - 1), seed >> 64
    for r in range(10):
        out += (
            f", c{r + 1} AS (SELECT i, xor(xor((p >> 64), b), {k0}::UHUGEINT) AS a, (p {mask}) AS b, xor(xor((q >> 64), d), {k1}::UHUGEINT) AS c, (q {mask}) AS d "
            f"FROM (SELECT i, b, d, c * {int(philox.M1)}::UHUGEINT AS p, a * {int(philox.M0)}::UHUGEINT AS q FROM c{r}))"
        )
        k0, k1 = (k0 + int(philox.W0)) % 2**64, (k1 + int(philox.W1)) % 2**64
    return out + ", w AS (SELECT i, CASE i % 4 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END >> 11 AS bits FROM c10)"


_UNIFORM = f"{_philox_sql(42, 1000)} SELECT i AS id, bits::DOUBLE * {_d(2.0**-53)} AS u FROM w"


@query(_UNIFORM)
def philox_uniform(spark, d):
    return philox.with_draws(spark.range(1000), "id", 42, "uniform", name="u")


@query(f"{_philox_sql(42, 1000)} SELECT i AS id, CASE WHEN bits::DOUBLE * {_d(2.0**-53)} < 0.5 THEN -1e0 ELSE 1e0 END AS z FROM w")
def philox_rademacher(spark, d):
    return philox.with_draws(spark.range(1000), "id", 42, "rademacher", name="z")


@query(f"{_philox_sql(7, 4000)} SELECT i - 3000 AS id, 2e0 + 3e0 * (bits::DOUBLE * {_d(2.0**-53)}) AS u FROM w WHERE i >= 3000")
def philox_offsets(spark, d):
    """Uniform numbers of [2, 5) at stream positions from 3000 on."""
    return philox.with_draws(spark.range(1000), "id", 7, "uniform", 3000, "u").select("id", (2.0 + 3.0 * F.col("u")).alias("u"))


# Impulse responses and lattices.

_GRID = "SELECT id, id % 20 AS x, id // 20 AS y FROM range(400) r(id)"
_H3 = f"SELECT a.id AS i, b.id AS j, exp(-sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS v FROM ({_GRID}) a JOIN ({_GRID}) b ON (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 < 9"
_COLOR = "SELECT id AS j, (id % 20 % 5) + 5 * (id // 20 % 5) AS color FROM range(400) r(id)"


def _operator(spark):
    grid = spark.range(400).select(F.col("id").alias("i"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    return applied.within_reach(grid, grid, 3.0).select("i", "j", F.exp(-F.col("distance")).alias("v"))


def _colors(spark):
    return spark.range(400).select(F.col("id").alias("j"), (F.col("id") % 20 % 5 + 5 * (F.floor(F.col("id") / 20) % 5)).alias("color"))


_COMBS = f"SELECT h.i, c.color, sum(h.v) AS v FROM ({_H3}) h JOIN ({_COLOR}) c ON c.j = h.j GROUP BY 1, 2"


@query(f"SELECT i, color, round(v, 9) AS v FROM ({_COMBS})")
def comb_products(spark, d):
    return _r(applied.comb_products(_operator(spark), _colors(spark)), 9, "v")


@query(f"SELECT s.j AS k, m.i % 20 - s.j % 20 AS a, m.i // 20 - s.j // 20 AS b, round(m.v, 9) AS v FROM ({_COMBS}) m JOIN ({_COLOR}) s ON s.color = m.color WHERE abs(m.i % 20 - s.j % 20) <= 2 AND abs(m.i // 20 - s.j // 20) <= 2")
def impulse_windows(spark, d):
    responses = applied.comb_products(_operator(spark), _colors(spark)).select("color", (F.col("i") % 20).alias("x"), F.floor(F.col("i") / 20).alias("y"), "v")
    samples = _colors(spark).select(F.col("j").alias("k"), "color", (F.col("j") % 20).alias("px"), F.floor(F.col("j") / 20).alias("py"))
    return _r(applied.impulse_windows(responses, samples, 2), 9, "v")


def _kernels(spark):
    return spark.createDataFrame([(k, a, b, w / (k + 1) + (0.3 * k if a == b == 0 else 0.0)) for k in range(2) for (a, b), w in BLUR.items()], "k int, a int, b int, w double")


_KER = " UNION ALL ".join(f"SELECT {k} AS k, {a} AS a, {b} AS b, {_d(w / (k + 1) + (0.3 * k if a == b == 0 else 0.0))} AS w" for k in range(2) for (a, b), w in BLUR.items())
_SYMBOL = f"SELECT k, f.f, g.g, sum(w * cos(2 * pi() / 8 * (f.f * a + g.g * b))) AS s FROM ({_KER}) CROSS JOIN range(8) f(f) CROSS JOIN range(8) g(g) GROUP BY 1, 2, 3"


@query(f"SELECT k::INT AS k, f::INT AS f, g::INT AS g, round(s, 10) + 0.0 AS s FROM ({_SYMBOL})")
def kernel_symbol(spark, d):
    return applied.kernel_symbol(_kernels(spark), 8).select("k", "f", "g", (F.round("s", 10) + 0.0).alias("s"))


@query(f"SELECT k::INT AS k, a.a::INT AS a, b.b::INT AS b, round(sum(sqrt(greatest(s, 0)) * cos(2 * pi() / 8 * (f * a.a + g * b.b))) / 64, 7) + 0.0 AS w FROM ({_SYMBOL}) CROSS JOIN range(-3, 4) a(a) CROSS JOIN range(-3, 4) b(b) GROUP BY 1, 2, 3")
def sqrt_kernels(spark, d):
    return applied.sqrt_kernels(_kernels(spark), 8, 3).select("k", "a", "b", (F.round("w", 7) + 0.0).alias("w"))


@query(f"SELECT x, y, round(sum(CASE WHEN k = 0 THEN x / 19e0 ELSE 1 - x / 19e0 END * v), 9) AS v FROM (SELECT n.k, f.x + n.a AS x, f.y + n.b AS y, f.v * n.w AS v FROM ({_LATTICE}) f CROSS JOIN ({_KER}) n) WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 19 GROUP BY 1, 2")
def blended_convolution(spark, d):
    field = _lattice(spark)
    one = F.col("x") / 19.0
    weights = field.select("x", "y", F.explode(F.array(F.struct(F.lit(0).alias("k"), one.alias("g")), F.struct(F.lit(1).alias("k"), (1 - one).alias("g")))).alias("s")).select("s.k", "x", "y", "s.g")
    return _r(applied.blended_convolution(field, _kernels(spark), weights), 9, "v")


@query(f"SELECT b.bx, b.by, f.x, f.y, f.v, f.x // 5 = b.bx AND f.y // 5 = b.by AS own FROM ({_LATTICE}) f JOIN (SELECT p.p AS bx, q.q AS by FROM range(4) p(p) CROSS JOIN range(4) q(q)) b ON f.x BETWEEN 5 * b.bx - 2 AND 5 * b.bx + 6 AND f.y BETWEEN 5 * b.by - 2 AND 5 * b.by + 6")
def halo_rows(spark, d):
    return applied.halo_rows(_lattice(spark), 5, 2)


_ONE = "CASE WHEN {x} = 0 THEN 2e0 / 3 ELSE 1e0 / 6 END"
_TWO = "CASE WHEN {x} = 0 THEN 50e0 ELSE -25e0 END"


def _stencil_sql() -> str:
    m, k = ({c: f.format(x=f"{c}.{c}") for c in "abc"} for f in (_ONE, _TWO))
    terms = " + ".join(" * ".join(f"({k[c] if c == w else m[c]})" for c in "abc") for w in "abc")
    return f"SELECT a.a::INT AS a, b.b::INT AS b, c.c::INT AS c, round(0.7e0 * ({terms}) + 2e0 * {' * '.join(f'({m[c]})' for c in 'abc')}, 9) AS weight FROM range(-1, 2) a(a) CROSS JOIN range(-1, 2) b(b) CROSS JOIN range(-1, 2) c(c)"


@query(_stencil_sql())
def bilaplacian_stencil(spark, d):
    rows = applied.bilaplacian_stencil(0.2, 0.7, 2.0)
    return spark.createDataFrame([(a, b, c, round(w, 9)) for a, b, c, w in rows], "a int, b int, c int, weight double")


@query("SELECT id, CASE WHEN d <= 10 THEN 1e0 WHEN d >= 20 THEN 0e0 ELSE round(0.5 * (1 + cos(pi() * (d - 10) / 10)), 10) END AS w FROM (SELECT id, id * 0.4e0 AS d FROM range(64) r(id))")
def cut_window(spark, d):
    return spark.range(64).select("id", F.round(applied.cut_window(F.col("id") * 0.4, 20.0), 10).alias("w"))


@query("SELECT id, round(ln(CASE WHEN t < 263.15 THEN 3.61e-13 * exp(-6.0e4 / (8.314 * t)) ELSE 1.73e3 * exp(-13.9e4 / (8.314 * t)) END), 9) AS la FROM (SELECT id, least(greatest(190 + 1.5e0 * id, 200), 273.15e0) AS t FROM range(64) r(id))")
def rate_factor(spark, d):
    return spark.range(64).select("id", F.round(F.ln(applied.rate_factor(190 + 1.5 * F.col("id"))), 9).alias("la"))

