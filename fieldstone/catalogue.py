"""Registered queries of the engine's own operators, with their DuckDB counterparts.

Readings of the tables: lineitem is a sparse matrix (part x supplier) with repeated entries, customer and supplier
balances are vectors, embeddings a multivector, events chains and trajectories, orders observations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.functions import applied, philox
from fieldstone.operators import diagnostics as dg
from fieldstone.operators import krylov, randomized
from fieldstone.operators import matrix as mx
from fieldstone.operators import misfits as mf
from fieldstone.operators import vector as vec
from fieldstone.shared import written
from fieldstone.sources import mesh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
N = 16  # cells per side of the generated square


def _d(x: float) -> str:
    """A DOUBLE literal of DuckDB, which reads numbers without an exponent as decimals."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _matrix(spark: SparkSession, d: str, value: str | Column = "l_quantity") -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), v.alias("v"))


def _supplier(spark: SparkSession, d: str) -> DataFrame:
    return vec.from_columns(_t(spark, d, "supplier"), "s_suppkey", "s_acctbal")


def _customer(spark: SparkSession, d: str) -> DataFrame:
    return vec.from_columns(_t(spark, d, "customer"), "c_custkey", "c_acctbal")


K = 64  # components of an embedding


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


# Vectors.

_X = "SELECT s_suppkey AS i, s_acctbal AS v FROM supplier"
_Y = "SELECT c_custkey AS i, c_acctbal AS v FROM customer"


@query(f"SELECT i, round(sum(v), 4) AS v FROM (SELECT i, v FROM ({_X}) UNION ALL SELECT i, 0.5 * v FROM ({_Y})) GROUP BY i")
def vec_axpy(spark, d):
    return _r(vec.axpy(_supplier(spark, d), 0.5, _customer(spark, d)), 4, "v")


@query(f"SELECT i, round(sum(v), 4) AS v FROM (SELECT i, 2 * v AS v FROM ({_X}) UNION ALL SELECT i, v FROM ({_Y})) GROUP BY i")
def vec_aypx(spark, d):
    return _r(vec.aypx(_supplier(spark, d), 2.0, _customer(spark, d)), 4, "v")


@query(f"SELECT a.i, round(a.v * b.v, 3) AS v FROM ({_X}) a JOIN ({_Y}) b ON a.i = b.i")
def vec_pointwise(spark, d):
    return _r(vec.pointwise_mult(_supplier(spark, d), _customer(spark, d)), 3, "v")


@query(f"SELECT round(sum(a.v * b.v), 2) AS \"inner\" FROM ({_X}) a JOIN ({_Y}) b ON a.i = b.i")
def vec_inner(spark, d):
    return _r(vec.inner(_supplier(spark, d), _customer(spark, d)), 2, "inner")


@query(f"SELECT round(sum(abs(v)), 3) AS l1, round(sqrt(sum(v * v)), 5) AS l2, max(abs(v)) AS linf, round(sum(v), 3) AS total, max(v) AS largest, min(v) AS least FROM ({_Y})")
def vec_norms(spark, d):
    return _r(_r(vec.norms(_customer(spark, d)), 3, "l1", "total"), 5, "l2")


_CHECKED = "SELECT 'balance' AS what, c_acctbal AS v FROM customer UNION ALL SELECT 'gaps', CASE WHEN c_acctbal < 0 THEN 'nan'::DOUBLE ELSE c_acctbal END FROM customer UNION ALL SELECT 'nothing', 0 * c_acctbal FROM customer UNION ALL SELECT 'beyond', CASE WHEN c_custkey = 7 THEN 'inf'::DOUBLE ELSE 0 END FROM customer"


@query(f"SELECT what, bool_and(isfinite(v)) AS finite, bool_or(v != 0) AS nonzero FROM ({_CHECKED}) GROUP BY what")
def vec_checks(spark, d):
    x, v = _customer(spark, d), F.col("v")
    cases = {"balance": v, "gaps": F.when(v < 0, float("nan")).otherwise(v), "nothing": 0 * v, "beyond": F.when(F.col("i") == 7, float("inf")).otherwise(0.0)}
    out = None
    for what, value in cases.items():
        y = x.select("i", value.alias("v"))
        row = vec.all_finite(y).unionByName(vec.any_nonzero(y), allowMissingColumns=True).agg(F.bool_or("finite").alias("finite"), F.bool_or("nonzero").alias("nonzero")).select(F.lit(what).alias("what"), "finite", "nonzero")
        out = row if out is None else out.unionByName(row)
    return out


# Matrices.

_A = "SELECT l_partkey AS i, l_suppkey AS j, l_quantity AS v FROM lineitem"
_A1 = "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
_ATA = f"SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM ({_A1}) a JOIN ({_A1}) b ON a.i = b.i GROUP BY 1, 2"


@query(f"SELECT a.i, round(sum(a.v * x.v), 4) AS v FROM ({_A}) a JOIN ({_X}) x ON a.j = x.i GROUP BY a.i")
def spmv(spark, d):
    return _r(mx.spmv(_matrix(spark, d), _supplier(spark, d)), 4, "v")


@query(f"SELECT a.j AS i, round(sum(a.v * p.p_retailprice), 3) AS v FROM ({_A}) a JOIN part p ON a.i = p.p_partkey GROUP BY a.j")
def spmv_transpose(spark, d):
    return _r(mx.spmv_transpose(_matrix(spark, d), vec.from_columns(_t(spark, d, "part"), "p_partkey", "p_retailprice")), 3, "v")


@query(f"SELECT i, sum(v) AS v FROM ({_A}) GROUP BY i")
def rowsum_lumped(spark, d):
    return mx.row_sums(_matrix(spark, d))


@query(f"SELECT a.i, round(p.p_retailprice / sum(a.v), 8) AS v FROM ({_A}) a JOIN part p ON a.i = p.p_partkey GROUP BY a.i, p.p_retailprice")
def lumped_solve(spark, d):
    return _r(mx.lumped_solve(_matrix(spark, d), vec.from_columns(_t(spark, d, "part"), "p_partkey", "p_retailprice")), 8, "v")


@query(f"SELECT a.i, round(sum(a.v * x.v), 4) AS x0, sum(a.v) AS x1 FROM ({_A}) a JOIN ({_X}) x ON a.j = x.i GROUP BY a.i")
def spmm(spark, d):
    x = _supplier(spark, d).select("i", F.array("v", F.lit(1.0)).alias("x"))
    return mx.spmm(_matrix(spark, d), x, 2).select("i", F.round(F.col("x")[0], 4).alias("x0"), F.col("x")[1].alias("x1"))


@query(f"SELECT a.i, a.j, round(a.v * p.p_retailprice, 3) AS v FROM ({_A1}) a JOIN part p ON a.i = p.p_partkey")
def diag_scale(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    return _r(mx.diag_scale(vec.from_columns(_t(spark, d, "part"), "p_partkey", "p_retailprice"), a), 3, "v")


@query("SELECT l_partkey AS i, l_suppkey AS j, round(sum(l_quantity - 2 * l_discount), 4) AS v FROM lineitem GROUP BY 1, 2")
def mat_add(spark, d):
    return _r(mx.add(_matrix(spark, d), _matrix(spark, d, "l_discount"), 1.0, -2.0), 4, "v")


@query(_ATA)
def mat_atb(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    return mx.mat_atb(a, a)


@query(f"SELECT p.s_nationkey::BIGINT AS i, q.s_nationkey::BIGINT AS j, sum(m.v) AS v FROM ({_ATA}) m JOIN supplier p ON m.i = p.s_suppkey JOIN supplier q ON m.j = q.s_suppkey GROUP BY 1, 2")
def triple_product(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    p = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("bigint").alias("j"), F.lit(1.0).alias("v"))
    return mx.ptap(mx.mat_atb(a, a), p)


@query(f"SELECT i, v FROM ({_ATA}) WHERE i = j")
def mat_diag(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    return mx.diagonal(mx.mat_atb(a, a))


@query(f"SELECT sum(v) AS trace FROM ({_ATA}) WHERE i = j")
def mat_trace(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    return mx.trace(mx.mat_atb(a, a))


@query(f"SELECT i, j, CASE WHEN i = j AND i % 3 = 0 THEN 1.0 ELSE v END AS v FROM ({_ATA})")
def set_diag(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    return mx.set_diagonal(mx.mat_atb(a, a), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("i")).filter("i % 3 = 0"), 1.0)


@query(f"SELECT s_suppkey AS i FROM supplier WHERE s_suppkey NOT IN (SELECT i FROM ({_A}) WHERE i = j)")
def missing_diagonals(spark, d):
    return mx.missing_diagonals(_matrix(spark, d), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("i")))


@query(f"SELECT max(abs(v)) AS defect FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM ({_A}) UNION ALL SELECT j, i, -v FROM ({_A})) GROUP BY 1, 2)")
def sym_defect(spark, d):
    return mx.symmetry_defect(_matrix(spark, d))


@query("SELECT DISTINCT l_partkey AS i, l_suppkey AS j FROM lineitem")
def pattern_distinct(spark, d):
    return mx.pattern(_matrix(spark, d))


@query("SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i = j THEN 0 ELSE 1 END, j) - 1 AS slot FROM (SELECT DISTINCT l_partkey AS i, l_suppkey AS j FROM lineitem)")
def pattern_csr(spark, d):
    return mx.pattern_csr(_matrix(spark, d))


@query(_A1)
def scatter_add(spark, d):
    return mx.scatter_add(_matrix(spark, d))


@query("SELECT l_returnflag AS block, l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3")
def scatter_fused_blocks(spark, d):
    return mx.scatter_blocks(_t(spark, d, "lineitem").select(F.col("l_returnflag").alias("block"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v")))


@query(f"SELECT 'A' AS block, i, j, v FROM ({_A1}) UNION ALL SELECT 'At', j, i, v FROM ({_A1})")
def scatter_derived(spark, d):
    return mx.scatter_derived(_matrix(spark, d))


_IDS = "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0"


def _eliminated(spark, d, diag):
    return mx.eliminate_atb(mx.scatter_add(_matrix(spark, d)), _t(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("i")), diag)


_REST = f"SELECT i, j, v FROM ({_ATA}) WHERE i NOT IN ({_IDS}) AND j NOT IN ({_IDS})"


@query(f"{_REST} UNION ALL SELECT s_suppkey, s_suppkey, 1.0 FROM supplier WHERE s_acctbal < 0")
def eliminate_one(spark, d):
    return _eliminated(spark, d, "one")


@query(_REST)
def eliminate_zero(spark, d):
    return _eliminated(spark, d, "zero")


@query(f"{_REST} UNION ALL SELECT i, j, v FROM ({_ATA}) WHERE i = j AND i IN ({_IDS})")
def eliminate_keep(spark, d):
    return _eliminated(spark, d, "keep")


@query(f"SELECT i, j, v FROM ({_A1}) WHERE i IN ({_IDS}) OR j IN ({_IDS})")
def masked_slots(spark, d):
    return mx.masked_slots(mx.scatter_add(_matrix(spark, d)), _t(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("i"))).select("i", "j", "v")


@query("SELECT s_suppkey AS i, CASE WHEN s_nationkey < 5 THEN s_nationkey::DOUBLE ELSE s_acctbal END AS v FROM supplier")
def apply_essential(spark, d):
    ess = _t(spark, d, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("value"))
    return mx.apply_essential(_supplier(spark, d), ess)


@query("SELECT s_suppkey AS i, CASE WHEN s_nationkey >= 20 THEN 1.0 ELSE s_nationkey END::DOUBLE AS value FROM supplier WHERE s_nationkey < 5 OR s_nationkey >= 20")
def union_conditions(spark, d):
    s = _t(spark, d, "supplier")
    a = s.filter("s_nationkey < 5").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("value"))
    return mx.union_conditions(a, s.filter("s_nationkey >= 20").select(F.col("s_suppkey").alias("i"), F.lit(1.0).alias("value")))


@query("SELECT l_partkey AS i, round(sum(l_extendedprice - CAST(l_extendedprice AS FLOAT)::DOUBLE), 7) AS v FROM lineitem GROUP BY 1")
def row_defect(spark, d):
    return _r(mx.row_defect(_matrix(spark, d, "l_extendedprice")), 7, "v")


@query("SELECT true AS same UNION ALL SELECT false")
def td_operator_change(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    changed = a.withColumn("v", F.col("v") * F.when(F.col("j") == 3, 1.001).otherwise(1.0))
    x = _supplier(spark, d)
    return mx.operators_equal(a, a, x).unionByName(mx.operators_equal(a, changed, x))


# Multivectors and low rank.


def _mv_sql() -> str:
    return f"SELECT vec_id AS i, u.k AS k, embedding[u.k + 1]::DOUBLE AS a FROM embeddings CROSS JOIN range({K}) u(k)"


@query(f"SELECT p.k::INT AS k, q.k::INT AS l, round(sum(p.a * q.a), 6) AS v FROM ({_mv_sql()}) p JOIN ({_mv_sql()}) q ON p.i = q.i GROUP BY 1, 2")
def mv_gram(spark, d):
    return _r(vec.gram(_embeddings(spark, d)), 6, "v")


@query(f"SELECT k::INT AS k, round(sqrt(sum(a * a)), 7) AS l2, max(abs(a)) AS linf FROM ({_mv_sql()}) GROUP BY 1")
def mv_norms(spark, d):
    return _r(vec.mv_norms(_embeddings(spark, d)), 7, "l2")


@query(f"SELECT p.k::INT AS k, round(sum(p.a * x.v), 3) AS v FROM ({_mv_sql()}) p JOIN ({_Y}) x ON p.i = x.i GROUP BY 1")
def mv_dot_v(spark, d):
    return _r(vec.dot_v(_embeddings(spark, d), _customer(spark, d)), 3, "v")


@query(f"SELECT i, round(sum(a * (k + 1)), 7) AS v FROM ({_mv_sql()}) GROUP BY i")
def mv_reduce(spark, d):
    return _r(vec.reduce(_embeddings(spark, d), range(1, K + 1)), 7, "v")


@query(f"SELECT i, round(sum(a * (k + 1)), 7) AS y0, round(sum(a * (k - 2.5)), 7) AS y1 FROM ({_mv_sql()}) GROUP BY i")
def mv_small_mult(spark, d):
    y = vec.small_mult(_embeddings(spark, d), [[k + 1, k - 2.5] for k in range(K)])
    return y.select("i", F.round(F.col("x")[0], 7).alias("y0"), F.round(F.col("x")[1], 7).alias("y1"))


_SPECTRUM = range(K, 0, -1)


@query(f"WITH u AS ({_mv_sql()}), w AS (SELECT k, ({K} - k) * sum(a * v) AS w FROM u JOIN ({_Y}) x ON u.i = x.i GROUP BY k) SELECT i, round(sum(a * w), 0) AS v FROM u JOIN w USING (k) GROUP BY i")
def lowrank_apply(spark, d):
    return _r(mx.lowrank_apply(_embeddings(spark, d), _SPECTRUM, _customer(spark, d)), 0, "v")


@query(f"SELECT i, round(sum(a * a * ({K} - k)), 7) AS v FROM ({_mv_sql()}) GROUP BY i")
def lowrank_diag(spark, d):
    return _r(mx.lowrank_diag(_embeddings(spark, d), _SPECTRUM), 7, "v")


@query(f"SELECT round(sum(a * a * ({K} - k)), 6) AS trace FROM ({_mv_sql()})")
def lowrank_trace(spark, d):
    return _r(mx.lowrank_trace(_embeddings(spark, d), _SPECTRUM), 6, "trace")


# Meshes, assembly, observation.

_M = N + 1
_TRI = (
    f"SELECT 2 * c.c + h.h AS e, (c.c // {N}) * {_M} + c.c % {N} AS a, (c.c // {N}) * {_M} + c.c % {N} + CASE WHEN h.h = 0 THEN 1 ELSE {_M + 1} END AS b, "
    f"(c.c // {N}) * {_M} + c.c % {N} + CASE WHEN h.h = 0 THEN {_M + 1} ELSE {_M} END AS d FROM range({N * N}) c(c) CROSS JOIN range(2) h(h)"
)
_LOC = f"SELECT e, 0 AS k, a AS i, b AS nx, d AS pv FROM ({_TRI}) UNION ALL SELECT e, 1, b, d, a FROM ({_TRI}) UNION ALL SELECT e, 2, d, a, b FROM ({_TRI})"
_GRAD = f"SELECT e, k, i, {N}e0 * (nx // {_M} - pv // {_M}) AS gx, {N}e0 * (pv % {_M} - nx % {_M}) AS gy FROM ({_LOC})"
_MID = f"SELECT e, avg((i % {_M}) / {N}e0) AS cx, avg((i // {_M}) / {N}e0) AS cy FROM ({_LOC}) GROUP BY e"


def _field() -> Column:
    mid = lambda c: (F.col(c)[0] + F.col(c)[1] + F.col(c)[2]) / 3
    return F.exp(F.sin(F.lit(3.141592653589793) * mid("x")) * F.sin(F.lit(3.141592653589793) * mid("y")))


@query(f"SELECT v AS vid, (v % {_M}) / {N}e0 AS x, (v // {_M}) / {N}e0 AS y FROM range({_M * _M}) r(v)")
def mesh_vertices(spark, d):
    return mesh.vertices(spark, N)


@query(f"SELECT e, k::INT AS a, i FROM ({_LOC})")
def elem_dofs(spark, d):
    return mesh.elem_dofs(mesh.triangles(spark, N))


@query(
    f"SELECT p.i, q.i AS j, round(sum(exp(sin(pi() * cx) * sin(pi() * cy)) * (p.gx * q.gx + p.gy * q.gy) * {_d(0.5 / N / N)}), 9) + 0.0 AS v "
    f"FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e JOIN ({_MID}) m ON m.e = p.e GROUP BY 1, 2"
)
def p1_stiffness(spark, d):
    return mx.scatter_add(mesh.stiffness_entries(mesh.triangles(spark, N), _field())).select("i", "j", (F.round("v", 9) + 0.0).alias("v"))


@query(f"SELECT p.i, q.i AS j, round(sum(CASE WHEN p.k = q.k THEN {_d(1 / 6 * 0.5 / N / N)} ELSE {_d(1 / 12 * 0.5 / N / N)} END), 12) AS v FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e GROUP BY 1, 2")
def p1_mass(spark, d):
    return _r(mx.scatter_add(mesh.mass_entries(mesh.triangles(spark, N))), 12, "v")


@query(f"SELECT i, round(sum(cx * cy * {_d(0.5 / N / N / 3)}), 12) AS v FROM ({_LOC}) JOIN ({_MID}) USING (e) GROUP BY i")
def p1_load(spark, d):
    mid = lambda c: (F.col(c)[0] + F.col(c)[1] + F.col(c)[2]) / 3
    return _r(mx.scatter_vector(mesh.load_entries(mesh.triangles(spark, N), mid("x") * mid("y"))), 12, "v")


_BDR = (
    f"SELECT b, (b // {N} + 1)::INT AS attr, CASE b // {N} WHEN 0 THEN b % {N} WHEN 1 THEN (b % {N}) * {_M} + {N} WHEN 2 THEN {N * _M} + b % {N} ELSE (b % {N}) * {_M} END AS v0, "
    f"CASE b // {N} WHEN 0 THEN b % {N} + 1 WHEN 1 THEN (b % {N} + 1) * {_M} + {N} WHEN 2 THEN {N * _M} + b % {N} + 1 ELSE (b % {N} + 1) * {_M} END AS v1, {_d(1 / N)} AS length FROM range({4 * N}) r(b)"
)


@query(_BDR)
def mesh_boundary(spark, d):
    return mesh.boundary(spark, N)


@query(f"WITH x AS (SELECT b, 0 AS a, v0 AS i FROM ({_BDR}) UNION ALL SELECT b, 1, v1 FROM ({_BDR})) SELECT p.i, q.i AS j, round(sum({_d(1 / N)} / CASE WHEN p.a = q.a THEN 3e0 ELSE 6e0 END), 12) AS v FROM x p JOIN x q ON p.b = q.b GROUP BY 1, 2")
def p1_boundary_mass(spark, d):
    return _r(mx.scatter_add(mesh.boundary_mass_entries(mesh.boundary(spark, N))), 12, "v")


@query(f"SELECT DISTINCT unnest([v0, v1]) AS i FROM ({_BDR}) WHERE attr IN (1, 3)")
def essential_dofs(spark, d):
    return mesh.essential_indices(mesh.boundary(spark, N), [1, 3])


_EDGE = f"SELECT e, least(i, nx) AS v0, greatest(i, nx) AS v1 FROM ({_LOC})"
_FACETS = f"SELECT v0, v1, min(e) AS minus, max(e) AS plus FROM ({_EDGE}) GROUP BY 1, 2 HAVING count(*) = 2"


@query(_FACETS)
def interior_facets(spark, d):
    return mesh.interior_facets(mesh.triangles(spark, N))


@query(f"SELECT f.v0, f.v1, round(a.cx * a.cy - b.cx * b.cy, 10) AS jump, round((a.cx * a.cy + b.cx * b.cy) / 2, 10) AS avg FROM ({_FACETS}) f JOIN ({_MID}) a ON a.e = f.minus JOIN ({_MID}) b ON b.e = f.plus")
def facet_jump(spark, d):
    t = mesh.triangles(spark, N)
    mid = lambda c: (F.col(c)[0] + F.col(c)[1] + F.col(c)[2]) / 3
    w = t.select("e", (mid("x") * mid("y")).alias("w"))
    sides = mesh.interior_facets(t).join(w.select(F.col("e").alias("minus"), F.col("w").alias("m")), "minus").join(w.select(F.col("e").alias("plus"), F.col("w").alias("p")), "plus")
    return sides.select("v0", "v1", F.round(F.col("m") - F.col("p"), 10).alias("jump"), F.round((F.col("m") + F.col("p")) / 2, 10).alias("avg"))


_PTS = "SELECT t, 0.013 + (t * 37 % 97) / 100e0 AS x, 0.017 + (t * 53 % 89) / 93e0 AS y FROM range(200) r(t)"
_LAM = (
    f"SELECT t, e, {N}e0 * y - {N}e0 * x AS s, x, y, e // 2 AS c FROM ({_PTS}) JOIN (SELECT 2 * c.c + h.h AS e FROM range({N * N}) c(c) CROSS JOIN range(2) h(h)) "
    f"ON e // 2 = CAST(floor(y * {N}) AS BIGINT) * {N} + CAST(floor(x * {N}) AS BIGINT)"
)
_IN = f"SELECT t, min(e) AS e FROM (SELECT t, e, {N} * x - c % {N} AS u, {N} * y - c // {N} AS w FROM ({_LAM})) WHERE (e % 2 = 0 AND u >= w) OR (e % 2 = 1 AND u <= w) GROUP BY t"


def _points(spark):
    t = F.col("id")
    return spark.range(200).select(t.alias("t"), (0.013 + (t * 37 % 97) / 100.0).alias("x"), (0.017 + (t * 53 % 89) / 93.0).alias("y"))


@query(_IN)
def point_location(spark, d):
    return mesh.locate(_points(spark), mesh.triangles(spark, N), N).select("t", "e")


@query(f"SELECT t AS i, round(3 * x - 2 * y, 9) AS v FROM ({_PTS})")
def pointwise_obs(spark, d):
    b = mesh.observation_matrix(_points(spark), mesh.triangles(spark, N), N)
    u = mesh.vertices(spark, N).select(F.col("vid").alias("i"), (3 * F.col("x") - 2 * F.col("y")).alias("v"))
    return _r(mx.spmv(b, u), 9, "v")


@query("SELECT c AS e, [b, b + 1, b + 8, b + 7, b + 49, b + 50, b + 57, b + 56] AS v FROM (SELECT c, (c // 36) * 49 + (c // 6 % 6) * 7 + c % 6 AS b FROM range(216) r(c))")
def box_mesh(spark, d):
    return mesh.box(spark, 6)


# Misfits and quantities of interest.

_OBS = "SELECT o_orderkey AS t, o_totalprice AS bu, 1.1 * o_totalprice + (o_orderkey % 7) AS d, c_nationkey::BIGINT AS experiment FROM orders JOIN customer ON o_custkey = c_custkey"


def _obs(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("bu"), (1.1 * F.col("o_totalprice") + F.col("o_orderkey") % 7).alias("d"), F.col("c_nationkey").cast("bigint").alias("experiment")
    )


@query(f"SELECT round(sum((bu - d) * (bu - d)) / 2e8, 3) AS cost FROM ({_OBS})")
def gauss_misfit(spark, d):
    return _r(mf.gauss_cost(_obs(spark, d), 1e8), 3, "cost")


@query(f"SELECT t, round((bu - d) / 1e3, 6) AS v FROM ({_OBS})")
def gauss_misfit_grad(spark, d):
    return _r(mf.gauss_residual(_obs(spark, d), 1e3), 6, "v")


@query(f"SELECT round(4 * sum(ln(bu) + d / bu), 3) AS cost FROM ({_OBS})")
def gamma_misfit(spark, d):
    return _r(mf.gamma_cost(_obs(spark, d), 4.0), 3, "cost")


@query(f"SELECT t, round(4e6 * (1 / bu - d / (bu * bu)), 6) AS v FROM ({_OBS})")
def gamma_misfit_grad(spark, d):
    return _r(mf.gamma_residual(_obs(spark, d), 4e6), 6, "v")


@query(f"SELECT t, round(4e6 * (-1 / (bu * bu) + 2 * d / (bu * bu * bu)) * (t % 5), 8) AS v FROM ({_OBS})")
def gamma_misfit_hess(spark, d):
    return _r(mf.gamma_hessian(_obs(spark, d).withColumn("du", (F.col("t") % 5).cast("double")), 4e6), 8, "v")


@query(f"SELECT experiment, round(sum((bu - d) * (bu - d)) / 2e8, 4) AS cost FROM ({_OBS}) GROUP BY 1")
def multi_state_misfit(spark, d):
    return _r(mf.per_experiment(_obs(spark, d), 1e8), 4, "cost")


@query(f"SELECT round(sum(power((bu - d) / (100 + t % 9), 2)) / 2, 1) AS cost FROM ({_OBS})")
def weighted_misfit(spark, d):
    return _r(mf.weighted_cost(_obs(spark, d).withColumn("sigma", (100 + F.col("t") % 9).cast("double"))), 1, "cost")


@query("SELECT round(0.01 * greatest(max(abs(s_acctbal)), 1e-30), 6) AS sigma FROM supplier")
def noise_level(spark, d):
    return _r(mf.observed_noise_level(_supplier(spark, d), 0.01), 6, "sigma")


@query("SELECT round(sum((o_orderkey % 10 + 1) * o_totalprice) / sum(o_orderkey % 10 + 1), 4) AS q FROM orders")
def weighted_mean(spark, d):
    o = _t(spark, d, "orders").withColumn("i", F.col("o_orderkey"))
    return _r(mf.weighted_mean_qoi(o.select("i", (F.col("i") % 10 + 1).cast("double").alias("v")), o.select("i", F.col("o_totalprice").alias("v"))), 4, "q")


@query(f"WITH m AS (SELECT p.i, q.i AS j, sum(CASE WHEN p.k = q.k THEN {_d(1 / 6 * 0.5 / N / N)} ELSE {_d(1 / 12 * 0.5 / N / N)} END) AS v FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e GROUP BY 1, 2) SELECT round(0.5 * sum(v * (i % 7) * (j % 7)), 9) AS q FROM m")
def l2_qoi(spark, d):
    u = mesh.vertices(spark, N).select(F.col("vid").alias("i"), (F.col("vid") % 7).cast("double").alias("v"))
    return _r(mf.quadratic_qoi(mx.spmv(mx.scatter_add(mesh.mass_entries(mesh.triangles(spark, N))), u), u), 9, "q")


@query(f"WITH m AS (SELECT i, sum({_d(1 / 3 * 0.5 / N / N)}) AS w FROM ({_LOC}) GROUP BY 1) SELECT round(sum(w * (i % 7)) / sum(w), 9) AS q FROM m")
def mean_state(spark, d):
    u = mesh.vertices(spark, N).select(F.col("vid").alias("i"), (F.col("vid") % 7).cast("double").alias("v"))
    return _r(mf.weighted_mean_qoi(mx.row_sums(mx.scatter_add(mesh.mass_entries(mesh.triangles(spark, N)))), u), 9, "q")


# Trajectories.

_TD = "SELECT (epoch_us(ts) // 3600000000)::BIGINT AS k, user_id AS i, sum(value) AS v FROM events GROUP BY 1, 2"


def _trajectory(spark, d):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("bigint")
    return _t(spark, d, "events").groupBy(hour.alias("k"), F.col("user_id").alias("i")).agg(F.sum("value").alias("v"))


@query(f"SELECT round(max(n), 5) AS norm FROM (SELECT sqrt(sum(v * v)) AS n FROM ({_TD}) GROUP BY k)")
def td_norms(spark, d):
    return _r(vec.td_norm(_trajectory(spark, d)), 5, "norm")


@query(f"SELECT a.k, round(sum(a.v * b.v * 0.5), 6) AS \"inner\" FROM ({_TD}) a JOIN ({_TD}) b ON a.k = b.k AND a.i = b.i GROUP BY a.k")
def td_inner_by_level(spark, d):
    x = _trajectory(spark, d)
    return _r(vec.td_inner_by_level(x, x.withColumn("v", 0.5 * F.col("v"))), 6, "inner")


@query(f"SELECT k, i, round(3 * v, 5) AS v FROM ({_TD})")
def td_axpy(spark, d):
    x = _trajectory(spark, d)
    return _r(vec.td_axpy(x, 2.0, x), 5, "v")


@query("SELECT r.t / 4e0 AS t, min_by(k.k, abs(k.k * 0.7 - r.t / 4e0)) AS k FROM range(40) r(t) JOIN range(20) k(k) ON abs(k.k * 0.7 - r.t / 4e0) <= 0.31 GROUP BY 1")
def td_nearest_level(spark, d):
    levels = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 0.7).alias("t"))
    return vec.td_index(levels, spark.range(40).select((F.col("id") / 4.0).alias("t")), 0.31)


# Chains and slopes.

_CHAIN = "SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, value AS q FROM events"
_ACF = (
    f"WITH c AS ({_CHAIN}), x AS (SELECT key, k, q - avg(q) OVER (PARTITION BY key) AS d, count(*) OVER (PARTITION BY key) AS n FROM c), "
    "lags AS (SELECT key, n, unnest(range(least(n - 1, greatest(10, n // 10)) + 1)) AS lag FROM (SELECT key, count(*) AS n FROM c GROUP BY key)), "
    "r AS (SELECT l.key, l.lag, sum(a.d * b.d) / any_value(l.n) AS c FROM lags l JOIN x a ON a.key = l.key JOIN x b ON b.key = l.key AND b.k = a.k + l.lag GROUP BY 1, 2), "
    "rho AS (SELECT r.key, r.lag, r.c / z.c AS rho FROM r JOIN r z ON z.key = r.key AND z.lag = 0)"
)


def _chain(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return _t(spark, d, "events").select(F.col("event_type").alias("key"), (F.row_number().over(w).cast("bigint") - 1).alias("k"), F.col("value").alias("q"))


@query(f"{_ACF} SELECT key, lag, round(rho, 9) AS rho FROM rho")
def acf_by_key(spark, d):
    return _r(dg.autocorrelation(_chain(spark, d)), 9, "rho")


_IACT = "i AS (SELECT key, 1 + 2 * sum(CASE WHEN ok THEN rho ELSE 0 END) AS iact FROM (SELECT *, bool_and(rho >= 0) OVER (PARTITION BY key ORDER BY lag) AS ok FROM rho WHERE lag > 0) GROUP BY key)"


@query(f"{_ACF}, {_IACT} SELECT key, round(iact, 8) AS iact FROM i")
def iact_by_key(spark, d):
    return _r(dg.iact(dg.autocorrelation(_chain(spark, d))), 8, "iact")


@query(f"{_ACF}, {_IACT} SELECT key, count(*) AS n, round(avg(q), 7) AS mean, round(stddev_samp(q), 7) AS std, round(any_value(iact), 7) AS iact, round(count(*) / any_value(iact), 5) AS ess, round(stddev_samp(q) / sqrt(count(*) / any_value(iact)), 7) AS mcse FROM c JOIN i USING (key) GROUP BY key")
def chain_summary(spark, d):
    return _r(_r(dg.chain_summary(_chain(spark, d)), 7, "mean", "std", "iact", "mcse"), 5, "ess")


@query("SELECT event_id, round(exp(-value / 100 - m) / sum(exp(-value / 100 - m)) OVER (PARTITION BY event_type), 12) AS weight FROM (SELECT *, max(-value / 100) OVER (PARTITION BY event_type) AS m FROM events)")
def is_weights(spark, d):
    s = _t(spark, d, "events").select("event_id", F.col("event_type").alias("key"), (-F.col("value") / 100).alias("logw"))
    return dg.importance_weights(s).select("event_id", F.round("weight", 12).alias("weight"))


@query("SELECT event_type AS key, count(*) AS n, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS accepted FROM events GROUP BY 1")
def accept_rate(spark, d):
    return _t(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 100).cast("bigint")).alias("accepted"))


_EPS = "SELECT key, exp(-0.5e0 * s * ln(10e0)) AS eps, (key + 1) * exp(-0.5e0 * s * ln(10e0)) + CASE WHEN s = 9 THEN 1e-6 ELSE 0 END AS err FROM range(3) a(key) CROSS JOIN range(20) b(s)"


def _slopes(spark):
    from pyspark.sql import functions as F

    eps = F.exp(F.lit(-0.5) * F.col("s") * F.ln(F.lit(10.0)))
    rows = spark.range(60).select((F.col("id") % 3).alias("key"), F.floor(F.col("id") / 3).alias("s"))
    return rows.select("key", eps.alias("eps"), ((F.col("key") + 1) * eps + F.when(F.col("s") == 9, 1e-6).otherwise(0.0)).alias("err"))


_SLOPE = f"SELECT key, eps, ln(err / lead(err) OVER w) / ln(eps / lead(eps) OVER w) AS slope FROM ({_EPS}) WINDOW w AS (PARTITION BY key ORDER BY eps DESC)"


@query(f"SELECT key, round(log10(eps), 6) + 0.0 AS e, round(slope, 6) AS slope FROM ({_SLOPE})")
def fd_slopes(spark, d):
    return dg.fd_slopes(_slopes(spark)).select("key", (F.round(F.log10("eps"), 6) + 0.0).alias("e"), F.round("slope", 6).alias("slope"))


@query(f"SELECT key, round(median(slope), 6) AS slope FROM ({_SLOPE}) WHERE slope IS NOT NULL AND eps BETWEEN 1e-7 AND 1e-2 GROUP BY key")
def best_slope(spark, d):
    return _r(dg.best_slope(dg.fd_slopes(_slopes(spark))), 6, "slope")


_CV = "SELECT o_orderstatus AS key, o_totalprice AS q, 20 * c_acctbal AS t FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT key, round(avg(q), 5) AS mean_q, round(stddev_samp(q) / sqrt(count(*)), 6) AS err_q, round(avg(q - t), 5) AS mean_d, round(stddev_samp(q - t) / sqrt(count(*)), 6) AS err_d, round(power(stddev_samp(q) / stddev_samp(q - t), 2), 8) AS factor FROM ({_CV}) GROUP BY key")
def control_variate(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    s = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderstatus").alias("key"), F.col("o_totalprice").alias("q"), (20 * F.col("c_acctbal")).alias("t"))
    return _r(_r(_r(dg.control_variate(s), 5, "mean_q", "mean_d"), 6, "err_q", "err_d"), 8, "factor")


_SPEC = f"SELECT sqrt(sum(a * a)) AS d FROM ({_mv_sql()}) GROUP BY k"


@query(f"SELECT round(0.5 * sum(ln(1 + d)) - 0.5 * sum(d / (1 + d)), 8) AS kl FROM ({_SPEC})")
def kl_terms(spark, d):
    return _r(dg.kl_terms(vec.mv_norms(_embeddings(spark, d)).select(F.col("l2").alias("d"))), 8, "kl")


@query(f"SELECT round(0.5 * sum(d), 7) AS mean_part, round(0.5 * sum(d * d), 6) AS variance_part FROM ({_SPEC})")
def taylor_moments(spark, d):
    return _r(_r(dg.taylor_moments(vec.mv_norms(_embeddings(spark, d)).select(F.col("l2").alias("d"))), 7, "mean_part"), 6, "variance_part")


# Operators of the applications.


def _depths(spark):
    return spark.range(64).select(F.col("id"), (F.col("id") / 64.0).alias("x"))


@query("WITH n(xk, fk) AS (VALUES (0.1e0, 1e0), (0.4e0, 3e0), (0.8e0, 2e0)) SELECT r.id, round(sum(exp(-power((r.id / 64e0 - xk) / 0.2, 2)) * fk) / sum(exp(-power((r.id / 64e0 - xk) / 0.2, 2))), 9) AS v FROM range(64) r(id) CROSS JOIN n GROUP BY r.id")
def density_lookup(spark, d):
    return _depths(spark).select("id", F.round(applied.kernel_lookup(F.col("x"), [(0.1, 1.0), (0.4, 3.0), (0.8, 2.0)], 0.2), 9).alias("v"))


@query("SELECT id, CASE WHEN id / 64e0 < 0.25 THEN 0 WHEN id / 64e0 < 0.5 THEN 1 ELSE 2 END::INT AS layer FROM range(64) r(id)")
def piecewise_class(spark, d):
    return _depths(spark).select("id", applied.piecewise_class(F.col("x"), [0.25, 0.5]).alias("layer"))


@query("SELECT (id % 20) // 4 AS cx, (id // 20) // 4 AS cy, avg(id % 13)::DOUBLE AS v FROM range(400) r(id) WHERE id % 13 > 1 GROUP BY 1, 2")
def grid_coarsen(spark, d):
    raster = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), (F.col("id") % 13).cast("double").alias("v"))
    return applied.grid_coarsen(raster.filter("v > 1"), 4)


@query("SELECT user_id AS receiver, f.f AS freq, round(sum(value * cos(2 * pi() * f.f * (event_id % 100) / 100)), 6) AS re, round(sum(-value * sin(2 * pi() * f.f * (event_id % 100) / 100)), 6) AS im FROM events CROSS JOIN range(3) f(f) GROUP BY 1, 2")
def fourier_coeffs(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("receiver"), (F.col("event_id") % 100).alias("n"), F.col("value").alias("v"))
    return _r(applied.fourier_coefficients(e, 100, 3), 6, "re", "im")


@query("SELECT id, round((1 - 2 * a) * exp(-a), 10) AS w FROM (SELECT id, power(pi() * 8 * (id / 64e0 - 0.15), 2) AS a FROM range(64) r(id))")
def ricker(spark, d):
    return _depths(spark).select("id", F.round(applied.ricker(F.col("x"), 8.0, 0.15), 10).alias("w"))


@query("SELECT id FROM range(400) r(id) WHERE (id % 20 - 2) % 5 = 0 AND (id // 20 - 1) % 5 = 0 AND id % 20 >= 2 AND id // 20 >= 1")
def comb_points(spark, d):
    grid = spark.range(400).select("id", (F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    return applied.comb(grid, {"x": 2, "y": 1}, 5).select("id")


@query("SELECT a.id AS i, b.id AS j, round(exp(-sqrt(power(a.id % 20 - b.id % 20, 2) + power(a.id // 20 - b.id // 20, 2))), 10) AS v FROM range(400) a(id) JOIN range(400) b(id) ON power(a.id % 20 - b.id % 20, 2) + power(a.id // 20 - b.id // 20, 2) < 9")
def entries_within_reach(spark, d):
    grid = spark.range(400).select(F.col("id").alias("i"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    near = applied.within_reach(grid, grid, 3.0)
    return near.select("i", "j", F.round(F.exp(-F.col("distance")), 10).alias("v"))


@query("WITH s AS (SELECT id % 11 AS x, id // 11 AS z, sqrt(1e0 + id) AS c FROM range(121) r(id)), p AS (SELECT id, id / 64e0 * 9.9 AS x, 9.7 - id / 64e0 * 9 AS z FROM range(64) r(id)) SELECT p.id, round(sum(s.c * (1 - abs(p.x - s.x)) * (1 - abs(p.z - s.z))), 9) AS v FROM p JOIN s ON s.x BETWEEN floor(p.x) AND floor(p.x) + 1 AND s.z BETWEEN floor(p.z) AND floor(p.z) + 1 GROUP BY p.id")
def bilinear_lookup(spark, d):
    table = spark.range(121).select((F.col("id") % 11).alias("x"), F.floor(F.col("id") / 11).alias("z"), F.sqrt(1.0 + F.col("id")).alias("c"))
    points = _depths(spark).select("id", (F.col("x") * 9.9).alias("px"), (9.7 - F.col("x") * 9).alias("pz"))
    return _r(applied.bilinear(points, table), 9, "v")


@query("SELECT id, round(CASE WHEN id / 64e0 < 0.2 THEN 13 - 8 * (id / 64e0) ELSE 9 + (id / 64e0) - 2 * power(id / 64e0, 2) END, 10) AS rho FROM range(64) r(id)")
def layered_profile(spark, d):
    return _depths(spark).select("id", F.round(applied.layered(F.col("x"), [(0.2, [13.0, -8.0]), (float("inf"), [9.0, 1.0, -2.0])]), 10).alias("rho"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS inverse FROM events")
def unique_inverse(spark, d):
    return applied.unique_inverse(_t(spark, d, "events").select("event_id", "user_id"), "user_id").select("event_id", "inverse")


@query("SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) - 1 AS number FROM events GROUP BY user_id")
def first_touch(spark, d):
    return applied.first_touch(_t(spark, d, "events"), "user_id", "event_id")


def _lattice(spark):
    return spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), (F.col("id") % 13).cast("double").alias("v"))


_LATTICE = "SELECT id % 20 AS x, id // 20 AS y, (id % 13)::DOUBLE AS v FROM range(400) r(id)"
_BLUR = f"SELECT f.x, f.y, sum(g.v * w.w) AS v FROM ({_LATTICE}) f JOIN ({_LATTICE}) g ON abs(f.x - g.x) <= 1 AND abs(f.y - g.y) <= 1 JOIN (VALUES (0, 0.25e0), (1, 0.125e0), (2, 0.0625e0)) w(k, w) ON w.k = abs(f.x - g.x) + abs(f.y - g.y) GROUP BY 1, 2"
BLUR = {(a, b): 0.25 / 2 ** (abs(a) + abs(b)) for a in (-1, 0, 1) for b in (-1, 0, 1)}


@query(_BLUR)
def stencil_apply(spark, d):
    return applied.stencil(_lattice(spark), BLUR)


@query(f"SELECT x, y, f.v - b.v AS v FROM ({_LATTICE}) f JOIN ({_BLUR}) b USING (x, y)")
def highpass(spark, d):
    return applied.highpass(_lattice(spark), BLUR)


@query("SELECT 'source' AS kind, (r % 4) * 0.5e0 AS x, (r // 4) * 0.5e0 AS y, 0.1e0 AS z FROM range(12) a(r) UNION ALL SELECT 'receiver', (r % 7) * 0.25e0, (r // 7) * 0.25e0, 0.1e0 FROM range(35) a(r)")
def survey_grid(spark, d):
    return applied.survey(4, 3, 0.5, 0.25, 0.1, spark)


@query("SELECT r / 7e0 AS t, round(power(r / 7e0, 3) - r / 7e0, 9) + 0.0 AS v FROM range(50) a(r) WHERE r / 7e0 >= 0.5 AND r / 7e0 < 5")
def resample_series(spark, d):
    series = spark.range(12).select(F.col("id").alias("n"), (F.pow(F.col("id") * 0.5, F.lit(3.0)) - F.col("id") * 0.5).alias("v"))
    times = spark.range(50).select((F.col("id") / 7.0).alias("t")).filter("t >= 0.5 AND t < 5")
    return applied.resample(series, times, 0.5).select("t", (F.round("v", 9) + 0.0).alias("v"))


@query(f"SELECT i, round(avg(v), 9) AS mean, round(var_samp(v), 6) AS var FROM ({_TD}) GROUP BY i")
def field_statistics(spark, d):
    return _r(_r(applied.field_statistics(_trajectory(spark, d)), 9, "mean"), 6, "var")


@query(f"SELECT e, CASE WHEN e % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range({2 * N * N}) r(e)")
def attribute_indicator(spark, d):
    return mesh.attribute_indicator(mesh.triangles(spark, N).withColumn("attr", F.col("e") % 3), [1])


# Iterations of fixed length, and the iterative plans.

_AM = (
    f"SELECT p.i, q.i AS j, sum((p.gx * q.gx + p.gy * q.gy) * {_d(0.5 / N / N)} + 30e0 * CASE WHEN p.k = q.k THEN {_d(1 / 6 * 0.5 / N / N)} ELSE {_d(1 / 12 * 0.5 / N / N)} END) AS v "
    f"FROM ({_GRAD}) p JOIN ({_GRAD}) q ON p.e = q.e GROUP BY 1, 2"
)


def _system(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Stiffness plus 30 times mass on the square, and a right-hand side."""
    t = mesh.triangles(spark, N)
    a = mx.scatter_add(mesh.stiffness_entries(t).unionByName(mesh.mass_entries(t, 30.0)))
    return a, mesh.vertices(spark, N).select(F.col("vid").alias("i"), (F.col("vid") % 5 + 1).cast("double").alias("v"))


def _jacobi_sql(steps: int) -> str:
    out = f"WITH a AS MATERIALIZED ({_AM}), b AS (SELECT v AS i, (v % 5 + 1)::DOUBLE AS v FROM range({_M * _M}) r(v)), d AS (SELECT i, v FROM a WHERE i = j), x0 AS (SELECT b.i, b.v / d.v AS v FROM b JOIN d USING (i))"
    for k in range(steps):
        out += f", x{k + 1} AS MATERIALIZED (SELECT x.i, any_value(x.v) + 0.6e0 * (any_value(b.v) - sum(a.v * y.v)) / any_value(d.v) AS v FROM a JOIN x{k} y ON a.j = y.i JOIN x{k} x ON x.i = a.i JOIN b ON b.i = a.i JOIN d ON d.i = a.i GROUP BY x.i)"
    return out + f" SELECT i, round(v, 7) AS v FROM x{steps}"


@query(_jacobi_sql(4))
def jacobi_fixed(spark, d):
    a, b = _system(spark)
    return _r(krylov.frame_jacobi(written(a, "system"), b, 0.6, 4), 7, "v")


def _chebyshev_sql(lo: float, hi: float, degree: int) -> str:
    theta, delta = (hi + lo) / 2, (hi - lo) / 2
    sigma, rho = theta / delta, delta / theta
    out = f"WITH a AS MATERIALIZED ({_AM}), r0 AS (SELECT v AS i, (v % 5 + 1)::DOUBLE AS v FROM range({_M * _M}) r(v)), d0 AS (SELECT i, v * {_d(1 / theta)} AS v FROM r0), x0 AS (SELECT * FROM d0)"
    for k in range(degree - 1):
        fresh = 1 / (2 * sigma - rho)
        out += f", r{k + 1} AS MATERIALIZED (SELECT r.i, r.v - s.v AS v FROM r{k} r JOIN (SELECT a.i, sum(a.v * d.v) AS v FROM a JOIN d{k} d ON a.j = d.i GROUP BY a.i) s USING (i))"
        out += f", d{k + 1} AS MATERIALIZED (SELECT i, d.v * {_d(fresh * rho)} + r.v * {_d(2 * fresh / delta)} AS v FROM d{k} d JOIN r{k + 1} r USING (i))"
        out += f", x{k + 1} AS MATERIALIZED (SELECT i, x.v + d.v AS v FROM x{k} x JOIN d{k + 1} d USING (i))"
        rho = fresh
    return out + f" SELECT i, round(v, 6) AS v FROM x{degree - 1}"


@query(_chebyshev_sql(0.05, 8.0, 6))
def chebyshev_fixed(spark, d):
    a, b = _system(spark)
    return _r(krylov.frame_chebyshev(written(a, "system"), b, 0.05, 8.0, 6), 6, "v")


@query(None)
def cg_solve(spark, d):
    """Poisson's equation by conjugate gradients on frames, to a relative residual of 1e-4."""
    return krylov.frame_cg(*_system(spark), rel=1e-4).x


@query(None)
def rand_eig(spark, d):
    """Leading eigenpairs of A^T A of lineitem by a randomised double pass on frames."""
    a = mx.scatter_add(_matrix(spark, d))
    g = written(mx.mat_atb(a, a), "gram")
    omega = g.select("i").distinct()
    for k in range(8):
        omega = philox.with_draws(omega.withColumn("s", F.col("i") * 8 + k), "s", 7, name=f"x{k}").drop("s")
    omega = written(omega.select("i", F.array(*[f"x{k}" for k in range(8)]).alias("x")), "omega")
    values, u = randomized.frame_double_pass(g, omega, 8, 4, 2)
    return u.select("i", F.col("x").alias("u"), F.array(*[F.lit(float(v)) for v in values]).alias("d"))


@query(None)
def rand_svd(spark, d):
    """Singular values of the embeddings from one Gram aggregate."""
    sigma, images = randomized.frame_gram_svd(_embeddings(spark, d), K)
    return images.select("i", "x", F.array(*[F.lit(float(v)) for v in sigma]).alias("sigma"))


@query(None)
def philox_normal(spark, d):
    return philox.with_draws(spark.range(1000), "id", 42, "normal", name="z")


def _map_problem():
    """A small diffusion problem with noisy point data, and its optimum."""
    from fieldstone.functions import jet
    from fieldstone.plans import inverse, spaces

    v = spaces.Space(spaces.Square(6))
    ess = v.on_boundary(1, 3)
    problem = inverse.Problem(v, v, lambda u, m, p, x: jet.exp(m.val) * jet.inner(u.grad, p.grad), ess, v.coordinates[ess, 1])
    prior = inverse.bilaplacian_prior(v, 0.1, 0.5, robin=True)
    b = v.observation(np.array([[0.21 + 0.19 * (k % 4), 0.22 + 0.18 * (k // 4)] for k in range(16)]))
    data, sigma = inverse.observe(b, problem.solve_forward(prior.sample(philox.Random(1).normal(v.dim))), 0.01, philox.Random(2))
    model = inverse.Model(problem, prior, inverse.GaussianMisfit(b, data, sigma**2))
    return model, inverse.newton_cg(model, np.zeros(v.dim))


@query(None)
def map_point(spark, d):
    """MAP point and Laplace variance of a diffusion coefficient."""
    from fieldstone.plans import inverse

    model, opt = _map_problem()
    post, prior, less = inverse.laplace(model, opt, philox.Random(3), 16).pointwise_variance()
    rows = [(k, *map(float, r)) for k, r in enumerate(zip(opt.m, post, prior, less, strict=True))]
    return spark.createDataFrame(rows, "i long, m double, posterior_variance double, prior_variance double, reduction double")


@query(None)
def chain_samples(spark, d):
    """Independent chains, one per task, with their summary."""
    from fieldstone.plans import chains

    def make():
        model, opt = _map_problem()
        return chains.PCN(model, 0.05), opt.m, lambda u, m: float(m.mean())

    return dg.chain_summary(chains.run_chains(spark, make, 4, 40, 5).withColumnRenamed("chain", "key"), 10)


@query(None)
def heat_trajectory(spark, d):
    """A heat equation marched on arrays and returned as a trajectory frame."""
    from fieldstone.functions import jet
    from fieldstone.plans import spaces, time_dependent

    v = spaces.Space(spaces.Square(8))
    start = v.project(lambda x, y: np.sin(np.pi * x) * np.sin(np.pi * y))
    times = np.linspace(0, 0.05, 6)
    step = lambda u, old, m, p, x, t, dt: (u.val - old.val) * p.val + dt * jet.inner(u.grad, p.grad)
    pr = time_dependent.TimeProblem(v, v, step, times, v.on_boundary(1, 2, 3, 4), start)
    return time_dependent.trajectory_frame(spark, times, pr.forward(np.zeros(v.dim)))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}


# The rest of the registered queries; they use what is above.
from fieldstone import catalogue_algebra, catalogue_cells, catalogue_frames  # noqa: E402, F401
