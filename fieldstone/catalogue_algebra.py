"""Registered queries of vectors, operators, patterns and pointwise algebra, beside those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldstone.catalogue import _A, _A1, _ATA, _IDS, _X, _Y, K, N, _customer, _d, _embeddings, _LOC, _matrix, _mv_sql, _r, _supplier, _t, _TD, _trajectory, query
from fieldstone.functions import applied, pointwise
from fieldstone.operators import algebra as al
from fieldstone.operators import krylov, randomized
from fieldstone.operators import matrix as mx
from fieldstone.operators import vector as vec
from fieldstone.shared import written
from fieldstone.sources import mesh

_P = "SELECT p_partkey AS i, p_retailprice AS v FROM part"


def _part(spark, d):
    return vec.from_columns(_t(spark, d, "part"), "p_partkey", "p_retailprice")


def _nation_of(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("bigint").alias("j"), F.lit(1.0).alias("v"))


# Vectors.


@query("SELECT s_suppkey AS i, 0e0 AS v FROM supplier")
def vec_duplicate(spark, d):
    return vec.constant(_supplier(spark, d))


@query("SELECT c_custkey AS i, 2.5e0 AS v FROM customer")
def vec_fill(spark, d):
    return vec.constant(_customer(spark, d), 2.5)


@query(f"SELECT i, -1.5e0 * v AS v FROM ({_Y})")
def vec_scale(spark, d):
    return vec.scale(_customer(spark, d), -1.5)


@query("SELECT i, i * 0.5e0 AS v FROM range(1000) r(i)")
def vec_from_array(spark, d):
    return vec.as_vector(spark, [0.5 * k for k in range(1000)])


@query("SELECT s_nationkey::INT AS rank, coalesce(sum(count(*)) OVER (ORDER BY s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, count(*) AS size FROM supplier GROUP BY s_nationkey")
def vec_partition(spark, d):
    return vec.partition(_t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("rank")).agg(F.count(F.lit(1)).alias("size")))


@query("SELECT CAST(floor(c_custkey * 7 / (SELECT max(c_custkey) + 1e0 FROM customer)) AS INT) AS rank, min(c_custkey) AS first, max(c_custkey) AS last, count(*) AS size FROM customer GROUP BY 1")
def vec_layout(spark, d):
    x = _customer(spark, d)
    return vec.layout(x, x.agg(F.max("i")).first()[0] + 1, 7)


@query(f"SELECT i, v FROM ({_X})")
def vec_round_trip(spark, d):
    """Gathered on the driver and scattered again."""
    x = _supplier(spark, d)
    n = x.agg(F.max("i")).first()[0] + 1
    return vec.from_array(spark, vec.gather(x, n)).join(x.select("i"), "i", "left_semi")


@query(f"SELECT a.i, round(sum(a.v * x.v), 4) AS v FROM ({_A}) a JOIN ({_X}) x ON a.j = x.i GROUP BY a.i")
def vec_allgather(spark, d):
    """A product whose vector every executor gets whole."""
    return _r(mx.spmv(_matrix(spark, d), vec.allgather(_supplier(spark, d))), 4, "v")


@query(f"SELECT a.i, round(a.v / b.v, 7) AS v FROM ({_X}) a JOIN ({_P}) b ON a.i = b.i")
def vec_divide(spark, d):
    return _r(vec.pointwise_divide(_supplier(spark, d), _part(spark, d)), 7, "v")


# Multivectors.


@query(f"SELECT p.k::INT AS k, q.k::INT AS l, round(sum(p.a * q.a * (1 + q.i % 3)), 6) AS v FROM ({_mv_sql()}) p JOIN ({_mv_sql()}) q ON p.i = q.i GROUP BY 1, 2")
def mv_dot_mv(spark, d):
    x = _embeddings(spark, d)
    return _r(vec.dot_mv(x, x.select("i", F.transform("x", lambda a: a * (1 + F.col("i") % 3)).alias("x"))), 6, "v")


@query(f"SELECT i, k::INT AS k, round(a * (k - 10), 9) + 0.0 AS v FROM ({_mv_sql()})")
def mv_scale(spark, d):
    return vec.mv_scale(_embeddings(spark, d), [k - 10 for k in range(K)]).select("i", F.posexplode("x").alias("k", "v")).select("i", "k", (F.round("v", 9) + 0.0).alias("v"))


@query(f"SELECT p.i, p.k::INT AS k, round(p.a + (p.k - 3) * q.a, 9) + 0.0 AS v FROM ({_mv_sql()}) p JOIN ({_mv_sql()}) q ON p.i = q.i AND q.k = {K - 1} - p.k")
def mv_axpy(spark, d):
    x = _embeddings(spark, d)
    y = x.select("i", F.reverse("x").alias("x"))
    return vec.mv_axpy(x, [k - 3 for k in range(K)], y).select("i", F.posexplode("x").alias("k", "v")).select("i", "k", (F.round("v", 9) + 0.0).alias("v"))


@query("SELECT s_suppkey AS i, 5 AS n, 0e0 AS total FROM supplier")
def mv_zero(spark, d):
    x = vec.mv_zero(_supplier(spark, d), 5)
    return x.select("i", F.size("x").alias("n"), pointwise.total(F.col("x")).alias("total"))


@query("SELECT i, k::INT AS k, (3 * i + k)::DOUBLE AS v FROM range(200) r(i) CROSS JOIN range(3) c(k)")
def mv_from_array(spark, d):
    return vec.mv_from_array(spark, [[3 * i + k for k in range(3)] for i in range(200)]).select("i", F.posexplode("x").alias("k", "v"))


@query(f"SELECT i, (k // 4)::INT AS k, a AS v FROM ({_mv_sql()}) WHERE k % 4 = 1")
def mv_columns(spark, d):
    """The columns that rank 1 of 4 owns."""
    return vec.mv_columns(_embeddings(spark, d), 1, 4).select("i", F.posexplode("x").alias("k", "v"))


@query(f"SELECT i, k::INT AS k, a AS v FROM ({_mv_sql()})")
def mv_exchange(spark, d):
    """Columns dealt to three ranks and put together again."""
    x = _embeddings(spark, d)
    return vec.mv_exchange([vec.mv_columns(x, r, 3) for r in range(3)]).select("i", F.posexplode("x").alias("k", "v"))


@query(f"SELECT a.j AS i, round(sum(a.v * p.v), 3) AS x0, sum(a.v) AS x1 FROM ({_A}) a JOIN ({_P}) p ON a.i = p.i GROUP BY a.j")
def spmm_transpose(spark, d):
    x = _part(spark, d).select("i", F.array("v", F.lit(1.0)).alias("x"))
    return mx.spmm_transpose(_matrix(spark, d), x, 2).select("i", F.round(F.col("x")[0], 3).alias("x0"), F.col("x")[1].alias("x1"))


@query(f"SELECT k::INT AS k, l::INT AS l, CASE WHEN k = l THEN 1e0 ELSE 0e0 END AS v FROM range({K}) a(k) CROSS JOIN range({K}) b(l)")
def mv_orthonormal(spark, d):
    """The Gram matrix of the embeddings' orthonormal columns."""
    q = randomized.frame_orthogonalize(_embeddings(spark, d), K)
    return vec.gram(q).select("k", "l", (F.round("v", 8) + 0.0).alias("v"))


@query(f"SELECT k::INT AS k, l::INT AS l, CASE WHEN k = l THEN 1e0 ELSE 0e0 END AS v FROM range({K}) a(k) CROSS JOIN range({K}) b(l)")
def mv_b_orthonormal(spark, d):
    """Q^T B Q of B-orthonormal columns, B = diag(1 + i % 3)."""
    x = _embeddings(spark, d)
    b = al.Diagonal(x.select("i", (1.0 + F.col("i") % 3).alias("v")))
    q, bq = randomized.frame_b_orthogonalize(x, lambda y: randomized.frame_apply(b, y, K), K)
    return vec.dot_mv(q, bq).select("k", "l", (F.round("v", 8) + 0.0).alias("v"))


@query(f"SELECT round(sum(CASE WHEN k = l THEN v END), 5) AS second, round(sum(v * v), 3) AS fourth FROM (SELECT p.k, q.k AS l, sum(p.a * q.a) AS v FROM ({_mv_sql()}) p JOIN ({_mv_sql()}) q ON p.i = q.i GROUP BY 1, 2)")
def svd_moments(spark, d):
    """Sums of the squares and fourth powers of the embeddings' singular values."""
    sigma, _ = randomized.frame_gram_svd(_embeddings(spark, d), K)
    return spark.createDataFrame([(round(float((sigma**2).sum()), 5), round(float((sigma**4).sum()), 3))], "second double, fourth double")


# Trajectories.

_USER = "SELECT DISTINCT user_id % 7 AS i, user_id AS j, 0.5e0 + user_id % 3 AS v FROM events"


def _users(spark, d):
    u = F.col("user_id")
    return _t(spark, d, "events").select((u % 7).alias("i"), u.alias("j"), (0.5 + u % 3).alias("v")).distinct()


@query(f"SELECT x.k, a.i, round(sum(a.v * x.v), 5) AS v FROM ({_USER}) a JOIN ({_TD}) x ON a.j = x.i GROUP BY 1, 2")
def td_matmul(spark, d):
    return _r(mx.spmv_levels(_users(spark, d), _trajectory(spark, d)), 5, "v")


@query(f"SELECT round(sum(a.v * a.v), 2) AS \"inner\" FROM ({_TD}) a")
def td_inner(spark, d):
    x = _trajectory(spark, d)
    return _r(vec.td_inner(x, x), 2, "inner")


@query(f"WITH x AS ({_TD}), m AS (SELECT min(k) AS k FROM x) SELECT i, v FROM x WHERE k = (SELECT k FROM m)")
def td_view(spark, d):
    x = written(_trajectory(spark, d), "trajectory")
    return vec.td_level(x, x.agg(F.min("k")).first()[0])


@query(f"WITH x AS ({_TD}), m AS (SELECT min(k) AS k FROM x) SELECT k, i, v FROM x WHERE k != (SELECT k FROM m) UNION ALL SELECT m.k, s.i, s.v FROM ({_X}) s CROSS JOIN m")
def td_store(spark, d):
    x = written(_trajectory(spark, d).withColumn("t", F.col("k") * 1.0), "trajectory")
    k = x.agg(F.min("k")).first()[0]
    return vec.td_store(x, k, 0.0, _supplier(spark, d)).select("k", "i", "v")


@query(f"SELECT k, i, v, lag(v) OVER (PARTITION BY i ORDER BY k) AS before FROM ({_TD})")
def td_before(spark, d):
    return vec.previous_level(_trajectory(spark, d))


# Operators.


@query(f"SELECT round(sum(a.v * x.v * p.v), -3) AS \"inner\" FROM ({_A}) a JOIN ({_X}) x ON a.j = x.i JOIN ({_P}) p ON p.i = a.i")
def op_inner(spark, d):
    return _r(al.Matrix(_matrix(spark, d)).inner(_supplier(spark, d), _part(spark, d)), -3, "inner")


@query(f"SELECT x.i, round(coalesce(s.v, 0) * 0.25 - 3 * x.v, -2) AS v FROM ({_X}) x LEFT JOIN (SELECT m.i, sum(m.v * y.v) AS v FROM ({_ATA}) m JOIN ({_X}) y ON m.j = y.i GROUP BY m.i) s ON s.i = x.i")
def op_sum(spark, d):
    """(A^T A / 4 - 3 I) x, with A^T A as a product that is never formed."""
    a = al.Matrix(mx.scatter_add(_matrix(spark, d)))
    return _r(al.Sum(al.Scaled(al.Product(a.transpose(), a), 0.5), al.Identity(), 0.5, -3.0).mult(_supplier(spark, d)), -2, "v")


@query(f"SELECT a.j AS i, round(sum(a.v * p.v * p.v), -1) AS v FROM ({_A}) a JOIN ({_P}) p ON a.i = p.i GROUP BY a.j")
def op_product_transpose(spark, d):
    """(D A)^T y with D the diagonal of y."""
    p = _part(spark, d)
    return _r(al.Product(al.Diagonal(p), al.Matrix(_matrix(spark, d))).mult_transpose(p), -1, "v")


@query(f"SELECT x.i, round(x.v / p.v, 7) AS v FROM ({_X}) x JOIN ({_P}) p ON x.i = p.i")
def op_solvers(spark, d):
    """A diagonal solve as an operator, and that operator as a solver again."""
    as_operator = al.SolverOperator(al.Diagonal(_part(spark, d)).solve)
    return _r(al.OperatorSolver(as_operator).solve(_supplier(spark, d)), 7, "v")


@query(_ATA)
def op_as_matrix(spark, d):
    """The matrix of x -> A^T A x by its products with all unit vectors."""
    a = al.Matrix(mx.scatter_add(_matrix(spark, d)))
    return al.as_matrix(al.Product(a.transpose(), a), _supplier(spark, d).select("i"))


@query("SELECT s_suppkey AS i, 0e0 AS v FROM supplier")
def op_vector(spark, d):
    return al.zero_vector(_supplier(spark, d).select("i"))


# Matrices.


@query("SELECT l_partkey AS i, s_nationkey::BIGINT AS j, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def mat_mult(spark, d):
    return mx.matmul(mx.scatter_add(_matrix(spark, d)), _nation_of(spark, d))


@query("SELECT l_partkey AS i, n_regionkey::BIGINT AS j, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def mat_mult3(spark, d):
    regions = _t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"), F.col("n_regionkey").cast("bigint").alias("j"), F.lit(1.0).alias("v"))
    return mx.matmul3(mx.scatter_add(_matrix(spark, d)), _nation_of(spark, d), regions)


@query(f"SELECT i, list(j ORDER BY j) AS cols, list(v ORDER BY j) AS vals FROM ({_A1}) GROUP BY i")
def mat_rows(spark, d):
    return mx.to_rows(mx.scatter_add(_matrix(spark, d)))


@query(_A1)
def mat_from_rows(spark, d):
    return mx.from_rows(mx.to_rows(mx.scatter_add(_matrix(spark, d))))


@query("SELECT l_partkey AS i, l_suppkey AS j, sum(l_extendedprice)::FLOAT::DOUBLE AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2 HAVING count(*) = 1")
def mat_single(spark, d):
    a = _t(spark, d, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_extendedprice").alias("v"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return mx.single(a).withColumn("v", F.col("v").cast("double"))


@query(f"SELECT i, j, v FROM ({_ATA}) WHERE floor(i * 4 / (SELECT max(s_suppkey) + 1e0 FROM supplier)) = floor(j * 4 / (SELECT max(s_suppkey) + 1e0 FROM supplier))")
def mat_block_diagonal(spark, d):
    a = mx.scatter_add(_matrix(spark, d))
    return mx.block_diagonal(mx.mat_atb(a, a), _supplier(spark, d).agg(F.max("i")).first()[0] + 1, 4)


@query(f"SELECT i, j, v FROM ({_A1}) WHERE (i, j) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1)")
def slots_of(spark, d):
    wanted = _t(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).distinct()
    return mx.slots_of(mx.scatter_add(_matrix(spark, d)), wanted)


@query("SELECT l_partkey AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1")
def scatter_vector(spark, d):
    return mx.scatter_vector(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_quantity").alias("v")))


@query("SELECT i, j, dense_rank() OVER (ORDER BY i, j) - 1 AS inverse FROM (SELECT l_partkey AS i, l_suppkey AS j FROM lineitem)")
def unique_inverse_rows(spark, d):
    return applied.unique_inverse_rows(_matrix(spark, d).select("i", "j"))


@query("SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS place, event_id FROM events")
def argsort_keys(spark, d):
    return applied.argsort(_t(spark, d, "events"), "user_id", "event_id")


@query("SELECT DISTINCT p.s_nationkey::BIGINT AS i, q.s_nationkey::BIGINT AS j FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN supplier p ON p.s_suppkey = a.l_suppkey JOIN supplier q ON q.s_suppkey = b.l_suppkey")
def true_dof_graph(spark, d):
    """The graph of suppliers that share a part, as one of their nations."""
    table = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("e"), F.col("l_suppkey").alias("i")).distinct()
    graph = mx.pattern_of_tables(table, table)
    return mx.relabelled(graph, _nation_of(spark, d).select(F.col("i").alias("local"), F.col("j").alias("i")))


@query(f"SELECT DISTINCT p.i, q.i AS j FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e")
def pattern_of_tables(spark, d):
    dofs = mesh.elem_dofs(mesh.triangles(spark, N))
    return mx.pattern_of_tables(dofs, dofs)


@query(f"SELECT i, e, k::INT AS a FROM ({_LOC})")
def vector_pattern(spark, d):
    return mesh.elem_dofs(mesh.triangles(spark, N)).select("i", "e", "a")


_M = N + 1
_EDGE_DOFS = f"SELECT v AS i FROM range({_M * _M}) r(v) WHERE v // {_M} = 0 OR v // {_M} = {N}"


def _masses(spark):
    t = mesh.triangles(spark, N)
    return mesh.local_pairs(mesh.geometry(t)).select("e", "a", "b", "i", "j", (F.col("area") * F.when(F.col("a") == F.col("b"), F.lit(1 / 6)).otherwise(F.lit(1 / 12))).alias("v"))


def _sides(spark):
    return mesh.essential_indices(mesh.boundary(spark, N), [1, 3])


@query(f"SELECT p.e, p.k::INT AS a, q.k::INT AS b, p.i, q.i AS j, p.i IN ({_EDGE_DOFS}) OR q.i IN ({_EDGE_DOFS}) AS masked FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e")
def plan_block(spark, d):
    return mx.plan_block(_masses(spark), _sides(spark))


@query(f"SELECT p.i, q.i AS j, round(sum(CASE WHEN p.i IN ({_EDGE_DOFS}) OR q.i IN ({_EDGE_DOFS}) THEN 0 WHEN p.k = q.k THEN {_d(0.5 / N / N / 6)} ELSE {_d(0.5 / N / N / 12)} END), 12) AS v FROM ({_LOC}) p JOIN ({_LOC}) q ON p.e = q.e GROUP BY 1, 2")
def finish_block(spark, d):
    pairs = _masses(spark)
    return _r(mx.finish_block(mx.plan_block(pairs, _sides(spark)), pairs.select("e", "a", "b", "v")), 12, "v")


@query(f"SELECT s_suppkey AS i, CASE WHEN s_suppkey IN ({_IDS}) THEN 0 ELSE s_acctbal END AS v FROM supplier")
def zero_essential(spark, d):
    return mx.zero_essential(_supplier(spark, d), _t(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("i")))


@query(f"SELECT v AS i, 3e0 * (v % {_M}) / {N} AS value FROM range({_M * _M}) r(v) WHERE (v % {_M}) / {N}e0 + (v // {_M}) / {N}e0 <= 0.25")
def essential_where(spark, d):
    return mx.essential_where(mesh.vertices(spark, N), F.col("x") + F.col("y") <= 0.25, 3 * F.col("x"))


@query(f"SELECT v AS i, 0e0 AS value FROM range({_M * _M}) r(v) WHERE (v % {_M}) = 0")
def essential_homogeneous(spark, d):
    return mx.homogeneous(mx.essential_where(mesh.vertices(spark, N), F.col("x") == 0, 7.0))


# Low rank.


@query(f"WITH u AS ({_mv_sql()}), w AS (SELECT k, sum(a * v) / (k + 1) AS w FROM u JOIN ({_Y}) x ON u.i = x.i WHERE k % 5 != 4 GROUP BY k) SELECT i, round(sum(a * w), 2) AS v FROM u JOIN w USING (k) GROUP BY i")
def lowrank_solve(spark, d):
    """The pseudo-inverse, with zeros in the spectrum."""
    return _r(mx.lowrank_solve(_embeddings(spark, d), [0 if k % 5 == 4 else k + 1 for k in range(K)], _customer(spark, d)), 2, "v")


@query(f"WITH u AS ({_mv_sql()}), p AS (SELECT s.k, m.i, sum(m.v * s.a) AS y FROM ({_ATA}) m JOIN u s ON s.i = m.j GROUP BY 1, 2) SELECT round(sum(u.a * p.y * ({K} - u.k)), 0) AS trace FROM u JOIN p ON u.i = p.i AND u.k = p.k")
def lowrank_trace_w(spark, d):
    """W is A^T A, which is not formed."""
    return _r(mx.lowrank_trace_atb(_embeddings(spark, d), range(K, 0, -1), _matrix(spark, d)), 0, "trace")


@query("SELECT n::INT AS degree, round(1 / cosh(n * acosh(8.05e0 / 7.95e0)), 10) AS bound FROM range(1, 40) r(n)")
def chebyshev_bound(spark, d):
    return spark.createDataFrame([(n, round(krylov.chebyshev_bound(0.05, 8.0, n), 10)) for n in range(1, 40)], "degree int, bound double")


# Pointwise algebra: an embedding as a matrix of 8 rows, a line of lineitem as a vector of three.

_CELL = "SELECT vec_id AS i, r.r AS r, c.c AS c, embedding[8 * r.r + c.c + 1]::DOUBLE AS a FROM embeddings CROSS JOIN range(8) r(r) CROSS JOIN range(8) c(c)"
_BOTH = f"SELECT p.i, p.r, p.c, p.a, q.a AS t FROM ({_CELL}) p JOIN ({_CELL}) q ON p.i = q.i AND p.r = q.c AND p.c = q.r"


def _square(spark, d) -> tuple:
    x = _embeddings(spark, d)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("x", r * 8 + 1, 8))
    return x.select("i", "x", rows.alias("a"))


def _weighed(a: Column) -> Column:
    """sum of (8 r + c + 1) a_rc."""
    flat = F.transform(F.flatten(a), lambda v, k: v * (k + 1))
    return F.round(pointwise.total(flat), 6)


@query(f"SELECT i, round(sum(CASE WHEN r = c THEN a END), 7) AS tr, round(sum(a * t), 7) AS contraction, round(sum(a * a), 7) AS norm2, round(sum((8 * r + c + 1) * (a + t) / 2), 6) AS sym, round(sum((8 * r + c + 1) * (a - t) / 2), 6) + 0.0 AS skew, round(sum((8 * r + c + 1) * t), 6) AS transposed, round(sum((a - CASE WHEN r = c THEN 1 ELSE 0 END) ^ 2), 6) AS from_identity FROM ({_BOTH}) GROUP BY i")
def pointwise_matrix(spark, d):
    a, m = F.col("a"), _square(spark, d)
    away = F.zip_with(a, pointwise.identity(8), lambda p, q: F.zip_with(p, q, lambda x, y: x - y))
    return m.select(
        "i", F.round(pointwise.trace(a), 7).alias("tr"), F.round(pointwise.inner(a, pointwise.transpose(a)), 7).alias("contraction"), F.round(pointwise.norm2(F.col("x")), 7).alias("norm2"),
        _weighed(pointwise.sym(a)).alias("sym"), (_weighed(pointwise.skew(a)) + 0.0).alias("skew"), _weighed(pointwise.nabla_grad(a)).alias("transposed"), F.round(pointwise.inner(away, away), 6).alias("from_identity"),
    )


@query(f"SELECT i, round(sum(a), 7) AS div, count(*) AS n FROM ({_CELL}) WHERE r = c GROUP BY i")
def pointwise_div(spark, d):
    """The divergence of a field whose gradient is the matrix, and the number of its terms."""
    return _square(spark, d).select("i", F.round(pointwise.div(F.col("a")), 7).alias("div"), F.size("a").cast("bigint").alias("n"))


_LINE = "SELECT l_orderkey AS o, l_linenumber AS n, l_quantity AS a1, l_discount AS a2, l_tax AS a3, l_extendedprice / 1000 AS b1, l_tax AS b2, l_quantity / 10 AS b3 FROM lineitem"


@query(
    f"SELECT o, n, round(a1 * b1 + a2 * b2 + a3 * b3, 6) AS dot, round(a2 * b3 - a3 * b2, 7) + 0.0 AS c1, round(a3 * b1 - a1 * b3, 9) + 0.0 AS c2, round(a1 * b2 - a2 * b1, 9) + 0.0 AS c3, "
    f"round(sqrt(a1 * a1 + a2 * a2 + a3 * a3), 8) AS size, round((a1 + 2 * a2 + 3 * a3) * (b1 - b3), 9) + 0.0 AS \"outer\", round(exp(a2) + ln(a1), 9) AS el FROM ({_LINE})"
)
def pointwise_vector(spark, d):
    li = _t(spark, d, "lineitem")
    a, b = F.array("l_quantity", "l_discount", "l_tax"), F.array(F.col("l_extendedprice") / 1000, F.col("l_tax"), F.col("l_quantity") / 10)
    x = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    cross, outer = pointwise.cross(a, b), pointwise.outer(a, b)
    weighed = pointwise.dot(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), pointwise.matvec(outer, F.array(F.lit(1.0), F.lit(0.0), F.lit(-1.0))))
    return x.select(
        "o", "n", F.round(pointwise.dot(a, b), 6).alias("dot"), (F.round(cross[0], 7) + 0.0).alias("c1"), (F.round(cross[1], 9) + 0.0).alias("c2"), (F.round(cross[2], 9) + 0.0).alias("c3"),
        F.round(F.sqrt(pointwise.norm2(a)), 8).alias("size"), (F.round(weighed, 9) + 0.0).alias("outer"), F.round(F.exp(a[1]) + F.ln(a[0]), 9).alias("el"),
    )


# Options.


@query("SELECT 'theta' AS k, '0.5' AS v UNION ALL SELECT 'pmax', '3' UNION ALL SELECT 'sweeps', '2'")
def options_parsed(spark, d):
    rows = spark.createDataFrame([("theta=0.5,pmax=3,sweeps=2",)], "text string")
    return rows.select(F.explode(applied.options(F.col("text"))).alias("k", "v"))
