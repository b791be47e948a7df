import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstone import catalogue
from fieldstone.functions import applied, pointwise
from fieldstone.operators import diagnostics as dg
from fieldstone.operators import matrix as mx
from fieldstone.operators import misfits as mf
from fieldstone.operators import vector as vec
from fieldstone.sources import files, mesh
from fieldstone.streaming import trajectories


def frame(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]], "i long, j long, v double")


def vector(spark, x):
    return spark.createDataFrame(list(enumerate(map(float, x))), "i long, v double")


def dense(df, *shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[k] for k in ("i", "j")[: len(shape)])] = r["v"]
    return out


def test_nan_surfaces(spark):
    x = vector(spark, [1.0, float("nan"), -3.0])
    r = vec.norms(x).first()
    assert all(np.isnan(r[k]) for k in ("l1", "l2", "linf", "total", "largest", "least"))
    assert not vec.all_finite(x).first()[0] and vec.all_finite(vector(spark, [1, 2])).first()[0]


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_products_do_not_depend_on_partitions(spark, parts):
    r = np.random.default_rng(1)
    a, b, x = r.integers(-3, 4, (9, 7)), r.integers(-3, 4, (9, 7)), r.integers(-3, 4, 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        fa, fb = frame(spark, a), frame(spark, b)
        assert (dense(mx.spmv(fa, vector(spark, x)), 9) == a @ x).all()
        assert (dense(mx.mat_atb(fa, fb), 7, 7) == a.T @ b).all()
        assert (dense(mx.add(fa, fb, 2, -1), 9, 7) == 2 * a - b).all()
        assert (dense(mx.matmul(fa, mx.transpose(fb)), 9, 9) == a @ b.T).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_adjoint_identity_and_mesh_counts(spark):
    n = 6
    t = mesh.triangles(spark, n)
    points = spark.createDataFrame([(k, 0.1 + 0.07 * k, 0.9 - 0.05 * k) for k in range(10)], "t long, x double, y double")
    b = mesh.observation_matrix(points, t, n)
    u = mesh.vertices(spark, n).selectExpr("vid AS i", "x * x + y AS v")
    y = points.selectExpr("t AS i", "x AS v")
    assert vec.inner(mx.spmv(b, u), y).first()[0] == pytest.approx(vec.inner(u, mx.spmv_transpose(b, y)).first()[0], rel=1e-12)
    assert t.count() == 2 * n * n and mesh.interior_facets(t).count() == 3 * n * n + 2 * n - 4 * n
    k = mx.scatter_add(mesh.stiffness_entries(t))
    assert k.count() == (n + 1) ** 2 + 2 * (3 * n * n + 2 * n) and mx.symmetry_defect(k).first()[0] < 1e-14
    off = spark.createDataFrame([(0, 1.5, 0.5)], "t long, x double, y double")
    with pytest.raises(ValueError):
        mesh.observation_matrix(off, t, n)
    assert mesh.observation_matrix(off, t, n, "ignore").count() == 0


def test_observations_pass_through_no_driver(spark, tmp_path):
    """More rows than a driver array may have; values that are null and targets that come twice stay as they are."""
    n = vec.DRIVER_ENTRIES + 1
    spark.range(n).selectExpr("(id * 7919) % 4000037 AS o_orderkey", "nullif(id % 1000, 0) / 8D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    want = spark.read.parquet(f"{tmp_path}/orders.parquet").selectExpr("o_orderkey AS t", "o_totalprice AS v")
    figures = [F.count(F.lit(1)), F.count("v"), F.sum("v"), F.bit_xor(F.xxhash64("t", "v"))]
    assert catalogue.QUERIES["observations_in_order"][0](spark, str(tmp_path)).agg(*figures).first() == want.agg(*figures).first()
    rows = [(3, 1.5), (1, None), (None, 2.0), (3, 0.5), (-2, float("nan"))]
    obs = spark.createDataFrame(rows, "t long, v double")
    got = mf.scatter_observations(mf.gather_observations(obs, "t"), obs.select("t")).collect()
    assert sorted(map(str, got)) == sorted(map(str, obs.collect()))
    array = mf.scatter_observations([10.0, 20.0, 30.0], spark.createDataFrame([(9,), (4,), (7,)], "t long"))
    assert sorted(map(tuple, array.collect())) == [(4, 10.0), (7, 20.0), (9, 30.0)]


@pytest.mark.parametrize("limit", [mx.BROADCAST_BYTES, 6 * (mx.ROW_BYTES + 16), 0])
def test_trace_of_a_low_rank_product_by_rows(spark, limit):
    """All columns at once, two at once, and by joins that Catalyst picks; entries that repeat, indices and values that are null, rows of U without an entry."""
    r = np.random.default_rng(3)
    a, b, u, d = r.integers(-3, 4, (12, 7)), r.integers(-3, 4, (12, 7)), r.integers(-3, 4, (9, 5)), [4, 0, -1, 2, 3]
    u = np.vstack([u[:6], 0 * u[6:7], u[6:]])  # index 6 has no row, 7 to 9 no entry
    mv = spark.createDataFrame([(i, list(map(float, u[i]))) for i in range(10) if i != 6], "i long, x array<double>")
    odd = spark.createDataFrame([(None, 2, 5.0), (3, None, 5.0), (4, 1, None)], "i long, j long, v double")
    fa = frame(spark, a).unionByName(frame(spark, 2 * a)).unionByName(odd)
    fb = frame(spark, b)
    w = lambda p, q: np.trace(u[:7] @ np.diag(d) @ u[:7].T @ p.T @ q)
    assert mx.lowrank_trace_atb(mv, d, fa, limit=limit).first()[0] == w(3 * a, 3 * a)
    assert mx.lowrank_trace_atb(mv, d, fa, fb, limit=limit).first()[0] == w(3 * a, b)
    assert mx.lowrank_trace(mv, d, mx.mat_atb(mx.scatter_add(fa), fb)).first()[0] == w(3 * a, b)
    assert mx.lowrank_trace_atb(mv, d, fa.filter("j > 7"), limit=limit).first()[0] is None


def test_lowrank_trace_w_does_not_form_the_product(spark, tmp_path):
    """A part of 1500 suppliers: 2250000 pairs of them, which are not to be shuffled."""
    n = 1500
    spark.range(n).selectExpr("0L AS l_partkey", "id AS l_suppkey", "double(1 + id % 50) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).selectExpr("id AS vec_id", "transform(sequence(0, 63), k -> float((id * (k + 3)) % 17 - 8)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    s = spark.sparkContext._jsc.sc()

    def shuffled():
        s.listenerBus().waitUntilEmpty()
        found = s.statusStore().executorList(True)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = shuffled()
    got = catalogue.QUERIES["lowrank_trace_w"][0](spark, str(tmp_path)).first()[0]
    i, k = np.arange(n)[:, None], np.arange(64)
    assert got == (((1 + i % 50) * ((i * (k + 3)) % 17 - 8)).sum(axis=0) ** 2 * (64 - k)).sum()
    assert 0 < shuffled() - before < 1_000_000


def test_refusals(spark):
    obs = spark.createDataFrame([(0, -1.0, 2.0)], "t long, bu double, d double")
    with pytest.raises(ZeroDivisionError):
        mf.gauss_cost(obs, 0)
    with pytest.raises(ValueError):
        mf.gauss_cost(obs, None)
    with pytest.raises(Exception, match="not positive"):
        mf.gamma_cost(obs, 2.0).collect()
    with pytest.raises(Exception, match="no such slot"):
        mx.slots_of(frame(spark, np.eye(2)), spark.createDataFrame([(0, 1)], "i long, j long")).collect()


def test_constant_chain_has_iact_one(spark):
    chain = spark.range(50).select(F.lit("a").alias("key"), F.col("id").alias("k"), F.lit(2.0).alias("q"))
    assert dg.iact(dg.autocorrelation(chain, 10)).first()["iact"] == 1


def test_pointwise_algebra(spark):
    r = np.random.default_rng(2)
    a, b, x, y = r.normal(size=(3, 3)), r.normal(size=(3, 3)), r.normal(size=3), r.normal(size=3)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), x.tolist(), y.tolist())], "a array<array<double>>, b array<array<double>>, x array<double>, y array<double>")
    A, B, X, Y = (F.col(c) for c in "abxy")
    want = {
        "dot": (pointwise.dot(X, Y), x @ y), "inner": (pointwise.inner(A, B), (a * b).sum()), "trace": (pointwise.trace(A), np.trace(a)), "sym": (pointwise.sym(A), (a + a.T) / 2),
        "skew": (pointwise.skew(A), (a - a.T) / 2), "outer": (pointwise.outer(X, Y), np.outer(x, y)), "cross": (pointwise.cross(X, Y), np.cross(x, y)), "mv": (pointwise.matvec(A, X), a @ x),
        "norm2": (pointwise.norm2(X), x @ x), "jump": (pointwise.jump_grad(X, Y), x - y), "avg": (pointwise.avg_grad(X, Y), (x + y) / 2),
    }
    got = df.select(*[c.alias(k) for k, (c, _) in want.items()]).first()
    for k, (_, w) in want.items():
        assert np.allclose(np.array(got[k]), w), k


def test_files(spark, tmp_path):
    v = vector(spark, range(20))
    files.save_vector(str(tmp_path / "v"), v)
    assert sorted(map(tuple, files.load_vector(spark, str(tmp_path / "v")).collect())) == [(k, float(k)) for k in range(20)]
    points = spark.createDataFrame([(k, k / 2, 1.0) for k in range(4)], "t long, x double, y double")
    files.write_point_csv(str(tmp_path / "p"), points, points.selectExpr("t", "x * 2 AS v"))
    assert sorted(map(tuple, files.read_point_csv(spark, str(tmp_path / "p")).collect())) == [(k / 2, 1.0, float(k)) for k in range(4)]
    where = points.withColumnRenamed("t", "i")
    for c in range(2):
        files.write_field(str(tmp_path / "f"), "u", c, 0.1 * c, where, points.selectExpr("t AS i", f"x + {c} AS v"))
    assert files.read_field(spark, str(tmp_path / "f"), "u", 1).count() == 4


def test_application_operators(spark):
    df = spark.createDataFrame([(250.0,), (270.0,), (300.0,)], "t double").select(applied.rate_factor(F.col("t")).alias("a"), applied.cut_window(F.col("t") - 250, 40.0).alias("w"))
    a, w = zip(*df.collect(), strict=True)
    assert a[0] == pytest.approx(3.61e-13 * np.exp(-6e4 / (8.314 * 250))) and a[0] < a[1] < a[2] and w[0] == 1.0 and w[2] == 0.0
    chain = spark.createDataFrame([(k, i, float(k * (i + 1))) for k in range(5) for i in range(3)], "k long, i long, v double")
    assert {r.i: (r["mean"], r["var"]) for r in applied.field_statistics(chain).collect()}[1] == (4.0, 10.0)


def test_streams(spark, tmp_path):
    rows = [(f"2020-01-01 0{h}:10:00", i, float(h + i)) for h in range(4) for i in range(3)]
    df = spark.createDataFrame(rows, "ts string, i long, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = trajectories.levels(stream(), "2 hours").writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("levels").count() == 6
    q = trajectories.running_moments(stream().select("i", "v")).writeStream.outputMode("update").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    got = {r.i: (r.n, r["mean"]) for r in spark.table("moments").collect()}
    assert got[2] == (4, 3.5)
