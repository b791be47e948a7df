import numpy as np
import pytest

from fieldstone.functions import philox
from fieldstone.operators import krylov as kr
from fieldstone.operators import matrix as mx
from fieldstone.operators import randomized as rz
from fieldstone.sources import mesh


@pytest.fixture(scope="module")
def spd():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(40, 40)))[0]
    return (q * np.linspace(0.5, 20, 40)) @ q.T, r.normal(size=40)


def test_array_solvers(spd):
    a, b = spd
    op = lambda x: a @ x
    want = np.linalg.solve(a, b)
    for solver in (kr.cg, kr.bicgstab, kr.gmres, kr.minres):
        assert np.allclose(solver(op, b).x, want, atol=1e-8), solver
    indefinite = a - 5.2 * np.eye(40)  # no eigenvalue is zero
    assert np.allclose(kr.minres(lambda x: indefinite @ x, b).x, np.linalg.solve(indefinite, b), atol=1e-6)
    x = kr.chebyshev(op, b, 0.5, 20, 60)
    e = x - want
    assert np.sqrt(e @ a @ e) <= kr.chebyshev_bound(0.5, 20, 60) * np.sqrt(want @ a @ want) * (1 + 1e-9)
    with pytest.raises(kr.NotConverged):
        kr.cg(op, b, max_iter=3)
    root = kr.lanczos_function(op, b, np.sqrt, 40)
    d, q = np.linalg.eigh(a)
    assert np.allclose(root, (q * np.sqrt(d)) @ (q.T @ b), atol=1e-8)


def test_steihaug(spd):
    a, b = spd
    op = lambda x: a @ x
    assert kr.steihaug(op, b).reason == "converged"
    cut = kr.steihaug(op, b, radius=0.1)
    assert cut.reason == "boundary" and np.linalg.norm(cut.x) == pytest.approx(0.1)
    bad = a - 10 * np.eye(40)
    free, ball = kr.steihaug(lambda x: bad @ x, b), kr.steihaug(lambda x: bad @ x, b, radius=1.0)
    assert free.reason == "negative" and ball.reason in ("negative", "boundary") and np.linalg.norm(ball.x) == pytest.approx(1.0)


def test_cg_sampler_covariance():
    a = np.diag([1.0, 4.0, 9.0])
    r = np.random.default_rng(0)
    draws = np.array([kr.cg_sample(lambda x: a @ x, r.normal(size=3), r.normal(size=10)) for _ in range(6000)])
    assert np.allclose(np.cov(draws.T), np.linalg.inv(a), atol=0.06)
    with pytest.raises(ValueError):
        kr.cg_sample(lambda x: a @ x, np.ones(3), [1.0])


def test_randomised(spd):
    a, _ = spd
    r = np.random.default_rng(2)
    op = lambda x: a @ x
    d0 = np.sort(np.linalg.eigvalsh(a))[::-1][:5]
    d, u = rz.double_pass(op, r.normal(size=(40, 25)), 5, 6)
    assert np.allclose(d, d0, rtol=1e-3) and rz.residuals(op, u, d)[1] < 1e-10
    m = np.diag(np.linspace(1, 3, 40))
    l = np.linalg.cholesky(m)
    want = np.sort(np.linalg.eigvalsh(np.linalg.solve(l, np.linalg.solve(l, a).T)))[::-1][:4]
    d, u = rz.double_pass_g(op, lambda x: m @ x, lambda x: np.linalg.solve(m, x), r.normal(size=(40, 40)), 4, 2)
    assert np.allclose(d, want, rtol=1e-8) and rz.residuals(op, u, d, lambda x: m @ x)[0].max() < 1e-6
    low = (lambda w: w @ w.T)(r.normal(size=(40, 3)))
    for one in (rz.single_pass(lambda x: low @ x, r.normal(size=(40, 12)), 3)[0], rz.single_pass_g(lambda x: low @ x, lambda x: x, lambda x: x, r.normal(size=(40, 12)), 3)[0]):
        assert np.allclose(one, np.sort(np.linalg.eigvalsh(low))[::-1][:3], rtol=1e-6)
    c = r.normal(size=(30, 20))
    u, s, v = rz.svd(lambda x: c @ x, lambda x: c.T @ x, r.normal(size=(20, 20)), 6, 3)
    assert np.allclose(s, np.linalg.svd(c)[1][:6], rtol=1e-7) and np.allclose(c @ v, u * s, atol=1e-8)
    with pytest.raises(ValueError):
        rz.double_pass(op, r.normal(size=(40, 2)), 3)
    probes = (np.where(r.random(40) < 0.5, -1.0, 1.0) for _ in range(100))
    mean, err, n = rz.trace_estimate(op, probes, accuracy=1e-3)
    assert abs(mean - np.trace(a)) < 5 * err + 1e-9 and 5 <= n <= 100
    assert np.allclose(rz.diagonal_estimate(lambda x: x * 2.0, np.ones((4, 7))), 2)


def test_philox_is_numpy_s():
    for seed in (1, 12345, 2**63 + 7):
        want = np.random.Philox(key=seed).random_raw(41)
        assert (philox.words_at(seed, np.arange(41)) == want).all()
    z = philox.normals_at(3, np.arange(20000))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.02
    s = philox.Random(4)
    a = s.normal(10)
    s.seek(3)
    assert (s.normal(4) == a[3:7]).all() and s.tell() == 7


def test_draws_do_not_depend_on_partitions(spark):
    one = [r.v for r in philox.with_draws(spark.range(0, 100, 1, 1), "id", 5).orderBy("id").collect()]
    many = [r.v for r in philox.with_draws(spark.range(0, 100, 1, 7), "id", 5).orderBy("id").collect()]
    assert one == many == philox.normals_at(5, np.arange(100)).tolist()


def test_frame_solvers_and_eigenpairs(spark):
    from fieldstone.shared import written

    n = 16
    t = mesh.triangles(spark, 3)
    a = written(mx.add(mx.scatter_add(mesh.stiffness_entries(t)), mx.scatter_add(mesh.mass_entries(t)), 1.0, 30.0), "a")
    b = mesh.vertices(spark, 3).selectExpr("vid AS i", "x + 1 AS v")
    dense, rhs = kr.to_dense(a, n), kr.Vec(b).to_numpy(n)
    want = np.linalg.solve(dense, rhs)
    assert np.allclose(kr.Vec(kr.auto_solve(a, b, n)).to_numpy(n), want)
    assert np.allclose(kr.Vec(kr.frame_cg(a, b, rel=1e-4).x).to_numpy(n), want, atol=1e-3)
    lo, hi = np.linalg.eigvalsh(dense)[[0, -1]]
    x = kr.chebyshev(kr.frame_operator(a), kr.Vec(b), lo, hi, 4)
    assert np.allclose(x.to_numpy(n), kr.chebyshev(lambda v: dense @ v, rhs, lo, hi, 4))
    omega = spark.createDataFrame([(i, philox.normals_at(9, np.arange(8 * i, 8 * i + 8)).tolist()) for i in range(n)], "i long, x array<double>")
    d, u = rz.frame_double_pass(a, omega, 8, 2, 2)
    assert np.allclose(d, np.sort(np.linalg.eigvalsh(dense))[::-1][:2], rtol=0.05) and u.count() == n
