import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstone.functions import jet
from fieldstone.functions.philox import Random
from fieldstone.operators import algebra as al
from fieldstone.operators import diagnostics as dg
from fieldstone.operators import krylov, randomized, transfer
from fieldstone.operators import matrix as mx
from fieldstone.operators import vector as vec
from fieldstone.parameters import Parameters
from fieldstone.plans import frames
from fieldstone.plans import inverse as iv
from fieldstone.plans import spaces as sp
from fieldstone.plans import time_dependent as td
from fieldstone.sources import cells, mesh


def dense(df, *shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[k] for k in ("i", "j")[: len(shape)])] = r["v"]
    return out


def array(spark, df, n):
    return vec.gather(df, n)


# The sparse diffusion problem beside dense algebra.


def coefficient(mesh_, m):
    return np.exp(m[mesh_.triangles].mean(axis=1))


def dense_gradients(n):
    """Triangles, areas and basis gradients of the square."""
    s = sp.Square(n)
    x = s.corners
    det = (x[:, 1, 0] - x[:, 0, 0]) * (x[:, 2, 1] - x[:, 0, 1]) - (x[:, 2, 0] - x[:, 0, 0]) * (x[:, 1, 1] - x[:, 0, 1])
    g = np.stack([np.stack([x[:, (k + 1) % 3, 1] - x[:, (k + 2) % 3, 1], x[:, (k + 2) % 3, 0] - x[:, (k + 1) % 3, 0]], 1) / det[:, None] for k in range(3)], 1)
    return s, np.abs(det) / 2, g


class Dense:
    def __init__(self, n):
        self.s, self.area, self.g = dense_gradients(n)
        self.dim = (n + 1) ** 2
        y = self.s.vertices[:, 1]
        self.ess = np.flatnonzero((y == 0) | (y == 1))
        self.lift = np.where((y == 0) | (y == 1), y, 0)

    def matrix(self, m):
        local = (self.area * coefficient(self.s, m))[:, None, None] * np.einsum("ead,ebd->eab", self.g, self.g)
        return sp.scatter((self.dim,) * 2, self.s.triangles, self.s.triangles, local)

    def forward(self, m):
        a = self.matrix(m)
        u, free = self.lift.copy(), np.setdiff1d(np.arange(self.dim), self.ess)
        u[free] = np.linalg.solve(a[np.ix_(free, free)], -(a @ self.lift)[free])
        return u

    def cost(self, m, b, d, s2):
        r = b @ self.forward(m) - d
        return r @ r / (2 * s2)


def test_diffusion_gradient_and_hessian(spark):
    n = 3
    ref, elements = Dense(n), mesh.triangles(spark, n)
    problem = frames.Diffusion(elements, mx.essential_where(mesh.vertices(spark, n), F.col("y").isin(0.0, 1.0), F.col("y")), rel=1e-11)
    points = spark.createDataFrame([(k, 0.13 + 0.07 * k, 0.21 + 0.06 * k) for k in range(8)], "t long, x double, y double")
    b_frame = mesh.observation_matrix(points, elements, n)
    b = dense(b_frame, 8, ref.dim)
    r = np.random.default_rng(1)
    m, dm, data, s2 = 0.5 * r.normal(size=ref.dim), r.normal(size=ref.dim), r.random(8), 0.01
    v = lambda a: vec.from_array(spark, a)
    assert np.allclose(array(spark, problem.forward(v(m)), ref.dim), ref.forward(m), atol=1e-9)
    g, u, p = problem.reduced_gradient(b_frame, v(m), v(data), s2)
    f = lambda t: ref.cost(m + t * dm, b, data, s2)
    assert array(spark, g, ref.dim) @ dm == pytest.approx((f(1e-5) - f(-1e-5)) / 2e-5, rel=1e-6)
    hdm = array(spark, problem.hessian(b_frame, s2, v(m), u, p, v(dm)), ref.dim)
    assert dm @ hdm == pytest.approx((f(1e-3) - 2 * f(0) + f(-1e-3)) / 1e-6, rel=1e-3)
    gn = array(spark, problem.hessian(b_frame, s2, v(m), u, p, v(dm), gauss_newton=True), ref.dim)
    du = (ref.forward(m + 1e-5 * dm) - ref.forward(m - 1e-5 * dm)) / 2e-5
    assert dm @ gn == pytest.approx((b @ du) @ (b @ du) / s2, rel=1e-5)


# Other cells: constants, linear functions, volumes.


@pytest.mark.parametrize("dim", [2, 3])
def test_lattice_cells(spark, dim):
    n = 3
    c = cells.lattice_cells(spark, n, dim)
    size = (n + 1) ** dim
    m, k = dense(mx.scatter_add(cells.tensor_mass_entries(c, dim, 1 / n)), size, size), dense(mx.scatter_add(cells.tensor_stiffness_entries(c, dim, 1 / n)), size, size)
    x = (np.arange(size) % (n + 1)) / n
    assert m.sum() == pytest.approx(1) and np.allclose(k.sum(axis=1), 0, atol=1e-12) and x @ k @ x == pytest.approx(1) and x @ m @ x == pytest.approx(1 / 3)


def test_tetrahedra(spark):
    n, size = 2, 27
    t = cells.tetrahedra(spark, n)
    assert cells.tet_geometry(t).agg(F.sum("volume")).first()[0] == pytest.approx(1)
    k = dense(mx.scatter_add(cells.tet_stiffness_entries(t)), size, size)
    y = (np.arange(size) // 3 % 3) / n
    assert np.allclose(k.sum(axis=1), 0, atol=1e-12) and y @ k @ y == pytest.approx(1)
    assert dense(mx.scatter_add(cells.tet_mass_entries(t)), size, size).sum() == pytest.approx(1)


def test_mixed_mesh_reproduces_linear_functions(spark):
    n = 4
    triangles, squares = cells.mixed_halves(spark, n)
    k = dense(mx.scatter_add(mesh.stiffness_entries(triangles).select("i", "j", "v").unionByName(cells.tensor_stiffness_entries(squares, 2, 1 / n).select("i", "j", "v"))), 25, 25)
    s = sp.Square(n)
    u = 2 * s.vertices[:, 0] - s.vertices[:, 1]
    inside = ((s.vertices > 0) & (s.vertices < 1)).all(axis=1)
    assert np.allclose((k @ u)[inside], 0, atol=1e-12) and u @ k @ u == pytest.approx(5)


def test_edge_functions(spark):
    """Gradients have no curl, and a constant field is in the space: its coefficients are differences along edges."""
    n = 3
    t = mesh.triangles(spark, n)
    nv = (n + 1) ** 2
    ends = cells.edges(t, nv).select(F.explode("edge").alias("p")).select(F.col("p.dof").alias("i")).distinct()
    x, y = (lambda v: (v % (n + 1)) / n), (lambda v: F.floor(v / (n + 1)) / n)
    lo, hi = F.floor(F.col("i") / nv), F.col("i") % nv
    constant = ends.select("i", (2 * (x(hi) - x(lo)) - 3 * (y(hi) - y(lo))).alias("v"))
    for r in cells.edge_field(t, nv, constant).collect():
        assert np.allclose(r["val"], [2, -3]) and abs(r["der"]) < 1e-12
    for r in cells.edge_field(t, nv, constant, "div").collect():
        assert np.allclose(r["val"], [-3, -2]) and abs(r["der"]) < 1e-12
    value = vec.inner(mx.spmv(mx.scatter_add(cells.edge_mass_entries(t, nv)), constant), constant).first()[0]
    assert value == pytest.approx(13)


# Boundary and facet densities.


def test_boundary_kernel():
    s = sp.Square(4)
    v = sp.Space(s, 2)
    e, k = sp.boundary_edges(s, 1, 2, 3, 4)
    kernel = jet.BoundaryKernel(lambda u, x, n: 0.5 * u.val * u.val + u.grad[0] * n[0] + u.grad[1] * n[1], (2,))
    f = v.project(lambda x, y: x * x * y)
    dofs = [f[v.dofs[e]]]
    nodal = sp.boundary_edges(s, 2, 3)
    size = jet.BoundaryKernel(lambda u, x, n: 0 * u.val + 1.0, (2,)).values((s.corners[nodal[0]], nodal[1]), [f[v.dofs[nodal[0]]]]).sum()
    flux = jet.BoundaryKernel(lambda u, x, n: u.grad[0] * n[0] + u.grad[1] * n[1], (2,))
    quadratic = v.project(lambda x, y: x * x + 3 * y)
    assert size == pytest.approx(2) and flux.values((s.corners[e], k), [quadratic[v.dofs[e]]]).sum() == pytest.approx(2.0)  # the integral of the Laplacian
    assert np.isfinite(kernel.values((s.corners[e], k), dofs)).all()
    linear = sp.Space(s)
    m = jet.BoundaryKernel(lambda u, x, n: 0.5 * u.val * u.val, (1,)).matrices([(0, 0)], (s.corners[e], k), [np.zeros((len(e), 3))])[0, 0]
    assert np.allclose(sp.scatter((linear.dim,) * 2, linear.dofs[e], linear.dofs[e], m), sp.boundary_mass(linear))


def test_facet_kernel(spark):
    n = 3
    s = sp.Square(n)
    v = sp.Space(s)
    minus, plus, left, right = sp.facets(s)
    assert len(minus) == 3 * n * n + 2 * n - 4 * n
    penalty = lambda u, x, nn: 0.5 * (jet.jump_grad(u)[0] * nn[0] + jet.jump_grad(u)[1] * nn[1]) ** 2
    kernel = jet.FacetKernel(penalty, (1,))
    x = (s.corners[minus], s.corners[plus], left, right)
    zero = [np.zeros((len(minus), 3))] * 2
    sides = {0: v.dofs[minus], 1: v.dofs[plus]}
    got = sum(sp.scatter((v.dim,) * 2, sides[i], sides[j], m) for (i, j), m in kernel.matrices([(0, 0), (0, 1), (1, 0), (1, 1)], x, zero).items())
    assert np.allclose(got, dense(mx.scatter_add(cells.facet_penalty_entries(mesh.triangles(spark, n), n)), v.dim, v.dim))
    assert jet.facet_symmetry_defect(penalty, 1) < 1e-14 and jet.facet_symmetry_defect(lambda u, x, nn: jet.jump(u), 1) > 0.1
    assert jet.facet_symmetry_defect(lambda u, x, nn: jet.jump(u) * (jet.avg_grad(u)[0] * nn[0] + jet.avg_grad(u)[1] * nn[1]) + jet.avg(u) ** 2, 1) < 1e-14


def test_products_without_blocks():
    s = sp.Square(2)
    v = sp.Space(s)
    density = lambda u, m, p, x: jet.exp(m.val) * jet.inner(u.grad, p.grad) + u.val**2 * m.val * p.val
    kernel = jet.ElementKernel(density, (1, 1, 1))
    r = np.random.default_rng(5)
    dofs, first, second = ([r.normal(size=v.dofs.shape) for _ in range(3)] for _ in range(3))
    block = kernel.matrices([(2, 1)], s.corners, dofs)[2, 1]
    assert np.allclose(kernel.product(2, 1, s.corners, dofs, first[1]), np.einsum("eab,eb->ea", block, first[1]))
    h = 1e-6
    moved = lambda t: [d + t * f * (k == 0) for k, (d, f) in enumerate(zip(dofs, second, strict=True))]
    fd = (kernel.product(2, 1, s.corners, moved(h), first[1]) - kernel.product(2, 1, s.corners, moved(-h), first[1])) / (2 * h)
    assert np.allclose(kernel.third_product(2, 1, 0, s.corners, dofs, first[1], second[0]), fd, atol=1e-7)
    along = lambda t: [d + t * f for d, f in zip(dofs, first, strict=True)]
    h = 1e-4
    second_fd = (kernel.vector(2, s.corners, along(h)) - 2 * kernel.vector(2, s.corners, dofs) + kernel.vector(2, s.corners, along(-h))) / h**2
    assert np.allclose(kernel.second_directional(2, s.corners, dofs, [first], [1.0]), second_fd, atol=1e-4)
    assert np.allclose(kernel.in_chunks("vector", 3, s.corners, dofs, 2), kernel.vector(2, s.corners, dofs))


# Time-dependent second derivatives.


@pytest.mark.parametrize("fixed", [True, False])
def test_time_dependent_blocks(fixed):
    v = sp.Space(sp.Square(3))
    step = lambda u, old, m, p, x, t, dt: (u.val - old.val) * p.val + dt * jet.exp(m.val) * jet.inner(u.grad, p.grad) + dt * m.val * m.val * old.val * p.val
    times = np.array([0, 0.1, 0.25, 0.3])
    pr = td.TimeProblem(v, v, step, times, v.on_boundary(1), v.project(lambda x, y: x) if fixed else None)
    r = np.random.default_rng(2)
    m, dm = r.normal(size=v.dim), r.normal(size=v.dim)
    u, p, du = (r.normal(size=(4, v.dim)) for _ in range(3))
    pr.set_second(u, m, p)

    def state_gradient(u, m):
        out = np.zeros_like(u)
        for n in range(1, 4):
            out[n] += pr.residual(n, td.NEW, (u[n], u[n - 1], m, p[n]))
            out[n - 1] += pr.residual(n, td.OLD, (u[n], u[n - 1], m, p[n]))
        return pr._state_rows(out)

    def parameter_gradient(u, m):
        return sum(pr.residual(n, td.PARAM, (u[n], u[n - 1], m, p[n])) for n in range(1, 4))

    h = 1e-6
    assert np.allclose(pr.apply_wum(dm), (state_gradient(u, m + h * dm) - state_gradient(u, m - h * dm)) / (2 * h), atol=1e-6)
    assert np.allclose(pr.apply_wmm(dm), (parameter_gradient(u, m + h * dm) - parameter_gradient(u, m - h * dm)) / (2 * h), atol=1e-6)
    assert np.allclose(pr.apply_wuu(du), 0, atol=1e-12)  # the steps are linear
    moved = pr._state_rows(du.copy())
    assert np.allclose(pr.apply_wmu(du), (parameter_gradient(u + h * moved, m) - parameter_gradient(u - h * moved, m)) / (2 * h), atol=1e-6)
    assert dm @ pr.apply_wmu(du) == pytest.approx((pr.apply_wum(dm) * du).sum())


# Hessians by differences, growing bases, posterior quantities.


def test_fd_hessian_growing_basis_and_quantities():
    v = sp.Space(sp.Square(4))
    ess = v.on_boundary(1, 3)
    problem = iv.Problem(v, v, lambda u, m, p, x: jet.exp(m.val) * jet.inner(u.grad, p.grad), ess, v.coordinates[ess, 1])
    prior = iv.bilaplacian_prior(v, 0.1, 0.5, robin=True)
    b = v.observation(np.array([[0.21 + 0.19 * (k % 4), 0.22 + 0.18 * (k // 4)] for k in range(16)]))
    data, s = iv.observe(b, problem.solve_forward(prior.sample(Random(1).normal(v.dim))), 0.01, Random(2))
    model = iv.Model(problem, prior, iv.GaussianMisfit(b, data, s**2))
    m, dm = 0.1 * Random(5).normal(v.dim), Random(6).normal(v.dim)
    u = model.forward(m)
    act = model.hessian(u, m, model.adjoint(u, m))
    assert np.allclose(iv.fd_hessian(model, m)(dm), act(dm), rtol=1e-4, atol=1e-4 * np.abs(act(dm)).max())
    opt = iv.newton_cg(model, np.zeros(v.dim))
    block = model.hessian_block(opt.u, opt.m, opt.p, misfit_only=True)
    d, uu = iv.growing_low_rank(block, lambda x: prior.r @ x, lambda x: prior.cov @ x, v.dim, Random(7), 6, 0.05)
    full = np.linalg.eigvals(prior.cov @ block(np.eye(v.dim))).real
    assert (full > 0.06).sum() <= len(d) <= (full > 0.04).sum() and np.allclose(d[:8], np.sort(full)[::-1][:8], rtol=1e-3)
    post = iv.Posterior(prior, d, uu, opt.m)
    g = Random(8).normal(v.dim)
    draws = iv.sampled_qoi(post, lambda m: float(g @ m), 400, Random(9))
    assert draws.std() == pytest.approx(iv.linearized_std(post, g), rel=0.15) and draws.mean() == pytest.approx(g @ opt.m, abs=4 * draws.std() / 20)


# Operators, transfers, randomised passes on frames.


def test_operator_algebra(spark):
    r = np.random.default_rng(3)
    a, x, y = r.integers(-3, 4, (6, 4)).astype(float), r.normal(size=4), r.normal(size=6)
    frame = al.Matrix(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(4) if a[i, j]], "i long, j long, v double"))
    fx, fy = vec.from_array(spark, x), vec.from_array(spark, y)
    assert frame.inner(fx, fy).first()[0] == pytest.approx(y @ a @ x)
    op = al.Sum(al.Product(frame.transpose(), frame), al.Identity(), 2.0, -1.0)
    want = 2 * a.T @ a - np.eye(4)
    assert np.allclose(vec.gather(op.mult(fx), 4), want @ x) and np.allclose(vec.gather(op.mult_transpose(fx), 4), want.T @ x)
    assert np.allclose(dense(al.as_matrix(op, fx.select("i")), 4, 4), want)
    with pytest.raises(Exception, match="zero entry"):
        al.Diagonal(vec.from_array(spark, [1.0, 0.0])).solve(vec.from_array(spark, [1.0, 1.0])).collect()
    with pytest.raises(ValueError):
        vec.gather(fx, 4, limit=3)


def test_two_level_cycle_speeds_up_conjugate_gradients(spark):
    n = 8
    a = dense(mx.scatter_add(mesh.stiffness_entries(mesh.triangles(spark, n))), 81, 81)
    inside = np.flatnonzero(((sp.Square(n).vertices > 0) & (sp.Square(n).vertices < 1)).all(axis=1))
    coarse = np.flatnonzero(((sp.Square(n // 2).vertices > 0) & (sp.Square(n // 2).vertices < 1)).all(axis=1))
    p = dense(transfer.refinement(spark, n // 2), 81, 25)[np.ix_(inside, coarse)]
    a = a[np.ix_(inside, inside)]
    ac, d = p.T @ a @ p, np.diag(a)
    cycle = krylov.two_level(lambda x: a @ x, lambda r: 0.6 * r / d, lambda r: p.T @ r, lambda c: p @ c, lambda r: np.linalg.solve(ac, r))
    b = np.random.default_rng(0).normal(size=len(inside))
    plain, better = krylov.cg(lambda x: a @ x, b, rel=1e-8), krylov.cg(lambda x: a @ x, b, cycle, rel=1e-8)
    assert np.allclose(better.x, np.linalg.solve(a, b), atol=1e-5) and better.iterations < plain.iterations / 2


def test_frame_passes(spark):
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.normal(size=(40, 40)))[0]
    spectrum = 10.0 * 0.5 ** np.arange(40)
    a = q * spectrum @ q.T
    frame = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(40)], "i long, j long, v double")
    omega = vec.mv_from_array(spark, r.normal(size=(40, 12)))
    apply = lambda x: randomized.frame_apply(al.Matrix(frame), x, 12)
    d, u = randomized.frame_single_pass(apply, omega, 12, 3)
    assert np.allclose(d, spectrum[:3], rtol=0.05)
    weights = al.Diagonal(vec.from_array(spark, 1.0 + np.arange(40) % 3))
    b = lambda x: randomized.frame_apply(weights, x, 12)
    inverse = al.Diagonal(vec.from_array(spark, 1 / (1.0 + np.arange(40) % 3)))
    d, u = randomized.frame_double_pass_g(apply, b, lambda x: randomized.frame_apply(inverse, x, 12), omega, 12, 3, 2)
    w = 1.0 + np.arange(40) % 3
    want = np.sort(np.linalg.eigvals(a / w[:, None]).real)[::-1][:3]
    assert np.allclose(d, want, rtol=1e-4)
    left = lambda x: randomized.frame_apply(al.Matrix(frame), x, 3)
    res = randomized.frame_residuals(left, u, d, lambda x: randomized.frame_apply(weights, x, 3)).collect()
    assert len(res) == 3 and all(x["l2"] < 0.05 for x in res)


# Chains.


def test_lags_beyond_the_chain_and_short_chains(spark):
    rows = [("a", k, float((k * 7) % 5)) for k in range(6)] + [("b", 0, 3.0)]
    chain = spark.createDataFrame(rows, "key string, k long, q double")
    rho = {(r.key, r.lag): r.rho for r in dg.autocorrelation(chain, 10).collect()}
    assert len(rho) == 22 and all(rho["a", lag] == 0 for lag in range(6, 11)) and rho["b", 0] == 0
    got = {r.key: r for r in dg.chain_summary(chain).collect()}
    assert got["b"].n == 1 and got["b"]["std"] is None and got["b"].iact == 1 and got["b"].ess == 1


def test_chains_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(dg, "BLOCK", 7)
    r = np.random.default_rng(0)
    q = np.cumsum(r.normal(size=100))
    chain = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(q)], "key string, k long, q double")
    d = q - q.mean()
    got = {x.lag: x.rho for x in dg.autocorrelation(chain, 12).collect()}
    for lag in range(13):
        assert got[lag] == pytest.approx((d[: 100 - lag] @ d[lag:]) / (d @ d), abs=1e-12)


def test_parameters():
    p = Parameters({"rel_tol": (1e-6, "relative tolerance"), "max_iter": (20, "iterations")}).update(max_iter=5)
    assert p["max_iter"] == 5 and p.about("rel_tol") == "relative tolerance" and list(p) == ["rel_tol", "max_iter"]
    with pytest.raises(KeyError):
        p["tol"]
    with pytest.raises(KeyError):
        p["tol"] = 1
