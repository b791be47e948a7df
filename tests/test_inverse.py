import numpy as np
import pytest

from fieldstone.functions import jet
from fieldstone.functions.philox import Random
from fieldstone.operators import diagnostics as dg
from fieldstone.plans import chains as ch
from fieldstone.plans import forward_uq as uq
from fieldstone.plans import inverse as iv
from fieldstone.plans import spaces as sp
from fieldstone.plans import time_dependent as td


def darcy(u, m, p, x):
    return jet.exp(m.val) * jet.inner(u.grad, p.grad)


def poisson(u, m, p, x):
    return jet.inner(u.grad, p.grad) - m.val * p.val


def nonlinear(u, m, p, x):
    return jet.exp(m.val) * jet.inner(u.grad, p.grad) + u.val**3 * p.val - p.val


@pytest.fixture(scope="module")
def linear():
    mesh = sp.Square(6)
    v = sp.Space(mesh)
    r = np.random.default_rng(1)
    problem = iv.Problem(v, v, poisson, v.on_boundary(1, 2, 3, 4))
    b = v.observation(0.15 + 0.7 * r.random((8, 2)))
    prior = iv.bilaplacian_prior(v, 1.0, 4.0)
    d, _ = iv.observe(b, problem.solve_forward(prior.sample(Random(3).normal(v.dim))), 0.05, Random(4))
    return iv.Model(problem, prior, iv.GaussianMisfit(b, d, 0.0005**2))


def darcy_model(n=6, order=2, density=darcy, lin=True):
    mesh = sp.Square(n)
    v, q = sp.Space(mesh, order), sp.Space(mesh)
    ess = v.on_boundary(1, 3)
    problem = iv.Problem(v, q, density, ess, v.coordinates[ess, 1], linear=lin)
    prior = iv.bilaplacian_prior(q, 0.1, 0.5, theta=((2.0, 0.3), (0.3, 0.5)), robin=True)
    b = v.observation(np.array([[0.2 + 0.2 * (k % 4), 0.2 + 0.2 * (k // 4)] for k in range(16)]) + 0.013)
    d, s = iv.observe(b, problem.solve_forward(prior.sample(Random(1).normal(q.dim))), 0.01, Random(2))
    return iv.Model(problem, prior, iv.GaussianMisfit(b, d, s * s))


def test_jets_against_finite_differences():
    z = np.array([[0.3, 0.7, 1.2]])
    f = lambda a, b, c: jet.exp(a * b) / jet.sqrt(c) + jet.log(c + a) * jet.sin(b) - jet.cos(a) ** 3 + jet.tanh(b) / (1 + c)
    js = [jet.Jet(z[:, k], np.eye(3)[k][None], np.zeros((1, 3, 3))) for k in range(3)]
    got, h = f(*js), 1e-5
    at = lambda x: float(np.ravel(f(*x))[0])
    for i in range(3):
        e = h * np.eye(3)[i]
        assert got.g[0, i] == pytest.approx((at(z[0] + e) - at(z[0] - e)) / (2 * h), rel=1e-7)
        for j in range(3):
            e2 = h * 10 * np.eye(3)[j]
            e1 = e * 10
            assert got.h[0, i, j] == pytest.approx((at(z[0] + e1 + e2) - at(z[0] + e1 - e2) - at(z[0] - e1 + e2) + at(z[0] - e1 - e2)) / (4 * (10 * h) ** 2), rel=1e-4, abs=1e-5)


def test_rules_and_bases():
    from math import factorial

    for degree in (1, 3, 6):
        pts, w = jet.triangle_rule(degree)
        for a in range(degree + 1):
            for b in range(degree + 1 - a):
                assert (w * pts[:, 0] ** a * pts[:, 1] ** b).sum() == pytest.approx(factorial(a) * factorial(b) / factorial(a + b + 2))
    v = sp.Space(sp.Square(3), 2)
    assert v.dim == 49 and sp.mass(v).sum() == pytest.approx(1) and np.allclose(sp.stiffness(v).sum(axis=1), 0, atol=1e-12)


def test_observation_and_refusals(linear):
    v = sp.Space(sp.Square(5), 2)
    f = v.project(lambda x, y: x * y + x * x)
    pts = np.random.default_rng(0).random((30, 2))
    assert np.allclose(v.observation(pts) @ f, pts[:, 0] * pts[:, 1] + pts[:, 0] ** 2)
    with pytest.raises(ValueError):
        v.observation(np.array([[1.5, 0.5]]))
    with pytest.raises(ValueError):
        iv.GammaMisfit(np.eye(2), np.ones(2), 2.0).cost(np.array([1.0, -1.0]), None)
    with pytest.raises(ValueError):
        iv.laplacian_prior(v, 1.0, 0.0)
    with pytest.raises(ValueError):
        bad = iv.Problem(v, v, nonlinear, v.on_boundary(1))
        bad.solve_forward(np.zeros(v.dim))


def slopes(table, column, lo=1e-6, hi=1e-2):
    rows = [r for r in table if lo <= r[0] <= hi]
    return np.median([np.log(a[column] / b[column]) / np.log(a[0] / b[0]) for a, b in zip(rows, rows[1:], strict=False)])


@pytest.mark.parametrize("density,lin", [(darcy, True), (nonlinear, False)])
def test_gradient_and_hessian(density, lin):
    model = darcy_model(4, 2, density, lin)
    n = len(model.prior.mean)
    table = iv.model_verify(model, 0.1 * Random(5).normal(n), Random(6).normal(n), 20)
    assert 0.8 < slopes(table, 1) < 1.3 and 0.8 < slopes(table, 2) < 1.3


def test_third_derivative():
    model = darcy_model(3, 1)
    pr, r = model.problem, np.random.default_rng(3)
    x, t = [r.normal(size=s.dim) for s in pr.spaces], [r.normal(size=s.dim) for s in pr.spaces]
    h = 1e-6
    up, down = (pr.matrices([(0, 1)], [a + s * h * b for a, b in zip(x, t, strict=True)])[0, 1] for s in (1, -1))
    assert np.allclose(pr.third(0, 1, x, t), (up - down) / (2 * h), atol=1e-6)


def test_optimizers_agree():
    model = darcy_model(5, 1)
    m0 = np.zeros(len(model.prior.mean))
    ls, tr = iv.newton_cg(model, m0), iv.newton_cg(model, m0, globalization="TR", most=40)
    qn = iv.bfgs(model, m0, rel=1e-7)
    sd = iv.steepest_descent(model, m0, rel=1e-2, most=60, alpha=1e-3)
    assert ls.reason == "gradient" and tr.reason == "gradient"
    assert np.allclose(ls.m, tr.m, atol=1e-3) and np.allclose(ls.m, qn.m, atol=1e-3) and sd.cost < model.cost(model.forward(m0), m0)[0]
    box = iv.bfgs(model, m0, bounds=(-0.1, 0.1), most=20)
    assert np.abs(box.m).max() <= 0.1 + 1e-12


def exact_posterior(model):
    h = np.linalg.inv(model.prior.cov)
    n = len(model.prior.mean)
    u0 = model.forward(np.zeros(n))
    f = np.stack([model.forward(e) - u0 for e in np.eye(n)], axis=1)
    g = model.misfit.b @ f
    h = h + g.T @ g / model.misfit.variance
    mean = np.linalg.solve(h, g.T @ (model.misfit.d - model.misfit.b @ u0) / model.misfit.variance)
    return mean, np.linalg.inv(h)


def test_laplace_is_exact_for_a_linear_problem(linear):
    opt = iv.newton_cg(linear, np.zeros(len(linear.prior.mean)), rel=1e-10)
    mean, cov = exact_posterior(linear)
    assert np.allclose(opt.m, mean, atol=1e-5)
    post = iv.laplace(linear, opt, Random(7), 12, 20, 2)
    assert np.allclose(post.pointwise_variance()[0], np.diag(cov), rtol=1e-5)
    assert post.trace()[0] == pytest.approx(np.trace(cov @ linear.prior.m), rel=1e-6)
    assert np.allclose(post.solve(post.hessian(mean)), mean, atol=1e-6)
    draws = np.stack([post.sample(Random(100 + k).normal(len(mean))) for k in range(3000)])
    assert np.allclose(draws.var(axis=0), np.diag(cov), rtol=0.25)
    kl = 0.5 * (np.trace(linear.prior.r @ cov) - len(mean) + np.linalg.slogdet(linear.prior.cov)[1] - np.linalg.slogdet(cov)[1]) + linear.prior.cost(post.mean)
    assert post.kl_from_prior() == pytest.approx(kl, rel=1e-4)


def test_priors():
    v = sp.Space(sp.Square(5))
    prior = iv.bilaplacian_prior(v, 1.0, 3.0)
    rng = Random(1)
    exact = prior.pointwise_variance()
    assert np.allclose(prior.pointwise_variance("MonteCarlo", rng, 3000), exact, rtol=0.25)
    assert prior.pointwise_variance("Randomized", rng, 30) == pytest.approx(exact, rel=0.2)
    assert prior.trace("Randomized", rng) == pytest.approx(prior.trace(), rel=1e-6)
    assert prior.trace("Estimator", rng, 0.02) == pytest.approx(prior.trace(), rel=0.2)
    assert iv.mollified_prior(v, 1.0, 3.0, np.array([[0.5, 0.5]]), np.ones(v.dim)).mean.max() > 0
    g, d = iv.matern_coefficients(2.0, 0.3, 2)
    assert 1 / (4 * np.pi * g * d) == pytest.approx(2.0)  # variance in the plane


def test_chains(linear, spark):
    mean, cov = exact_posterior(linear)
    opt = iv.newton_cg(linear, np.zeros(len(mean)), rel=1e-10)
    post = iv.laplace(linear, opt, Random(7), 12, 20, 2)
    ell = np.ones(len(mean)) / len(mean)
    qoi = lambda u, m: float(ell @ m)
    sd = np.sqrt(ell @ cov @ ell)
    for kernel, n, accepted in ((ch.GPCN(linear, post, 0.5), 600, 0.85), (ch.Importance(linear, post), 300, 1.0)):
        out = ch.run_chain(kernel, post.mean, qoi, Random(11), n, 50)
        assert out.accepted.mean() >= accepted and abs(out.q.mean() - ell @ mean) < 0.4 * sd
    assert np.ptp(out.logw) < 1e-4  # the Laplace posterior is the posterior
    mala = ch.run_chain(ch.MALA(linear, 0.1 / (1 + post.d.max())), post.mean, qoi, Random(12), 200, 20)
    assert 0.3 < mala.accepted.mean() <= 1
    frame = ch.run_chains(spark, lambda: (ch.PCN(linear, 0.02), post.mean, qoi), 3, 60, 5)
    got = frame.toPandas()
    assert len(got) == 180 and got.groupby("chain").q.nunique().min() > 5
    assert dg.chain_summary(frame.withColumnRenamed("chain", "key").select("key", "k", "q"), 10).count() == 3


def test_known_autocorrelation(spark):
    r, n = np.random.default_rng(0), 20000
    x = np.zeros(n)
    for k in range(1, n):
        x[k] = 0.8 * x[k - 1] + r.normal()
    import pandas as pd

    chain = spark.createDataFrame(pd.DataFrame({"key": "a", "k": np.arange(n), "q": x}))
    assert dg.iact(dg.autocorrelation(chain, 100)).first()["iact"] == pytest.approx(9, rel=0.25)


def test_forward_uq(spark):
    model = darcy_model(4, 1)
    prior = iv.bilaplacian_prior(model.problem.spaces[1], 2.0, 20.0)
    v = model.problem.spaces[0]
    qmap = uq.QoiMap(model.problem, uq.l2_norm_qoi(v), prior)
    n = len(prior.mean)
    errors = qmap.verify(0.1 * Random(1).normal(n), Random(2).normal(n), [1e-3, 1e-4])
    assert errors[1][1] < 0.2 * errors[0][1]
    assert uq.DensityQoi(v, lambda u, x: 0.5 * u.val * u.val).cost(qmap.forward(prior.mean), None) == pytest.approx(qmap.value(prior.mean))
    taylor = uq.TaylorModel(qmap, n, Random(3), 0, 2)
    m = prior.sample(Random(4).normal(n))
    assert taylor.value(m) == pytest.approx(taylor.value_low_rank(m), rel=1e-6)
    out = uq.variance_reduction(qmap, taylor, 60, Random(5))
    assert out["factor"] > 5 and abs(out["mc"] - out["cv"]) < 5 * out["mc_err"]
    assert uq.mean_state_qoi(v).cost(np.ones(v.dim), None) == pytest.approx(1) and uq.NullQoi(v).cost(m, None) == 0

    def make():
        return lambda xi: ((lambda s: (qmap.value(s), taylor.value_low_rank(s)))(prior.sample(xi)))

    frame = uq.sample_frame(spark, make, n, 40, 4)
    assert dg.control_variate(frame.selectExpr("0 AS key", "q", "t")).first()["factor"] > 5


def test_time_dependent(spark):
    mesh = sp.Square(4)
    v = sp.Space(mesh)
    step = lambda u, old, m, p, x, t, dt: (u.val - old.val) * p.val + dt * jet.exp(m.val) * jet.inner(u.grad, p.grad)
    times = np.array([0, 0.01, 0.02, 0.03, 0.05])
    start = v.project(lambda x, y: np.sin(np.pi * x) * np.sin(np.pi * y))
    pr = td.TimeProblem(v, v, step, times, v.on_boundary(1, 2, 3, 4), start)
    b = v.observation(np.array([[0.3, 0.4], [0.6, 0.7]]))
    misfit = td.TrajectoryMisfit({n: iv.GaussianMisfit(b, np.array([0.2, 0.1]), 0.01) for n in (2, 4)})

    def cost_grad(m):
        u = pr.forward(m)
        p = pr.adjoint(m, -misfit.grad(u))
        return misfit.cost(u), pr.gradient(u, m, p), u

    r = np.random.default_rng(1)
    m, d, h = 0.1 * r.normal(size=v.dim), r.normal(size=v.dim), 1e-6
    c, g, u = cost_grad(m)
    assert (cost_grad(m + h * d)[0] - cost_grad(m - h * d)[0]) / (2 * h) == pytest.approx(g @ d, rel=1e-6)
    pr.set_point(m, u)
    du = pr.incremental(d)
    assert np.allclose(du, (pr.forward(m + h * d) - pr.forward(m - h * d)) / (2 * h), atol=1e-6)
    pr.set_point(m, u)
    dp = r.normal(size=u.shape)
    assert (pr.apply_c(d) * dp)[1:].sum() == pytest.approx(pr.apply_ct(dp) @ d)
    ic = td.TimeProblem(v, v, lambda u, old, m, p, x, t, dt: (u.val - old.val) * p.val + dt * jet.inner(u.grad, p.grad), times, v.on_boundary(1, 2, 3, 4))

    def from_initial(m):
        u = ic.forward(m)
        p = ic.adjoint(m, -misfit.grad(u))
        return misfit.cost(u), ic.gradient(u, m, p)

    d[ic.ess] = 0
    g = from_initial(start)[1]
    assert (from_initial(start + h * d)[0] - from_initial(start - h * d)[0]) / (2 * h) == pytest.approx(g @ d, rel=1e-6)
    frame = td.trajectory_frame(spark, times, u)
    assert frame.count() == u.size
    with pytest.raises(NotImplementedError):
        pr.third()


def test_frames_assemble_the_same(spark):
    mesh = sp.Square(4)
    v, q = sp.Space(mesh, 2), sp.Space(mesh)
    pr = iv.Problem(v, q, darcy, v.on_boundary(1))
    r = np.random.default_rng(2)
    x = [r.normal(size=s.dim) for s in pr.spaces]
    elements = sp.element_frame(spark, list(pr.spaces), 3)
    for k, values in enumerate(x):
        elements = sp.gather(elements, k, spark.createDataFrame(list(enumerate(values.tolist())), "i long, v double"))
    got = np.zeros(q.dim)
    for row in sp.assemble_vector(elements, pr.kernel, 1).collect():
        got[row.i] = row.v
    assert np.allclose(got, pr.residual(1, x))
    want = pr.matrices([(2, 0), (2, 1)], x)
    blocks = {"20": np.zeros((v.dim, v.dim)), "21": np.zeros((v.dim, q.dim))}
    for row in sp.assemble_matrices(elements, pr.kernel, [(2, 0), (2, 1)]).collect():
        blocks[row.block][row.i, row.j] = row.v
    assert np.allclose(blocks["20"], want[2, 0]) and np.allclose(blocks["21"], want[2, 1])


def test_leapfrog_is_stable_below_its_bound():
    v = sp.Space(sp.Square(5))
    k, lumped = sp.stiffness(v), sp.mass(v).sum(axis=1)
    dt = td.stable_step(lumped, k, 300)
    push = np.zeros(v.dim)
    push[17] = 1.0
    calm, wild = (td.leapfrog(lumped, k, lambda n: push * (n == 0), c * dt, 400) for c in (0.95, 1.1))
    assert np.abs(calm[-1] - calm[-1].mean()).max() < 50 and np.abs(wild[-1]).max() > 1e3 * np.abs(calm).max()
