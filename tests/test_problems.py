import numpy as np
import pytest

from fieldstone.functions import jet
from fieldstone.functions.philox import Random
from fieldstone.operators import krylov
from fieldstone.plans import chains as ch
from fieldstone.plans import inverse as iv
from fieldstone.plans import spaces as sp
from fieldstone.plans import time_dependent as td


@pytest.fixture(scope="module")
def model():
    v = sp.Space(sp.Square(3))
    ess = v.on_boundary(1, 3)
    problem = iv.Problem(v, v, lambda u, m, p, x: jet.exp(m.val) * jet.inner(u.grad, p.grad), ess, v.coordinates[ess, 1])
    prior = iv.bilaplacian_prior(v, 0.1, 0.5, robin=True)
    b = v.observation(np.array([[0.21 + 0.19 * (k % 4), 0.22 + 0.18 * (k // 4)] for k in range(16)]))
    data, s = iv.observe(b, problem.solve_forward(prior.sample(Random(1).normal(v.dim))), 0.05, Random(2))
    return iv.Model(problem, prior, iv.GaussianMisfit(b, data, s**2))


def test_products_at_a_point(model):
    pr, r = model.problem, np.random.default_rng(0)
    x = [r.normal(size=s.dim) for s in pr.spaces]
    t = [r.normal(size=s.dim) for s in pr.spaces]
    pr.set_point(x)
    for i, j in ((iv.ADJOINT, iv.PARAMETER), (iv.PARAMETER, iv.PARAMETER), (iv.PARAMETER, iv.ADJOINT)):
        d = t[j].copy()
        if j != iv.PARAMETER:
            d[pr.ess] = 0
        assert np.allclose(pr.apply_at(i, j, x, t[j]), pr.apply(i, j, d))
    h = 1e-5
    moved = lambda e: [a + e * b for a, b in zip(x, t, strict=True)]
    fd = (pr.residual(iv.PARAMETER, moved(h)) - 2 * pr.residual(iv.PARAMETER, x) + pr.residual(iv.PARAMETER, moved(-h))) / h**2
    assert np.allclose(pr.third_directional(iv.PARAMETER, x, [t, t], [0.25, 0.75]), fd, rtol=1e-3, atol=1e-3)
    ahead, back = ([x[0], x[1] + e * t[1], x[2]] for e in (h, -h))
    k = lambda y: pr._scattered(iv.ADJOINT, pr.kernel.product(iv.ADJOINT, iv.STATE, pr.spaces[0].mesh.corners, pr._dofs(y), t[0][pr.spaces[0].dofs]))
    assert np.allclose(pr.third_product(iv.ADJOINT, iv.STATE, iv.PARAMETER, x, t[0], t[1]), (k(ahead) - k(back)) / (2 * h), atol=1e-6)
    pr.release()
    assert pr.blocks == {}


def test_vector_prior():
    v = sp.Space(sp.Square(3))
    prior, one = iv.VectorPrior(v, [0.1, 0.1], [0.5, 0.5]), iv.bilaplacian_prior(v, 0.1, 0.5)
    m = np.random.default_rng(1).normal(size=2 * v.dim)
    assert prior.cost(m) == pytest.approx(one.cost(m[: v.dim]) + one.cost(m[v.dim :])) and prior.cost(m) == pytest.approx(0.5 * m @ prior.grad(m))
    assert np.allclose(prior.solve(prior.grad(m)), m, atol=1e-6) and prior.sample(m).shape == m.shape
    with pytest.raises(ValueError):
        iv.VectorPrior(v, [0.1, 0.2], [0.5, 0.5])


def test_refinement_of_a_rough_solver():
    r = np.random.default_rng(2)
    a = r.normal(size=(20, 20)) + 10 * np.eye(20)
    rough = lambda b: np.linalg.solve(a.astype(np.float32), b.astype(np.float32)).astype(float)
    b = r.normal(size=20)
    got = krylov.refined(lambda x: a @ x, rough, b, 1e-13)
    assert np.linalg.norm(b - a @ got.x) <= 1e-13 * np.linalg.norm(b) and got.iterations > 0
    with pytest.raises(krylov.NotConverged):
        krylov.refined(lambda x: a @ x, lambda r: 1e-3 * r, b, 1e-13)


def test_leapfrog_transpose_and_increment():
    r = np.random.default_rng(3)
    n, steps, dt = 6, 9, 0.1
    mass, k = 1 + r.random(n), (q := r.normal(size=(n, n))) @ q.T
    f, w = r.normal(size=(steps, n)), r.normal(size=(steps + 1, n))
    u = td.leapfrog(mass, k, lambda s: f[s], dt, steps)
    assert (w[1:] * u[1:]).sum() == pytest.approx((td.leapfrog_adjoint(mass, k, w, dt) * f).sum())
    dk, h = r.normal(size=(n, n)), 1e-6
    moved = lambda t: td.leapfrog(mass, k + t * dk, lambda s: f[s], dt, steps)
    assert np.allclose(td.leapfrog_incremental(mass, k, dk, u, dt), (moved(h) - moved(-h)) / (2 * h), atol=1e-7)


def test_initial_condition_problem():
    v = sp.Space(sp.Square(3))
    step = lambda u, old, m, p, x, t, dt: (u.val - old.val) * p.val + dt * jet.inner(u.grad, p.grad)
    pr = td.initial_condition_problem(v, step, np.array([0, 0.1, 0.2]), np.array([], int))
    m = np.random.default_rng(4).normal(size=v.dim)
    u = pr.forward(m)
    assert np.array_equal(u[0], m) and sp.mass(v).sum(axis=0) @ u[2] == pytest.approx(sp.mass(v).sum(axis=0) @ m)


def test_tracers_and_streams(model):
    tracer, m0 = ch.FullTracer(), np.zeros(model.problem.spaces[1].dim)
    kernel = ch.PCN(model, 0.2)
    rng = Random(5)
    rows = ch.run_chain(kernel, m0, lambda u, m: float(m[0]), rng, 12, 3, tracer)
    assert len(tracer.m) == len(tracer.u) == 12 and [m[0] for m in tracer.m] == rows["q"].tolist()
    other = Random(5)
    ch.consume_random(kernel, other, len(m0), 15)
    assert other.tell() == rng.tell()
