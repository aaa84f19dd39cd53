import math

import numpy as np
import pytest

from lumivox.functions import numeric as N
from lumivox.operators import solvers as S

RNG = np.random.default_rng(3)


def test_harmonics_are_orthonormal():
    x, w = np.polynomial.legendre.leggauss(24)
    phi = np.arange(48) * 2 * np.pi / 48
    z, p = np.meshgrid(x, phi, indexing="ij")
    r = np.sqrt(1 - z**2)
    d = np.stack([r * np.cos(p), r * np.sin(p), z], axis=-1).reshape(-1, 3)
    y = N.sh_matrix(d, 8)
    gram = y.T @ (np.repeat(w, 48)[:, None] * y) * 2 * np.pi / 48
    assert np.abs(gram - np.eye(45)).max() < 1e-12


def test_hemisphere_has_one_of_each_pair():
    h = N.hemisphere(8)
    assert h.shape == (321, 3)
    cos = np.abs(h @ h.T) - np.eye(321)
    assert cos.max() < 0.999


def test_special_functions():
    assert N.factorial(5) == pytest.approx(120)
    assert N.laguerre(2, 0.5, np.array([1.3]))[0] == pytest.approx(1.3**2 / 2 - 2.5 * 1.3 + 1.5 * 2.5 / 2)
    assert N.hyp2f1(-2, 1.5, 2.5, 2.0) == pytest.approx(1 - 2 * 1.5 / 2.5 * 2 + 1.5 * 2.5 / (2.5 * 3.5) * 4)
    assert N.binomial(2.5, 2) == pytest.approx(2.5 * 1.5 / 2)


def test_shells_follow_volume_order_and_merge_small_ones():
    s = N.shells([0, 990, 1005, 2000, 10, 1040, 2010])
    assert [(round(b), v) for b, v in s] == [(0, [0, 4]), (1012, [1, 2, 5]), (2005, [3, 6])]
    merged = N.merge_small_shells(s, 3)
    assert [v for _, v in merged] == [[0, 4], [1, 2, 3, 5, 6]]


def multishell():
    v = np.arange(64)
    gz = 1 - 2 * (v + 0.5) / 64
    r = np.sqrt(1 - gz * gz)
    g = np.stack([r * np.cos(v * 2.399963), r * np.sin(v * 2.399963), gz], axis=1)
    return np.concatenate([[0], np.repeat([1000.0, 2000, 3000, 4000], 64)]), np.vstack([[0, 0, 0], *[g] * 4])


def test_propagator_scalars_of_an_isotropic_signal():
    b, g = multishell()
    tau, d = 0.0431 - 0.0107 / 3, 0.7e-3
    m = N.shore_matrix(N.q_magnitude(b, tau)[:, None] * g, 6, 700.0)
    assert m.shape[1] == 72
    pn, pl = N.shore_penalties(6)
    c = S.Tikhonov(m, 1e-8 * (pn + pl)).fit(np.exp(-b * d)[None])[0]
    w = N.scalar_weights(6, 700.0)
    e0 = c @ w["e0"]
    y = N.sh_matrix(np.array([[0, 0.6, 0.8]]), 6)[0]
    at = [N.sh_index(l, k) for _, l, k in N.shore_indices(6)]
    assert e0 == pytest.approx(1, abs=0.01)
    assert c @ w["rtop"] / e0 == pytest.approx((4 * math.pi * d * tau) ** -1.5, rel=0.1)
    assert c @ w["msd"] / e0 == pytest.approx(6 * d * tau, rel=0.1)
    assert (c * N.axis_weights(6, 700.0, False) * y[at]).sum() / e0 == pytest.approx(1 / (4 * math.pi * d * tau), rel=0.1)
    assert (c * N.axis_weights(6, 700.0, True) * y[at]).sum() / e0 == pytest.approx((4 * math.pi * d * tau) ** -0.5, rel=0.1)
    assert 1 / (c @ w["q2"] / e0) > 0


@pytest.mark.parametrize("positive", [False, True])
def test_lasso_meets_its_optimality_conditions(positive):
    m, s = RNG.normal(size=(40, 12)), RNG.normal(size=(30, 40))
    fit = S.Lasso(m, 20_000, 1e-12, positive)
    alpha = fit.alpha_max(s) * 0.3
    c, _ = fit.fit(s, alpha)
    g = (s - c @ m.T) @ m / 40
    off = np.where(c != 0, np.abs(g - np.sign(c) * alpha[:, None]), np.maximum((g if positive else np.abs(g)) - alpha[:, None], 0))
    assert off.max() < 1e-6
    assert not fit.fit(s, fit.alpha_max(s) * 1.001)[0].any()


def test_paths_pick_planted_support_and_stay_within_slack():
    m = RNG.normal(size=(80, 20))
    c = np.zeros((5, 20))
    for k in range(5):
        c[k, [k, k + 7]] = 3
    s = c @ m.T + 0.01 * RNG.normal(size=(5, 80))
    fit = S.Lasso(m, 5000, 1e-9)
    picked = S.lasso_path(fit, s, 30, 1e-3)["coef"]
    assert (np.abs(picked) > 0.5).tolist() == (c != 0).tolist()
    least = np.sum((s - S.Tikhonov(m, np.zeros(20)).fit(s) @ m.T) ** 2, axis=1)
    r = S.lasso_path(fit, s, 40, 1e-5, "l2", 0.5, least)
    assert (r["rss"] <= 1.5 * least * 1.0001).all()
    zero = S.lasso_path(fit, np.zeros((1, 80)))
    assert zero["alpha"][0] == 0 and not zero["coef"].any()


def test_inequality_solver_is_feasible_and_stationary():
    h, c, b = RNG.normal(size=(40, 10)), np.vstack([RNG.normal(size=(60, 10)), np.eye(10)]), RNG.normal(size=(40, 40))
    qp = S.Inequality(h, c)
    x, _, ok = qp.solve(b)
    assert ok.all() and (x @ c.T).min() > -1e-8
    g = x @ (h.T @ h) - b @ h
    for k in range(40):
        active = c[c @ x[k] < 1e-7]
        if len(active):
            l = np.linalg.lstsq(active.T, g[k], rcond=None)[0]
            assert np.abs(active.T @ l - g[k]).max() < 1e-5
        else:
            assert np.abs(g[k]).max() < 1e-6


def test_soft_constraint_lowers_negative_amplitudes():
    h, p = RNG.normal(size=(30, 6)), RNG.normal(size=(50, 6))
    b = RNG.normal(size=30)
    free = np.linalg.lstsq(h, b, rcond=None)[0]
    x, k = S.soft_constrained(h, b, p, weight=10.0)
    assert k <= 50 and np.minimum(p @ x, 0).sum() > np.minimum(p @ free, 0).sum()


def test_robust_tensor_ignores_an_outlier():
    b, g = np.where(np.arange(64) % 8 == 0, 0, 1000.0), RNG.normal(size=(64, 3))
    g /= np.linalg.norm(g, axis=1)[:, None]
    d = np.diag([1.7e-3, 0.3e-3, 0.3e-3])
    s = 1000 * np.exp(-b * np.einsum("ni,ij,nj->n", g, d, g)) * np.exp(RNG.normal(size=64) * 1e-3)
    spoiled = s.copy()
    spoiled[9] *= 0.2
    r = S.robust_tensor(np.stack([s, spoiled, np.zeros(64)]), S.tensor_design(b, g))
    assert np.abs(r["fa"][:2] - 0.799).max() < 0.01
    assert abs(r["principal_dir"][1] @ [1, 0, 0]) > 0.999
    assert r["outlier_fraction"][1] >= 1 / 64


def test_quaternion_round_trip():
    from lumivox.sources import nifti

    for a in (np.diag([2.0, 2, 2, 1]), np.diag([-2.0, 2, 2, 1]), np.diag([-2.0, -2, 2, 1])):
        a[:3, 3] = (1, 2, 3)
        data = RNG.normal(size=(3, 4, 5, 2)).astype(np.float32)
        image = nifti.decode(nifti.encode(data, a))
        assert np.array_equal(image.data, data) and np.allclose(image.affine, a) and image.warnings == []


def test_lobes_and_quadrature_at_every_axis():
    d, edges = N.hemisphere(8), N.hemisphere_edges(8)
    near = np.bincount(edges.ravel())
    assert len(edges) == 960 and sorted(set(near.tolist())) == [5, 6] and (near == 5).sum() == 6
    area = N.quadrature(d)
    assert area.sum() == pytest.approx(4 * np.pi) and area.min() > 0
    for p in (4, 16):
        values = np.abs(d @ d.T) ** p  # a row for each axis
        lobe = N.basins(values, edges)
        assert (lobe == np.arange(len(d))[:, None]).all()  # none is cut at the rim
        assert (values * area).sum(1) == pytest.approx(np.full(len(d), 4 * np.pi / (p + 1)), rel=0.02)
    a, b = 0, int(np.argmin(np.abs(d @ d[0])))
    lobe = N.basins((np.abs(d @ d[a]) ** 16 + np.abs(d @ d[b]) ** 4)[None], edges)[0]
    assert set(lobe.tolist()) == {a, b} and (lobe == b).sum() > (lobe == a).sum()


def test_series_as_polynomials_and_their_tops():
    rng = np.random.default_rng(5)
    for lmax in (2, 4, 8):
        s = N.SpherePolynomial(lmax)
        sh, d = rng.normal(size=(7, N.n_sh(lmax))), rng.normal(size=(7, 3))
        d /= np.linalg.norm(d, axis=1)[:, None]
        value, gradient, hessian = s.derivatives(sh, d)
        assert value == pytest.approx((N.sh_matrix(d, lmax) * sh).sum(1))
        for k in range(3):
            e = 1e-6 * np.eye(3)[k]
            up, down = (s.derivatives(sh, d + sign * e) for sign in (1, -1))
            assert gradient[:, k] == pytest.approx((up[0] - down[0]) / 2e-6, rel=1e-4, abs=1e-4)
            assert hessian[:, k] == pytest.approx((up[1] - down[1]) / 2e-6, rel=1e-4, abs=1e-3)
        top, high = s.tops(sh, d, rounds=80)  # from anywhere
        _, g, _ = s.derivatives(sh, top)
        assert (high >= value - 1e-12).all() and np.abs(g - (g * top).sum(1)[:, None] * top).max() < 1e-5


def test_planted_directions_within_a_tenth_of_a_degree():
    rng = np.random.default_rng(6)
    y, d = N.sh_matrix(N.hemisphere(), 8), N.hemisphere()
    s, fit = N.SpherePolynomial(8), np.linalg.pinv(y)
    for _ in range(30):
        u = rng.normal(size=3)
        v = np.cross(u, rng.normal(size=3))  # across each other, so neither moves the other's top
        u, v = u / np.linalg.norm(u), v / np.linalg.norm(v)
        sh = fit @ ((d @ u) ** 8 + 0.8 * (d @ v) ** 8)  # a series of that order, exactly
        start = np.stack([d[np.argmax(np.abs(d @ x))] for x in (u, v)])
        top, high = s.tops(np.stack([sh, sh]), start)
        for t, x in zip(top, (u, v)):
            assert np.degrees(np.arccos(min(1.0, abs(t @ x)))) < 0.1
        assert high == pytest.approx([1.0, 0.8], rel=1e-6)


def test_active_sets_of_many_rows_go_side_by_side(monkeypatch):
    rng = np.random.default_rng(4)
    h, c, b = rng.normal(size=(30, 8)), np.vstack([rng.normal(size=(6, 8)), np.eye(8)]), rng.normal(size=(2 * S.SIDE_BY_SIDE + 9, 30))
    qp, calls, plain = S.Inequality(h, c), [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or plain(*a))
    x, used, ok = qp.solve(b)
    assert ok.all() and len(calls) < len(b) / 4  # before, one or more a row and step
    for k in range(0, len(b), 37):
        alone = qp.solve(b[[k]])
        assert np.allclose(alone[0][0], x[k], atol=1e-12) and alone[1][0] == used[k]
    # no feasible point lies downhill, the other rows' results among them
    downhill = (x @ (h.T @ h) - b @ h) @ x.T
    assert (x @ c.T).min() > -1e-8 and downhill.min() > -1e-5 and np.abs(np.diag(downhill)).max() < 1e-5 < np.abs(x).max()
    few = S.Inequality(h, c, max_iter=2).solve(b)
    assert few[1].max() == 2 and not few[2].all() and (few[1][few[2]] < 2).all()
