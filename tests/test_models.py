"""Kernels against textbook identities."""

import math
import tracemalloc

import numpy as np
import pytest

from varloom.functions import dist as D
from varloom.functions import models as M
from varloom.operators.spatial import distance_clusters


def data(seed=0, n=150, m=6):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.05, 0.3, m), (n, m)).astype(float)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    return g, x, (rng.random(n) < 0.4).astype(float), rng.normal(size=n)


@pytest.mark.parametrize("df,t,p", [(10, 2.228139, 0.025), (1, 1.0, 0.25), (30, 1.697261, 0.05)])
def test_t(df, t, p):
    assert D.t_sf(t, df) == pytest.approx(p, abs=1e-6) and D.t_quantile_sf(p, df) == pytest.approx(t, abs=1e-5)


def test_chi_square_and_normal():
    assert D.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-7) and D.chi2_sf(11.0705, 5) == pytest.approx(0.05, abs=1e-6)
    assert D.norm_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_fisher():
    odds, p = D.fisher_exact(3, 1, 1, 3)
    assert p == pytest.approx(17 / 70) and odds == pytest.approx(6.408309, abs=1e-4)


def test_glm_solves_its_score_equations():
    g, x, y, _ = data()
    d = np.column_stack([x, g.sum(1)])
    beta, p, _ = M.logistic(y, d)
    assert np.abs(d.T @ (y - p)).max() < 1e-6 and M.glm(y, x, g.sum(1))["effect"] == pytest.approx(beta[-1])


def test_firth_is_finite_under_separation():
    x, s = np.ones((20, 1)), np.r_[np.zeros(10), np.ones(10)]
    y = s.copy()
    r = M.firth(y, x, s)
    assert math.isfinite(r["effect"]) and r["effectCIlower"] < r["effect"] < r["effectCIupper"] and r["P"] < 0.01
    assert r["effect"] == pytest.approx(2 * math.log(10.5 / 0.5), abs=1e-4)


def test_lm_is_the_t_test():
    _, _, y, q = data()
    r = M.lm(q, np.ones((len(q), 1)), y)
    a, b = q[y == 1], q[y == 0]
    s2 = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (len(q) - 2)
    t = (a.mean() - b.mean()) / math.sqrt(s2 * (1 / len(a) + 1 / len(b)))
    assert r["effect"] == pytest.approx(a.mean() - b.mean()) and r["P"] == pytest.approx(2 * D.t_sf(abs(t), len(q) - 2))


def test_mixture_of_equal_weights_is_chi_square():
    assert M.mixture_sf(11.0705, np.ones(5)) == pytest.approx(0.05, abs=2e-3) and M.liu_sf(11.0705, np.ones(5)) == pytest.approx(0.05, abs=1e-3)
    assert M.mixture_sf(7.68, np.array([2.0])) == pytest.approx(0.05, abs=1e-3)


def test_skat_of_one_variant_is_its_burden_test():
    g, x, y, q = data()
    for yy, binary in ((y, True), (q, False)):
        one = g[:, :1]
        assert M.skat(yy, x, one, np.ones(1), binary) == pytest.approx(M.skat_burden(yy, x, one, np.ones(1), binary))


def test_skato_lies_near_the_better_test():
    g, x, y, _ = data(4)
    w = np.ones(g.shape[1])
    least = min(M.skat(y, x, g, w, True), M.skat_burden(y, x, g, w, True))
    assert least * 0.9 <= M.skato(y, x, g, w, True) <= min(1, 7 * least)


def test_spa_agrees_with_the_score_test_in_the_middle():
    g, x, y, _ = data(5)
    null = M.Null(y, x, True)
    s = null.clean(g[:, :1])[:, 0]
    z = null.res @ s / math.sqrt((null.v * s * s).sum())
    assert M.spa(null, g[:, 0]) == pytest.approx(float(2 * D.norm_sf(abs(z))), rel=0.2)


def test_cauchy():
    assert M.cauchy([0.03]) == pytest.approx(0.03) and M.cauchy([0.2, 0.2, 0.2]) == pytest.approx(0.2)
    assert M.cauchy([1e-18]) == pytest.approx(1e-18, rel=1e-6) and math.isnan(M.cauchy([]))
    with pytest.raises(ValueError):
        M.cauchy([0.0, 1.0])


def test_mixed_model_without_correlation_is_least_squares():
    _, x, y, q = data(6, 60)
    r = M.mixed_score(M.mixed_null(q, x, np.eye(60)), y)
    assert r["effect"] == pytest.approx(M.lm(q, x, y)["effect"], abs=1e-6)


def test_permutation_p():
    assert M.permutation_p(0.05, [0.01, 0.2, 0.05]) == pytest.approx(2 / 4)


def test_clusters():
    assert list(distance_clusters(np.array([1, 2, 3]), 5, 2)) == [0, 0, 0]
    parts = distance_clusters(np.array([1, 2, 3, 4, 5, 1000, 1001, 1002, 1003, 1004]), 9, 1)
    assert len(set(parts[:5])) == 1 and len(set(parts[5:])) == 1 and parts[0] != parts[-1]


@pytest.mark.parametrize("m,top", [(12, 30.0), (90, 3.0), (2000, 0.4), (5, 1e5)])
def test_sums_of_the_mixture_integral(m, top):
    u, lam = np.linspace(top / 50, top, 50), np.random.default_rng(m).gamma(1, 1, m)
    turn, damp = M._phases(u, lam)
    part = u[:, None] * lam
    assert np.allclose(turn, np.arctan(part).sum(1), rtol=1e-12, atol=0) and np.allclose(damp, np.log1p(part**2).sum(1), rtol=1e-12, atol=0)


def test_mixture_tail_of_many_eigenvalues_takes_little_memory():
    """Blocks of 20,000 points times all eigenvalues took 577 MB here, in each of an executor's workers."""
    lam = 0.001 * np.random.default_rng(0).gamma(4, 1, 1200)
    lam[0] = 4800
    tracemalloc.start()
    p = M.mixture_sf(lam.sum() * 1.05, lam)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and 0.2 < p < 0.4


def test_optimal_test_of_a_unit_takes_memory_of_its_covariance():
    """Before the integral went in blocks: over 250 MB for 600 variants, whose covariance has 3 MB."""
    g = np.random.default_rng(1).binomial(2, 0.02, (900, 600)).astype(float)
    tracemalloc.start()
    p = M.skato_of(np.random.default_rng(2).normal(size=600) * 6, np.cov(g.T) * 900)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and 0 <= p <= 1
