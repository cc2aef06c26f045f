"""Covariances by their parts against the matrix of the same cells."""

import tracemalloc

import numpy as np
import pytest

from varloom.functions import counted as C
from varloom.functions import spectrum as S
from varloom.operators import assoc as A
from varloom.operators.assoc import KERNEL


def unit(m: int, groups: int, samples: int, cells: int, seed: int, binary: bool, common: bool = False):
    """Variants of groups that share no samples, a few with baselines of one sex; their null model and cells."""
    rng = np.random.default_rng(seed)
    n, v = samples * groups, np.repeat(np.arange(m), cells)
    key = np.unique(v * n + v % groups + groups * rng.integers(0, samples, len(v)))
    v, s = key // n, key % n
    x = np.column_stack([np.ones(24), np.arange(24) // 3, np.arange(24) % 2])
    null = C.Null(np.arange(24) % 3, x, np.full(24, n / 24), rng.binomial(n // 24, 0.4, 24).astype(float), binary, 0.0 if binary else n * 0.9)
    b = np.where(np.arange(m)[:, None] % 20 == 0, 0.8 if common else 0.01, 0.0) * np.array([1.0, 0.0, float(common)])
    y = (s * 7 % 11 < 5).astype(float)
    one = C.Cells(null, rng.uniform(0.9, 2, m), b, v, np.unique(s, return_inverse=True)[1], s % 24, y, np.where(rng.random(len(v)) < 0.05, 0.01, rng.choice([1.0, 1.0, 2.0], len(v))))
    return null, one


@pytest.mark.parametrize("binary", [True, False])
@pytest.mark.parametrize("m,groups,samples,cells,common", [(300, 1, 480, 20, False), (600, 6, 4800, 8, False), (390, 130, 48, 3, True), (400, 400, 24, 5, False)])
def test_parts_equal_the_matrix(binary, m, groups, samples, cells, common):
    null, one = unit(m, groups, samples, cells, m, binary, common)
    kept = np.flatnonzero(np.arange(m) % 7 > 0)
    for k, w in ((np.arange(m), one.w), (kept, one.w[kept] * 1.3)):
        parts, matrix = one.covariance(w, k), one.kernel()[np.ix_(k, k)] * np.outer(w, w)
        assert isinstance(parts, C.Spectrum)
        for u in (one.u[k] * w, one.u[k] * w * 1.5):
            for t in ("skat", "skat_burden", "skato"):
                assert getattr(parts, t)(u) == pytest.approx(KERNEL[t](u, matrix), rel=1e-6, abs=1e-10), t


def test_one_dominant_eigenvalue():
    """Its integral reaches far, so that points are too far apart to follow angles without finer steps."""
    null, one = unit(300, 3, 480, 6, 5, True)
    w = one.w.copy()
    w[1] = 5e4
    parts, matrix = one.covariance(w, np.arange(300)), one.kernel() * np.outer(w, w)
    for u in (one.u * w, one.u * w * 2):
        for t in ("skat", "skato"):
            assert getattr(parts, t)(u) == pytest.approx(KERNEL[t](u, matrix), rel=1e-6), t


def test_memory_of_a_unit_of_many_variants():
    """As at 1 GB: the matrix of 12,000 variants takes 1.2 GB, and each test took copies of it."""
    null, one = unit(12_000, 60, 14_400, 30, 1, False)
    tracemalloc.start()
    cls, s, n, y = one.rows(one.w)
    got = A.unit_tests(list(A.CONTINUOUS), null, one.w, (cls, s, n, y), one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and all(0 <= r["P"] <= 1 for _, r in got)


@pytest.mark.parametrize("binary", [True, False])
@pytest.mark.parametrize("m,groups,samples,cells,common", [(300, 1, 480, 20, False), (600, 3, 4800, 8, False), (600, 1, 6000, 5, True), (390, 130, 48, 3, True)])
def test_linked_variants_without_a_matrix(binary, m, groups, samples, cells, common, monkeypatch):
    """Of many and of few pairs, also with groups that are decomposed beside them."""
    monkeypatch.setattr(S, "LINKED", 2 if groups == 130 else 20)
    null, one = unit(m, groups, samples, cells, m, binary, common)
    kept = np.flatnonzero(np.arange(m) % 7 > 0)
    for k, w in ((np.arange(m), one.w), (kept, one.w[kept] * 1.3)):
        parts, matrix = one.covariance(w, k), one.kernel()[np.ix_(k, k)] * np.outer(w, w)
        assert parts.groups and sum(g.m for g in parts.groups) + len(parts.known) == len(k)
        for u in (one.u[k] * w, one.u[k] * w * 1.5):
            for t in ("skat", "skat_burden", "skato"):
                assert getattr(parts, t)(u) == pytest.approx(KERNEL[t](u, matrix), rel=1e-6, abs=1e-10), t


def test_memory_of_linked_variants():
    """A group of linked variants was a matrix: 128 MB for these 4,000, and copies of it; 1.2 GB at 1 GB."""
    null, one = unit(4000, 1, 300_000, 30, 1, False)
    tracemalloc.start()
    parts = one.covariance(one.w, np.arange(4000))
    got = [parts.skat(one.u * one.w), parts.skato(one.u * one.w)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6 and len(parts.groups) == 1 and all(0 <= p <= 1 for p in got)
