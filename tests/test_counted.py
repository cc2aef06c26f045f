"""Tests of counted rows and stored cells against the same tests of dense genotypes."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from varloom.functions import counted as C
from varloom.functions import models as M
from varloom.operators import assoc as A


def unit(seed=1, n=400, m=14, missing=0.02):
    """A unit's cells and the dense form of the same: y, q, x, g, w, and the cells for each phenotype."""
    rng = np.random.default_rng(seed)
    sex, age = rng.integers(0, 3, n), rng.integers(0, 4, n).astype(float)
    b = np.where(np.arange(m)[:, None] % 5 == 0, 0.25, 0.0) * np.array([1.0, 0.0, 0.0])
    g = b[:, sex].T.copy()
    held = rng.random((n, m)) < rng.uniform(0.01, 0.12, m)
    i, j = np.nonzero(held)
    value = np.where(rng.random(len(i)) < missing, 0.07, rng.integers(1, 3, len(i)))
    g[i, j] = value
    x, w, y, q = np.column_stack([np.ones(n), age]), rng.uniform(0.5, 2, m), (rng.random(n) < 0.4).astype(float), rng.normal(age, 3)
    return sex, x, w, b, i, j, value, g, y, q


def counted(sex, x, w, b, i, j, value, phenotype, binary):
    cls, at = np.unique(np.column_stack([sex, x]), axis=0, return_inverse=True)
    at, k = at.ravel(), len(cls)
    n, y = np.bincount(at, minlength=k).astype(float), np.bincount(at, phenotype, k)
    null = C.Null(cls[:, 0].astype(int), cls[:, 1:], n, y, binary, float(((phenotype - (y / n)[at]) ** 2).sum()))
    one = C.Cells(null, w, b, j, np.unique(i, return_inverse=True)[1], at[i], phenotype[i], value)
    return null, one, one.rows(w)


@pytest.mark.parametrize("binary", [True, False])
@pytest.mark.parametrize("n,m", [(400, 14), (60, 40)])
def test_units_equal_dense_tests(binary, n, m):
    sex, x, w, b, i, j, value, g, y, q = unit(n=n, m=m)
    tests = [t for t in (A.BINARY if binary else A.CONTINUOUS)]
    p = y if binary else q
    null, one, rows = counted(sex, x, w, b, i, j, value, p, binary)
    order = np.unique(i)
    permuted = A._permuted(one, order, np.unique(i, return_inverse=True)[1], np.arange(n), sex, p - M.Null(p, x, binary).mu, 20, 1)
    for (t, a), (u, d) in zip(A.unit_tests(tests, null, w, rows, one, permuted=permuted), A.run_tests(tests, p, x, g, w, g @ w, binary, n_resampling=20), strict=True):
        assert t == u
        for k in M.NONE:
            # the maximum of a likelihood is found to about the root of its precision
            assert a[k] == pytest.approx(d[k], rel=1e-4 if t == "nbinom" else 2e-6, abs=2e-6, nan_ok=True), (t, k)


def test_least_squares_of_cases_and_controls():
    sex, x, w, b, i, j, value, g, y, _ = unit()
    null, one, rows = counted(sex, x, w, b, i, j, value, y, True)
    got, want = A.unit_tests(["lm"], null, w, rows, one)[0][1], M.lm(y, x, g @ w)
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, nan_ok=True) for k in want)


def test_memory_of_a_unit_grows_with_its_cells():
    """A dense matrix of this unit takes 480 MB, and each test copies of it."""
    rng = np.random.default_rng(2)
    n, m, cells = 200_000, 300, 9000
    null = C.Null(np.arange(30) % 3, np.column_stack([np.ones(30), np.arange(30) // 3]), np.full(30, n / 30), rng.binomial(n // 30, 0.5, 30).astype(float), True)
    at = np.unique(rng.integers(0, m * n, cells))
    v, s = at // n, at % n
    tracemalloc.start()
    w = rng.uniform(1, 2, m)
    one = C.Cells(null, w, np.zeros((m, 3)), v, np.unique(s, return_inverse=True)[1], s % 30, (s % 7 < 3).astype(float), np.ones(len(v)))
    got = A.unit_tests(["skat", "skat_burden", "acatv", "acatvSPA", "scoreSPA"], null, w, one.rows(w), one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and all(0 <= r["P"] <= 1 for _, r in got)


def test_many_variants_in_a_batch():
    """Of 90,000 samples; one variant at a time took over 0.1 s for Firth's interval alone."""
    rng = np.random.default_rng(3)
    size, n, cases = 3000, 90_000, 45_000
    a, b = rng.poisson(14, size), rng.poisson(14, size)
    null = C.Null(np.arange(3), np.ones((3, 1)), np.full(3, n / 3), np.full(3, cases / 3), True)
    rows = (np.zeros((size, 2), int), np.tile([0.0, 1.0], (size, 1)), np.column_stack([n - a - b, a + b]).astype(float), np.column_stack([cases - a, a]).astype(float))
    began = time.time()
    got = {t: null.tests(t, *rows) for t in ("glm", "scoreSPA", "firth")}
    assert time.time() - began < 30
    both = (a > 0) & (b > 0)
    odds = np.log(a / b * (n - cases - b) / (cases - a))
    assert np.allclose(got["glm"]["effect"][both], odds[both], atol=1e-8)
    assert (got["firth"]["effectCIlower"] < got["firth"]["effect"]).all() and (got["firth"]["effect"] < got["firth"]["effectCIupper"]).all()


def test_burden_of_many_variants_takes_a_row_for_each_sample():
    """As ``rvb_counts`` at 6 GB: 72,000 variants of 149 samples; their covariance would take 41 GB, their genotypes 86 MB."""
    rng = np.random.default_rng(4)
    sex = rng.integers(0, 3, 149)
    null = C.Null(np.arange(3), np.ones((3, 1)), np.bincount(sex, minlength=3).astype(float), np.array([20.0, 25, 22]), True)
    w, s, y = rng.uniform(1, 2, 72_000), rng.normal(40, 5, 149), np.zeros(149)
    for k, cases in enumerate((20, 25, 22)):
        y[np.flatnonzero(sex == k)[:cases]] = 1
    tracemalloc.start()
    got = A.unit_tests(["skat_burden"], null, w, C.held_rows(null, np.zeros(3), sex, s, y), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6
    dense = M.Null(y, np.ones((149, 1)), True)
    assert got[0][1]["P"] == pytest.approx(float(M.chi2_1_sf((dense.res @ s) ** 2 / dense.covariance(s[:, None])[0, 0])), rel=1e-9)


def test_few_fits_for_intervals(monkeypatch):
    """Halving took about 50 fits; the ends are those that halving finds, also where all carriers are cases or have no cases."""
    a, b, n, cases = np.array([2.0, 0, 14, 1, 30]), np.array([0.0, 2, 15, 9, 0]), 90_000, 45_000
    x, s = np.ones((5, 2, 1)), np.tile([0.0, 1.0], (5, 1))
    rows, held = np.column_stack([n - a - b, a + b]), np.column_stack([cases - a, a])
    calls, fit = [], C._Penalised.fit
    monkeypatch.setattr(C._Penalised, "fit", lambda self, *args: calls.append(1) or fit(self, *args))
    got = C.firth(x, s, rows, held)
    assert len(calls) <= 20
    model, every = C._Penalised(np.concatenate([x, s[..., None]], 2), rows, held), np.arange(5)
    best, ll, _ = model.fit(every, np.zeros((5, 2)), None, 1000)
    for side, name in ((-1, "effectCIlower"), (1, "effectCIupper")):
        inner, outer = np.zeros(5), np.full(5, 25.0)
        for _ in range(50):
            mid = (inner + outer) / 2
            out = ll - model.fit(every, best.copy(), best[:, -1] + side * mid, 1000)[1] >= C.CRITICAL
            inner, outer = np.where(out, inner, mid), np.where(out, mid, outer)
        assert np.allclose(got[name], best[:, -1] + side * inner, atol=2e-6, rtol=0)


def test_variants_of_equal_counts_are_tested_once(monkeypatch):
    null = C.Null(np.arange(3), np.ones((3, 1)), np.full(3, 100.0), np.full(3, 40.0), True)
    one = {"w": 1.0, "ploidy": "diploid", "fill": 0.02, "b0": 0.0, "b1": 0.0, "b2": 0.0, "cls": [0, 1, 2], "code": [1, 1, 3], "n": [3.0, 2.0, 1.0]}
    f = pd.DataFrame([{"VAR_id": i, **one, "y": [float(i % 2), 1.0, 0.0]} for i in range(400)])
    sizes, tests = [], C.Null.tests
    monkeypatch.setattr(C.Null, "tests", lambda self, t, cls, *rest: sizes.append(len(cls)) or tests(self, t, cls, *rest))
    got = A._batch(f, null, np.zeros(1, int), np.zeros(3, int), ("pheno", "", "allelic", "1"), ["glm", "firth"], 1000)
    assert sizes == [2, 2] and len(got) == 800
    assert got.groupby(["test", got.VAR_id % 2])["P"].nunique().tolist() == [1] * 4 and got.P.nunique() == 4
