"""The block-wise mixed model against dense matrices; exact tails; result files of every kind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import dist
from varloom.functions import tails as T
from varloom.operators import gsa as A
from varloom.operators import gsa_null as N
from varloom.operators import results
from varloom.sources import files


def study(spark, n=60, block=6, h=0.7, seed=4):
    rng = np.random.default_rng(seed)
    r = np.eye(n)
    for b in range(0, n - block, block):  # the last units have no block
        a = rng.normal(size=(block, block + 3))
        c = np.corrcoef(a)
        r[b : b + block, b : b + block] = 0.5 * c + 0.5 * np.eye(block)
    x = rng.normal(size=n)
    z = 0.3 + 0.4 * x + np.linalg.cholesky(h * r + (1 - h) * np.eye(n)) @ rng.normal(size=n)
    stats = spark.createDataFrame([(f"g{i:02d}", float(z[i]), float(x[i])) for i in range(n)], "unit string, Z double, size double")
    blocks = spark.createDataFrame([(i // block, f"g{i:02d}") for i in range(n - block)], "block long, unit string")
    pairs = [(i // block, f"g{i:02d}", f"g{j:02d}", float(r[i, j])) for i in range(n - block) for j in range(i + 1, n - block) if i // block == j // block]
    return r, np.column_stack([np.ones(n), x]), z, stats, blocks, spark.createDataFrame(pairs, "block long, unit_a string, unit_b string, r double")


def restricted(h, r, x, z):
    v = np.linalg.inv(h * r + (1 - h) * np.eye(len(z)))
    a = x.T @ v @ x
    beta = np.linalg.solve(a, x.T @ v @ z)
    e = z - x @ beta
    s2 = e @ v @ e / (len(z) - x.shape[1])
    return -0.5 * (-np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + (len(z) - x.shape[1]) * (math.log(s2) + 1)), beta, s2, v, np.linalg.inv(a)


def test_mixed_model_equals_dense_matrices(spark):
    r, x, z, stats, blocks, pairs = study(spark)
    m = N.fit(stats, blocks, pairs, ["size"], make_pd=False)
    grid = np.linspace(0, 0.999, 2000)
    best = max(grid, key=lambda h: restricted(h, r, x, z)[0])
    value, beta, s2, v, inverse = restricted(m.h, r, x, z)
    assert m.log_likelihood == pytest.approx(value) and value >= restricted(best, r, x, z)[0] - 1e-6 and m.h == pytest.approx(best, abs=2e-3)
    assert np.allclose(m.beta, beta) and m.sigma2 == pytest.approx(s2) and np.allclose(m.inverse, inverse)
    assert len(m) == 60 and m.get_covar() == ["size"] and m.list_units().count() == 60
    got = {t.term: (t.estimate, t.SE) for t in m.get_results(spark).collect()}
    assert got["size"] == pytest.approx((beta[1], math.sqrt(inverse[1, 1] * s2)))
    info = m.get_null_model()
    assert info["varianceCorrelated"] + info["varianceResidual"] == pytest.approx(s2)
    sets = spark.createDataFrame([("a", f"g{i:02d}") for i in range(0, 40, 3)] + [("b", "g01"), ("b", "g59"), ("b", "gone"), ("all", "x")] + [("every", f"g{i:02d}") for i in range(60)], "geneSetName string, unit string")
    rows = {t.geneSetName: t for t in N.test_sets(m, sets).collect()}
    assert rows.keys() == {"a", "b"}  # nothing is left of the set of all units beside the intercept
    for name, own in (("a", range(0, 40, 3)), ("b", (1, 59))):
        s = np.zeros(60)
        s[list(own)] = 1
        p = v - v @ x @ inverse @ x.T @ v
        u, d = s @ p @ z, s @ p @ s
        t = rows[name]
        assert t.genesObs == len(list(own)) and t.effect == pytest.approx(u / d) and t.effectSE == pytest.approx(math.sqrt(s2 / d)) and t.P == pytest.approx(math.erfc(abs(u) / math.sqrt(s2 * d) / math.sqrt(2)), rel=1e-9)
    with pytest.raises(ValueError):
        N.fit(stats.limit(2), blocks, pairs, ["size"])


def test_exact_tails(spark):
    rows = spark.createDataFrame([(a, m, s, n) for a, m, s, n in ((3, 10, 12, 60), (0, 5, 5, 20), (5, 5, 5, 20), (9, 5, 5, 20), (40, 80, 700, 2000), (10, 12, 18, 20))], "a long, m long, s long, n long")
    for r in rows.select("*", T.hypergeometric_upper(*(F.col(c) for c in "amsn")).alias("p")).collect():
        want = sum(math.comb(r.s, k) * math.comb(r.n - r.s, r.m - k) for k in range(r.a, min(r.m, r.s) + 1) if r.m - k <= r.n - r.s) / math.comb(r.n, r.m)
        assert r.p == pytest.approx(want, rel=1e-9), r
    for r in spark.createDataFrame([(1.0,), (1.5,), (7.0,), (1e6,)], "x double").select("x", T.lgamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12)
    counts = spark.createDataFrame([("s", 4, 6, 5, 30)], "geneSetName string, sig_in long, sig_out long, rest_in long, rest_out long")
    assert A.fisher_p(counts).first().P == pytest.approx(dist.fisher_exact(4, 6, 5, 30)[1])


def test_results_of_all_kinds_are_written_and_read(spark, tmp_path):
    gsa = spark.createDataFrame([("s1", 3, 0.5, 0.1, 0.01), ("s2", 4, -0.5, 0.2, None)], "geneSetName string, genesObs long, effect double, effectSE double, P double")
    rvb = spark.createDataFrame([("u1", "pheno", "", "lm", 5, 0.25)], "unit string, pheno string, covar string, test string, nvar int, P double")
    single = spark.createDataFrame([(7, "pheno", "age,sex", "score", 12, None, "A", 1.5)], "VAR_id long, pheno string, covar string, test string, caseMAC long, ctrlMAC long, effectAllele string, U double")
    for name, df, kind, values in (("g", gsa, "gsaResult", {"test": "lm"}), ("r", rvb, "rvbResult", {"cohort": "c", "varSetName": "v"}), ("s", single, "singlevarResult", {})):
        full = results.as_result(df, **values)
        assert full.columns[: len(results.KINDS[kind])] == results.KINDS[kind] and results.kind_of(full.columns) == kind
        files.write_result(full, str(tmp_path / name), {"id": "x"})
        back, found, meta = files.read_result(spark, str(tmp_path / name))
        assert found == kind and meta == {"id": "x"} and back.columns == full.columns
        assert {c: t for c, t in back.dtypes if c in results.KINDS[kind]} == {c: t for c, t in full.dtypes if c in results.KINDS[kind]}
        blank = lambda r: tuple(x or None if isinstance(x, str) else x for x in r)
        assert sorted(map(blank, back.collect()), key=str) == sorted(map(blank, full.collect()), key=str)
        files.write_result(df, str(tmp_path / f"{name}2"))  # missing columns are added
        assert files.read_result(spark, str(tmp_path / f"{name}2"))[1] == kind
    with pytest.raises(ValueError):
        results.as_result(spark.createDataFrame([(1,)], "x int"))
