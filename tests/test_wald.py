"""Logistic regressions of counted classes against dense fits in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from varloom.functions import models as M
from varloom.operators import geno as G
from varloom.operators import score as S
from varloom.operators import wald as W

N = 300


@pytest.fixture(scope="module")
def study(spark):
    r = np.random.default_rng(11)
    samples = [(i, int(r.integers(0, 3)), int(r.random() < 0.4), str(r.choice(["a", "b", "c"])), float(r.integers(0, 3)) / 4, float(r.normal())) for i in range(N)] + [(N, 1, None, "a", 0.0, 0.0)]
    samples = spark.createDataFrame(samples, "IID long, sex int, pheno int, site string, off double, age double")
    ploidy = ["diploid"] * 9 + ["XnonPAR"] * 3
    variants = spark.createDataFrame([(v, p, 2 if v % 4 == 0 else 0) for v, p in enumerate(ploidy)], "VAR_id long, ploidy string, g0 int")
    cells = [(v, int(i), None if r.random() < 0.1 else int(r.integers(0, 3))) for v in range(len(ploidy)) for i in r.choice(N + 1, 70, False)]
    y = {x.IID: x.pheno for x in samples.collect()}
    cells += [(50, i, 1) for i in [k for k in range(N) if y[k] == 1][:20]] + [(51, 3, 1)]  # separated; one carrier
    variants = variants.unionByName(spark.createDataFrame([(50, "diploid", 0), (51, "diploid", 0)], variants.schema))
    return G.Geno(variants, samples, spark.createDataFrame(cells, "VAR_id long, IID long, gt int"))


@pytest.mark.parametrize(("covar", "offset"), [(["site"], None), (["site", "sex"], "off")])
def test_units_equal_dense_fits(study, spark, covar, offset):
    members = [(f"u{v % 3}", v, 0.5 + v % 2) for v in range(12)] + [(f"v{v}", v, 1.0) for v in range(12)] + [("split", 50, 1.0), ("one", 51, 1.0), ("bad", 1, None)]
    members = spark.createDataFrame(members, "unit string, VAR_id long, w double")
    m = S.fit_null(study.samples, "pheno", covar, "logistic", offset=offset)
    got = {r.unit: r for r in W.glm_units(study, members, m).collect()}
    ids = {r.IID: k for k, r in enumerate(m.samples.orderBy("IID").collect())}
    rows = m.samples.orderBy("IID").collect()
    y, x = np.array([r.y for r in rows]), np.array([list(r.x) for r in rows])
    off = np.array([r.off for r in study.samples.where("pheno is not null").orderBy("IID").collect()]) if offset else 0.0
    own = G.Geno(study.variants, study.samples.where("pheno is not null"), study.stored.join(m.samples.select("IID"), "IID"))
    score = {}
    for r in G.scores(own, *G.burden(own, members)).collect():
        score.setdefault(r.unit, np.zeros(N))[ids[r.IID]] = r.score
    assert got.keys() == score.keys() and "bad" not in got
    for unit, s in score.items():
        r = got[unit]
        assert r.test == "glm" and r.caseN + r.ctrlN == N and r.meanCaseScore == pytest.approx(s[y == 1].mean())
        if unit in ("split", "one"):
            assert r.effect is None and r.P is None and r.OR is None
            continue
        want = M.glm(y, x, s, off)
        for field in ("effect", "effectSE", "effectCIlower", "effectCIupper", "OR", "P"):
            assert r[field] == pytest.approx(want[field], rel=1e-7), (unit, field)


def test_constant_scores_empty_units_and_refusals(study, spark):
    m = S.fit_null(study.samples, "pheno", ["site"], "logistic")
    none = spark.createDataFrame([], "unit string, VAR_id long, w double")
    assert W.glm_units(study, none, m).count() == 0
    per = spark.createDataFrame([("flat", 1.0, 1.0, 1.0, 1)], "unit string, b0 double, b1 double, b2 double, nvar long")
    dev = spark.createDataFrame([], "unit string, IID long, sex int, dev double")
    flat = W.wald(per, dev, m).first()
    assert flat.effect is None and flat.P is None
    with pytest.raises(ValueError, match="classes"):
        old, W.CLASSES = W.CLASSES, 100
        try:
            W.fit(per, dev, S.fit_null(study.samples, "pheno", ["age"], "logistic"))
        finally:
            W.CLASSES = old
    with pytest.raises(ValueError, match="logistic"):
        W.fit(per, dev, S.fit_null(study.samples, "age"))


def test_a_unit_that_all_samples_carry(study, spark):
    """Every sample a stored cell of its own value: no class is left without cells."""
    m = S.fit_null(study.samples, "pheno", [], "logistic")
    per = spark.createDataFrame([("all", 0.0, 0.0, 0.0, 1)], "unit string, b0 double, b1 double, b2 double, nvar long")
    dev = study.samples.where("pheno is not null").select(F.lit("all").alias("unit"), "IID", "sex", (F.abs("age") + 0.1).alias("dev"))
    got = W.wald(per, dev, m).first()
    rows = study.samples.where("pheno is not null").collect()
    want = M.glm(np.array([float(r.pheno) for r in rows]), np.ones((N, 1)), np.array([abs(r.age) + 0.1 for r in rows]))
    assert got.effect == pytest.approx(want["effect"], rel=1e-7) and math.isclose(got.P, want["P"], rel_tol=1e-7)


@pytest.mark.parametrize("name", ["glm_burden", "gene_set_burden_subtract", "get_unit"])
def test_results_read_scores_that_are_made_once(spark, name):
    """Each reader of the scores used to derive all genotypes from the line items again."""
    files = queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)
