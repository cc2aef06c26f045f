"""Null models and tests made of their sums, against dense matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import dist
from varloom.operators import geno as G
from varloom.operators import score as S

R = np.random.default_rng(7)
N = 240
PLOIDY = ["diploid"] * 8 + ["XnonPAR"] * 4 + ["YnonPAR"] * 2


@pytest.fixture(scope="module")
def study(spark):
    """Samples of all sexes with a text and a number as covariates, variants of all ploidies and both baselines, missing genotypes."""
    rows = []
    for i in range(N):
        x = float(R.normal())
        rows.append((i, int(R.integers(0, 3)), int(R.random() < 1 / (1 + math.exp(-x))), float(R.normal() + x), x, 2 * x, str(R.choice(["low", "mid 2", "top"])), float(R.normal()) / 4, 1.0))
    rows.append((N, 1, None, None, 0.0, 0.0, "low", 0.0, 1.0))
    samples = spark.createDataFrame(rows, "IID long, sex int, pheno int, q double, age double, twice double, 2group string, off double, one double").withColumnRenamed("2group", "group")
    variants = spark.createDataFrame([(v, p, 2 if v % 3 == 0 else 0, "A", "C") for v, p in enumerate(PLOIDY)] + [(90, "diploid", 0, "G", "T")], "VAR_id long, ploidy string, g0 int, REF string, ALT string")
    cells = []
    for v in range(len(PLOIDY)):
        for i in R.choice(N + 1, 60 if v else 1, False):
            cells.append((v, int(i), None if R.random() < 0.1 else int(R.integers(0, 3))))
    return G.Geno(variants, samples, spark.createDataFrame(cells, "VAR_id long, IID long, gt int"))


def dense(geno, model, genetic_model):
    """Genotypes (samples x variants) of the model's samples: flipped, recoded; nan if missing."""
    ids = [r.IID for r in model.samples.orderBy("IID").collect()]
    sex = {r.IID: r.sex for r in geno.samples.collect()}
    kept = {(r.VAR_id, r.IID): r.gt for r in geno.stored.collect()}
    out, flags = {}, {}
    for v in geno.variants.collect():
        g = np.array([kept.get((v.VAR_id, i), v.g0) for i in ids], float)
        s = np.array([sex[i] for i in ids])
        if v.ploidy != "diploid":
            g = np.where(s == 1, np.minimum(g, 1), g)
            g[s == 0] = np.nan
            if v.ploidy == "YnonPAR":
                g[s == 2] = np.nan
        hap = (s == 1) & (v.ploidy != "diploid")
        ok = ~np.isnan(g)
        af = g[ok].sum() / max(np.where(hap, 1, 2)[ok].sum(), 1)
        flags[v.VAR_id] = af > 0.5
        if af > 0.5:
            g = np.where(hap, 1 - g, 2 - g)
        out[v.VAR_id] = {"allelic": g, "dominant": np.where(ok, g > 0, np.nan), "recessive": np.where(ok, g == 2, np.nan)}[genetic_model]
    return out, flags


def arrays(model):
    rows = model.samples.orderBy("IID").collect()
    return np.array([r.y for r in rows]), np.array([list(r.x) for r in rows]), np.array([r.r for r in rows]), np.array([r.v for r in rows])


def test_logistic_null_solves_its_score_equations(study):
    m = S.fit_null(study.samples, "pheno", ["age", "group", "one", "age"], "logistic", offset="off")
    assert m.terms == ("(Intercept)", "age", "groupmid.2", "grouptop") and m.n == N and m.df == N - 4
    y, x, r, v = arrays(m)
    assert np.abs(x.T @ r).max() < 1e-8 and np.allclose(m.inverse, np.linalg.inv(x.T @ (v[:, None] * x)))
    off = np.array([s.off for s in study.samples.where("pheno is not null").orderBy("IID").collect()])
    assert np.allclose(y - r, 1 / (1 + np.exp(-(x @ m.beta + off))))


def test_linear_null_drops_dependent_terms_and_is_kept(study, spark, tmp_path):
    m = S.fit_null(study.samples, "q", ["age", "twice", "group"])
    assert m.terms == ("(Intercept)", "age", "groupmid.2", "grouptop")
    y, x, r, _ = arrays(m)
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert np.allclose(m.beta, beta) and m.rss == pytest.approx(rss[0]) and np.allclose(r, y - x @ beta)
    m.save(str(tmp_path / "m"))
    back = S.NullModel.open(spark, str(tmp_path / "m"))
    assert back.coefficients() == m.coefficients() and back.terms == m.terms and back.totals.keys() == m.totals.keys()
    assert S.score_variants(study, back).count() == S.score_variants(study, m).count() == len(PLOIDY) + 1


@pytest.mark.parametrize("genetic_model", ["allelic", "dominant", "recessive"])
@pytest.mark.parametrize("kind", ["linear", "logistic"])
def test_all_variants_equal_dense_tests(study, kind, genetic_model):
    m = S.fit_null(study.samples, "q" if kind == "linear" else "pheno", ["age", "group"], kind, offset="off" if kind == "logistic" else None)
    y, x, r, v = arrays(m)
    g, flags = dense(study, m, genetic_model)
    raw, _ = dense(study, m, "allelic")
    got = {row.VAR_id: row for row in S.score_variants(study, m, genetic_model).collect()}
    assert got.keys() == {k for k in g if not np.isnan(raw[k]).all()}
    for k, row in got.items():
        ok = ~np.isnan(g[k])
        d = np.where(ok, g[k], g[k][ok].mean())
        U, h = d @ r, x.T @ (d * v)
        D = (d * d * v).sum() - h @ np.linalg.inv(x.T @ (v[:, None] * x)) @ h
        assert row.U == pytest.approx(U, abs=1e-7) and row.D == pytest.approx(D, abs=1e-7)
        assert (row.effectAllele, row.otherAllele) == ((("A", "C") if flags[k] else ("C", "A")) if k != 90 else ("T", "G"))
        case = (y == 1) if kind == "logistic" else np.ones(len(y), bool)
        assert row.caseMAC == g[k][case & ok].sum() and row.caseN == (case & ok).sum() and row.caseCallRate == pytest.approx((case & ok).sum() / case.sum())
        if kind == "logistic":
            assert row.ctrlMAC == g[k][~case & ok].sum() and row.ctrlN == (~case & ok).sum()
        skipped = g[k][ok].sum() < 2 or D <= 1e-9 * (d * d * v).sum()
        if skipped:
            assert row.P is None and row.effect is None
        elif kind == "linear":
            full = np.column_stack([x, d])
            beta, rss, *_ = np.linalg.lstsq(full, y, rcond=None)
            se = math.sqrt(rss[0] / (len(y) - full.shape[1]) * np.linalg.inv(full.T @ full)[-1, -1])
            assert row.effect == pytest.approx(beta[-1]) and row.effectSE == pytest.approx(se) and row.P == pytest.approx(2 * dist.t_sf(abs(beta[-1] / se), len(y) - full.shape[1]), rel=1e-6)
        else:
            assert row.P == pytest.approx(math.erfc(abs(U) / math.sqrt(2 * D)), rel=1e-9)
    assert got[0].P is None  # one stored cell


def test_units_and_gene_sets_equal_dense_regressions(study, spark):
    members = spark.createDataFrame([(f"u{v % 4}", v, 0.5 + v % 3) for v in range(len(PLOIDY))] + [("none", 90, 1.0)], "unit string, VAR_id long, w double")
    m = S.fit_null(study.samples, "q", ["age"])
    y, x, _, _ = arrays(m)
    ids = {r.IID: k for k, r in enumerate(m.samples.orderBy("IID").collect())}
    own = G.Geno(study.variants, study.samples.where("q is not null"), study.stored.join(study.samples.where("q is not null").select("IID"), "IID"))
    per, dev = G.burden(own, members)
    score = {}
    for r in G.scores(own, per, dev).collect():
        score.setdefault(r.unit, np.zeros(N))[ids[r.IID]] = r.score

    def regression(columns, at):
        full = np.column_stack([x, *columns])
        beta, rss, *_ = np.linalg.lstsq(full, y, rcond=None)
        df = len(y) - full.shape[1]
        se = math.sqrt(rss[0] / df * np.linalg.inv(full.T @ full)[at, at])
        return beta[at], se, 2 * dist.t_sf(abs(beta[at] / se), df)

    got = {r.unit: r for r in S.score_units(study, members, m).collect()}
    assert got.keys() == score.keys() and got["none"].P is None
    for u in ("u0", "u1", "u2", "u3"):
        want = regression([score[u]], -1)
        assert (got[u].effect, got[u].effectSE, got[u].P) == pytest.approx(want, rel=1e-6) and got[u].meanCaseScore == pytest.approx(score[u].mean())
    # binary phenotype: means of cases and controls
    b = S.fit_null(study.samples, "pheno", kind="logistic")
    for r in S.score_units(study, members.where("unit = 'u1'"), b).collect():
        case = np.array([s.y for s in b.samples.orderBy("IID").collect()]) == 1
        assert (r.meanCaseScore, r.meanCtrlScore, r.caseN, r.ctrlN) == (pytest.approx(score["u1"][case].mean()), pytest.approx(score["u1"][~case].mean()), case.sum(), (~case).sum())
    sets = spark.createDataFrame([("s1", "u0"), ("s1", "u1"), ("s1", "gone"), ("s2", "u2"), ("s3", "gone"), ("s1", "u0")], "geneSetName string, unit string")
    rows = {r.geneSetName: r for r in S.score_gene_sets(per, dev, sets, m).collect()}
    assert rows.keys() == {"s1", "s2"} and (rows["s1"].geneSetSize, rows["s1"].genesObs) == (3, 2)
    assert (rows["s1"].effect, rows["s1"].effectSE, rows["s1"].P) == pytest.approx(regression([score["u0"] + score["u1"]], -1), rel=1e-6)
    less = {r.geneSetName: r for r in S.score_gene_sets(per, dev, sets, m, drop_units=spark.createDataFrame([("u1",)], "unit string")).collect()}
    assert less["s1"].effect == pytest.approx(regression([score["u0"]], -1)[0])
    # a covariate that holds all units' scores, less each set's own
    load = sum(score[u] for u in ("u0", "u1", "u2", "u3"))
    with_load = study.samples.where("q is not null").join(spark.createDataFrame([(i, float(load[k])) for i, k in ids.items()], "IID long, load double"), "IID")
    taken = S.score_gene_sets(per, dev, sets, S.fit_null(with_load, "q", ["age", "load"]), subtract="load").where("geneSetName = 's1'").first()
    s1 = score["u0"] + score["u1"]
    assert (taken.effect, taken.effectSE, taken.P) == pytest.approx(regression([load - s1, s1], -1), rel=1e-6)
    with pytest.raises(ValueError):
        S.score_gene_sets(per, dev, sets, m, subtract="load")


def test_refusals(study):
    for args in (("nothing", []), ("q", ["nothing"]), ("q", [], "logistic"), ("one", [], "logistic"), ("q", [], "cubic")):
        with pytest.raises(ValueError):
            S.fit_null(study.samples, *args)
    with pytest.raises(ValueError):
        S.fit_null(study.samples.where("false"), "q")
    assert S.term_name("a b-c") == "a.b.c" and S.term_name("2x") == "X2x" and S.term_name("_x") == "X_x"
