"""Queries without an oracle cover all samples, variants and units of their tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from varloom.operators import assoc as A
from varloom.plans import projection as P

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute():
    """Carriers of each variant, counted cell by cell over all customers, and the number of customers."""
    con = duckdb.connect()
    for t in ("part", "customer", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    carriers = con.execute(P.sql("rare") + "SELECT VAR_id, any_value(unit), count(*) FILTER (WHERE g >= 1) FROM fcells GROUP BY 1").fetchall()
    return carriers, con.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_singlevar_tests_all_variants_and_samples(spark, brute):
    rows = entry.queries()["singlevar_tests"](spark, DIR).collect()
    assert {r.VAR_id for r in rows} == {v for v, _, n in brute[0] if n >= 2}
    assert {r.caseN + r.ctrlN for r in rows} == {brute[1]}


@pytest.mark.parametrize("name", ["rvb_continuous_tests", "rvb_resampled", "rvb_binary_tests"])
def test_burden_tests_all_units_and_samples(spark, brute, name):
    rows = entry.queries()[name](spark, DIR).select("unit", "caseN", "ctrlN").collect()
    units = {u for _, u, n in brute[0] if n >= 1}
    assert {r.unit for r in rows} == units if name != "rvb_binary_tests" else len({r.unit for r in rows}) > 4
    assert {r.caseN + (r.ctrlN if name != "rvb_continuous_tests" else 0) for r in rows} == {brute[1]}


def test_singlevar_derives_genotypes_once(spark):
    """Genotypes were derived twice: for the variants' counts, and for the tests."""
    plan = entry.queries()["singlevar_tests"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1


@pytest.mark.parametrize("covar,models,weights,continuous", [([], ["allelic", "dominant"], ["none"], False), (["superPop"], ["recessive"], ["none"], False), (["superPop"], ["allelic"], ["mb"], True)])
def test_singlevar_equals_units_of_one_variant(spark, covar, models, weights, continuous):
    """Also at X and Y, of variants with high baselines and with missing calls."""
    g = P.geno(spark, DIR, "rare")
    g = g.keep_variants(g.variants.where("VAR_id >= 140 and (ploidy <> 'diploid' or VAR_id % 10 = 0 or VAR_id % 7 = 0)"))
    tests, pheno = (["lm"], ["qpheno"]) if continuous else (["glm", "firth", "scoreSPA"], ["pheno"])
    options = {"covar": [covar], "models": models, "maf_weights": weights, "continuous": continuous, "carriers": (2, float("inf"))}
    one = A.singlevar(g, pheno, tests, **options).toPandas().sort_values(["geneticModel", "VAR_id", "test"], ignore_index=True)
    members = g.variants.select(F.col("VAR_id").cast("string").alias("unit"), "VAR_id", F.lit(1.0).alias("w"))
    units = A.rvb(g, members, pheno, tests, **options).toPandas().rename(columns={"unit": "VAR_id"}).astype({"VAR_id": "int64"})
    units = units.sort_values(["geneticModel", "VAR_id", "test"], ignore_index=True)
    assert len(one) == len(units) > 10 and set(one.columns) == set(units.columns)
    for c in units.columns:
        if one[c].dtype.kind == "f":
            assert np.allclose(one[c], units[c].astype(float), rtol=2e-6, atol=2e-6, equal_nan=True), c
        else:
            assert one[c].astype(object).where(one[c].notna(), None).tolist() == units[c].astype(object).where(units[c].notna(), None).tolist(), c


@pytest.mark.parametrize("times", [40])
def test_residuals_of_many_samples_are_not_broadcast(spark, monkeypatch, times):
    """More than MAX_SAMPLES samples were refused, as at 6 GB; the orders are the same."""
    g = P.geno(spark, DIR, "rare")
    members = g.variants.select("unit", "VAR_id", "w")
    options = {"covar": [["superPop"]], "n_resampling": times, "seed": 3}
    tests = ["skat", "skat_burden", "acatv"]
    want = A.rvb(g, members, ["pheno"], tests, **options).toPandas().sort_values(["unit", "test"], ignore_index=True)
    monkeypatch.setattr(A, "MAX_SAMPLES", 40)
    got = A.rvb(g, members, ["pheno"], tests, **options).toPandas().sort_values(["unit", "test"], ignore_index=True)
    assert len(got) == len(want) > 100 and got[["unit", "test", "nvar"]].equals(want[["unit", "test", "nvar"]])
    assert np.allclose(got["P"].astype(float), want["P"].astype(float), rtol=1e-9, atol=0, equal_nan=True)
    assert want["P"][want["test"] == "skat_resampled"].nunique() > 5
