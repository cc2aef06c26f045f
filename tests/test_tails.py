"""Tail expressions against numeric integration and the standard library."""

import math

import pytest
from pyspark.sql import functions as F

from varloom.functions import dist as D
from varloom.functions import tails as T


def test_normal_tails(spark):
    x = [0.0, 0.1, 0.46, 0.47, 1.0, 2.5, 4.0, 4.1, 9.0, 25.0, 40.0]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", F.expr(T.erfc_sql("x")).alias("e"), F.expr(T.norm_two_sided_sql("-x")).alias("p")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-13) and r.p == pytest.approx(math.erfc(r.x / math.sqrt(2)), rel=1e-13)


def test_student_tails(spark):
    pairs = [(t, n) for n in (1, 2, 3, 10, 19, 20, 41, 97, 150, 1498, 10**6) for t in (0.0, 0.01, 0.5, -1.96, 3.0, 5.0, -12.0, 40.0)]
    rows = spark.createDataFrame(pairs, "t double, n long").withColumn("h", F.expr(T.hill_sql("t", "n"))).select("t", "n", T.t_two_sided("t", "n", "h").alias("p"), F.expr(T.t_quantile_sql("n")).alias("q")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r.p == pytest.approx(2 * D.t_sf(abs(r.t), r.n), rel=3e-7 if r.n < 30 else 1e-8, abs=1e-290), (r.t, r.n)
        if r.n >= 90:
            assert r.q == pytest.approx(D.t_quantile_sf(0.025, r.n), abs=1e-9)
