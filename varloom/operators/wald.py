"""Logistic regressions (glm) of all units or variants at once, with Wald tests, from counted classes of samples.

A logistic fit needs, for every unit, sums over all samples at that unit's own coefficients, so the closed forms of
``score`` don't serve. But samples of equal sex, covariates and offset (a class), equal burden score and phenotype add
the same terms. So each unit keeps its counts by class and score: one row for each class of samples without stored
cells, and one for each class and different score of those with some. These rows, never a sample of each unit, are
what every Newton step reads: it joins them with the units' coefficients, adds up gradient and information with
map-side combining, and solves a system of the model's size for each unit. All units that still move step together.

Covariates that put the samples into more than ``CLASSES`` classes (continuous ones) are refused: the score tests of
``score`` and the sample-wise fits of ``assoc`` take them. Units that don't converge (separated ones), with a score that
the covariates explain, or with fewer than two carriers have null results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from varloom.functions.tails import Z975, norm_two_sided_sql

from . import geno as G
from . import score as S
from .shared import burden, drop, handed, staged

CLASSES = 1024
#: Newton steps at most, as usual for such models, and the step that counts as rest.
STEPS, REST = 25, 1e-9
#: Scores and offsets are told apart up to this many digits.
DIGITS = 12


def _offset(model: S.NullModel):
    if model.offset is None:
        return F.lit(0.0)
    linear = sum((float(b) * F.col("x")[j] for j, b in enumerate(model.beta)), F.lit(0.0))
    return F.round(F.log(F.col("mu") / (1 - F.col("mu"))) - linear, DIGITS)


def sample_classes(model: S.NullModel) -> tuple[DataFrame, DataFrame]:
    """(class, sex, x, o, n, cases) of the model's samples, at most ``CLASSES`` rows, and (IID, class, y) of each sample."""
    if model.kind != "logistic":
        raise ValueError("Wald tests of counts need a logistic null model")
    own = model.samples.select("IID", "sex", "y", "x", _offset(model).alias("o"))
    found = own.groupBy("sex", "x", "o").agg(F.count("*").alias("n"), F.sum("y").alias("cases")).limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        raise ValueError(f"the covariates of {model.pheno} make more than {CLASSES} classes of samples")
    schema = "class int, sex int, x array<double>, o double, n long, cases double"
    classes = own.sparkSession.createDataFrame([(i, r.sex, list(r.x), r.o, r.n, r.cases) for i, r in enumerate(found)], schema)
    of_sample = own.join(F.broadcast(classes.select("class", "sex", "x", "o")), ["sex", "x", "o"]).select("IID", "class", "y")
    return classes, of_sample


def counted(per: DataFrame, dev: DataFrame, model: S.NullModel, key: str) -> DataFrame:
    """key, x, o, s, n, cases: how many samples of a class have a score s, and how many of them are cases."""
    classes, of_sample = sample_classes(model)
    base = F.when(F.col("sex") == 1, F.col("b1")).when(F.col("sex") == 2, F.col("b2")).otherwise(F.col("b0"))
    held = dev.select(key, "IID", F.round("dev", DIGITS).alias("dev")).join(of_sample, "IID").groupBy(key, "class", "dev").agg(F.count("*").alias("n"), F.sum("y").alias("cases"))
    taken = held.groupBy(key, "class").agg(F.sum("n").alias("taken"), F.sum("cases").alias("taken_cases"))
    every = per.select(key, "b0", "b1", "b2").crossJoin(F.broadcast(classes))  # a unit's classes, at most ``CLASSES``
    rest = every.join(taken, [key, "class"], "left").na.fill(0, ["taken", "taken_cases"])
    rest = rest.select(key, "x", "o", base.alias("s"), (F.col("n") - F.col("taken")).alias("n"), (F.col("cases") - F.col("taken_cases")).alias("cases")).where("n > 0")
    own = held.join(F.broadcast(classes.drop("n", "cases")), "class").join(per.select(key, "b0", "b1", "b2"), key)
    return rest.unionByName(own.select(key, "x", "o", (base + F.col("dev")).alias("s"), "n", "cases"))


def _solve(key: str, k: int):
    """New coefficients of units whose sums are given; ``gap`` is the largest step, null where the score adds nothing to the covariates."""
    upper = np.triu_indices(k)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            sums, beta = np.stack(f["sums"].to_numpy()).astype(float), np.stack(f["beta"].to_numpy()).astype(float)
            info = np.zeros((len(f), k, k))
            info[:, upper[0], upper[1]] = info[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
            gradient = sums[:, len(upper[0]) :]
            own, h, a = info[:, :-1, :-1], info[:, :-1, -1:], info[:, -1, -1]
            both = np.linalg.solve(own, np.concatenate([h, gradient[:, :-1, None]], 2))
            left = a - (h[:, :, 0] * both[:, :, 0]).sum(1)
            able = left > 1e-9 * a
            last = np.where(able, (gradient[:, -1] - (h[:, :, 0] * both[:, :, 1]).sum(1)) / np.where(able, left, 1.0), 0.0)
            step = np.concatenate([both[:, :, 1] - both[:, :, 0] * last[:, None], last[:, None]], 1)
            gap = pd.array(np.abs(step).max(1), "Float64")
            gap[~able] = pd.NA
            yield pd.DataFrame({key: f[key], "beta": list(beta + step), "variance": 1 / np.where(able, left, np.inf), "gap": gap.astype(object)})

    return of


def fit(per: DataFrame, dev: DataFrame, model: S.NullModel, key: str = "unit", steps: int = STEPS) -> DataFrame:
    """key, beta (the null model's terms, then the score), variance of the score's coefficient, and the last step's ``gap``.

    Steps start at the null model's coefficients. The counted rows and each step's coefficients are tables in the shared folder, so no
    plan grows with the steps and a lost executor costs its tasks only; all but the result are deleted.
    """
    k = len(model.terms) + 1
    rows = handed(counted(per, dev, model, key), "classes")
    terms = [F.col("x")[j] for j in range(k - 1)] + [F.col("s")]
    start = F.array(*(F.lit(float(b)) for b in model.beta), F.lit(0.0))
    state = rows.select(key).distinct().select(key, start.alias("beta"), F.lit(0.0).alias("variance"), F.lit(float("inf")).alias("gap"))
    schema = f"{per.select(key).schema[0].simpleString().replace(':', ' ')}, beta array<double>, variance double, gap double"
    try:
        for _ in range(steps):
            eta = sum((t * F.col("beta")[j] for j, t in enumerate(terms)), F.col("o"))
            at = G.barrier(rows.join(state.where(F.col("gap") >= REST).select(key, "beta"), key).withColumn("mu", 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))))))
            weight = F.col("n") * F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-10))
            sums = [F.sum(weight * terms[i] * terms[j]) for i in range(k) for j in range(i, k)]
            sums += [F.sum((F.col("cases") - F.col("n") * F.col("mu")) * t) for t in terms]
            added = at.groupBy(key).agg(F.array(*sums).alias("sums"), F.first("beta").alias("beta"))
            before, state = state, handed(added.mapInPandas(_solve(key, k), schema).unionByName(state.where(F.col("gap").isNull() | (F.col("gap") < REST))), "coefficients")
            drop(before)
            if not state.where(F.col("gap") >= REST).limit(1).count():
                break
    finally:
        drop(rows)
    return state


def wald(per: DataFrame, dev: DataFrame, model: S.NullModel, key: str = "unit") -> DataFrame:
    """The burden result of ``score`` with the effect, its error and interval, OR and P of logistic regressions (test ``glm``)."""
    base = S._burden_result(per, dev, key, model)
    got = fit(per, dev, model, key).where(F.col("gap") < REST).select(key, F.element_at("beta", -1).alias("_b"), F.sqrt("variance").alias("_se"))
    df = base.join(got, key, "left")
    able = F.col("P").isNotNull() & (F.col("_se") > 0)
    df = G.barrier(df.withColumns({"effect": F.when(able, F.col("_b")), "effectSE": F.when(able, F.col("_se")), "z": F.when(able, F.col("_b") / F.col("_se"))}))
    reach = Z975 * F.col("effectSE")
    out = df.withColumns({"effectCIlower": F.col("effect") - reach, "effectCIupper": F.col("effect") + reach, "OR": F.exp(F.when(F.col("effect") > 700, 700.0).otherwise(F.col("effect"))), "P": F.expr(norm_two_sided_sql("z")), "test": F.lit("glm")})
    return out.drop("z", "_b", "_se")


def glm_units(geno: G.Geno, members: DataFrame, model: S.NullModel, genetic_model: str = "allelic", impute: str = "meanImpute", maf_weights: str = "none", **bounds) -> DataFrame:
    """``wald`` of the burden scores of units (unit, VAR_id, w), with their ``nvar``; a unit of one variant of weight 1 is a single-variant test."""
    ids = model.samples.select("IID")
    own = G.Geno(geno.variants, geno.samples.join(ids, "IID", "left_semi"), geno.stored.join(ids, "IID", "left_semi"))
    with staged(own) as cells:
        per, dev = burden(cells, members, genetic_model, impute, maf_weights, **bounds)
    return wald(per, dev, model).select("unit", "pheno", "covar", "test", "nvar", "caseN", "ctrlN", "meanCaseScore", "meanCtrlScore", "effect", "effectSE", "effectCIlower", "effectCIupper", "OR", "P")
