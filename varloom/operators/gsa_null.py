"""The mixed model of correlated units, block by block.

Units of different blocks are independent, so their covariance is h R + (1 - h) I, up to a factor, with R block-diagonal. Every block is
decomposed in a task of its own; in the rotated coordinates all rows are independent with variance h d + 1 - h, d being
an eigenvalue. So the likelihood of any h is a function of sums over rows, and a few of those sums, for a grid of h at a
time, are all that comes to the driver. The model is kept as tables: ``rows`` (block, k, d, z, x) and ``vectors``
(unit, block, u). No matrix over all units is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.functions.tails import Z975, barrier, norm_two_sided_sql

from .gsa import near_pd

#: Points of the grid of h, and how often it is narrowed.
GRID, ROUNDS = 21, 4
#: Units of a block; a larger one is refused, as its matrix lies in one task.
MAX_BLOCK = 4096


@dataclass(frozen=True)
class NullModelGSA:
    rows: DataFrame
    vectors: DataFrame
    terms: tuple[str, ...]
    beta: np.ndarray
    #: (X'V^-1 X)^-1 for the variance without its factor ``sigma2``; ``h`` is the share of R.
    inverse: np.ndarray
    sigma2: float
    h: float
    n: int
    log_likelihood: float

    def get_null_model(self) -> dict[str, float]:
        return {"h": self.h, "varianceCorrelated": self.h * self.sigma2, "varianceResidual": (1 - self.h) * self.sigma2, "logLik": self.log_likelihood, "n": self.n}

    def get_results(self, spark: SparkSession) -> DataFrame:
        """term, estimate, SE of the fixed effects."""
        se = np.sqrt(np.diag(self.inverse) * self.sigma2)
        return spark.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(self.terms, self.beta, se, strict=True)], "term string, estimate double, SE double")

    def get_covar(self) -> list[str]:
        return list(self.terms[1:])

    def list_units(self) -> DataFrame:
        return self.vectors.select("unit")

    def __len__(self) -> int:
        return self.n


def _decomposed(covar: list[str], make_pd: bool):
    def of(key, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame([], columns=["block", "unit", "k", "d", "z", "x", "u"])
        if len(own) > MAX_BLOCK:
            raise ValueError(f"block {key[0]} has more than {MAX_BLOCK} units")
        own = own.sort_values("unit", ignore_index=True)
        at = {u: i for i, u in enumerate(own["unit"])}
        r = np.eye(len(own))
        for a, b, v in zip(pairs["unit_a"], pairs["unit_b"], pairs["r"], strict=True):
            if a in at and b in at:
                r[at[a], at[b]] = r[at[b], at[a]] = v
        if make_pd and len(own) > 1:
            r = near_pd(r)
        d, u = np.linalg.eigh(r)
        x = np.column_stack([np.ones(len(own)), *(own[c].to_numpy(float) for c in covar)])
        return pd.DataFrame({"block": str(key[0]), "unit": own["unit"], "k": np.arange(len(own)), "d": np.maximum(d, 0), "z": u.T @ own["Z"].to_numpy(float), "x": list(u.T @ x), "u": list(u)})

    return of


def fit(stats: DataFrame, blocks: DataFrame, correlations: DataFrame, covar: list[str] = (), make_pd: bool = True) -> NullModelGSA:
    """The model of Z on covariates for units (unit, Z, ...), their blocks (block, unit) and correlations (block, unit_a, unit_b, r).

    A unit of no block is one of its own. REML: h maximises the restricted likelihood. The sums of the fit are made from a table kept in the executors' memory and disk.
    """
    covar = list(dict.fromkeys(covar))
    spark, k = stats.sparkSession, len(covar) + 1
    block = F.coalesce(F.concat(F.lit("b"), F.col("block").cast("string")), F.concat(F.lit("u"), F.col("unit")))
    own = stats.select("unit", F.col("Z").cast("double").alias("Z"), *(F.col(c).cast("double").alias(c) for c in covar)).join(blocks.select("unit", "block"), "unit", "left").withColumn("block", block)
    pairs = correlations.where("r <> 0").select(F.concat(F.lit("b"), F.col("block").cast("string")).alias("block"), "unit_a", "unit_b", "r")
    out = own.groupBy("block").cogroup(pairs.groupBy("block")).applyInPandas(_decomposed(covar, make_pd), "block string, unit string, k int, d double, z double, x array<double>, u array<double>").persist()
    rows, vectors = out.select("block", "k", "d", "z", "x"), out.select("unit", "block", "u")
    n = rows.count()
    if n <= k:
        raise ValueError(f"{n} units are too few for {k} terms")

    def sums(grid: np.ndarray) -> list:
        at = spark.createDataFrame([(float(h),) for h in grid], "h double")
        v = rows.crossJoin(F.broadcast(at)).withColumn("v", F.col("h") * F.col("d") + 1 - F.col("h"))  # GRID rows
        x = [F.col("x")[j] for j in range(k)]
        gram = [F.sum(x[i] * x[j] / F.col("v")) for i in range(k) for j in range(i, k)]
        return v.groupBy("h").agg(F.sum(F.log("v")), F.sum(F.col("z") * F.col("z") / F.col("v")), *(F.sum(c * F.col("z") / F.col("v")) for c in x), *gram).orderBy("h").collect()

    def solve(row):
        h, logs, zz, rest = row[0], row[1], row[2], row[3:]
        xz, a = np.array(rest[:k]), np.zeros((k, k))
        for (i, j), value in zip([(i, j) for i in range(k) for j in range(i, k)], rest[k:], strict=True):
            a[i, j] = a[j, i] = value
        inverse = np.linalg.inv(a)
        beta = inverse @ xz
        rss = zz - xz @ beta
        return -0.5 * (logs + np.linalg.slogdet(a)[1] + (n - k) * (np.log(rss / (n - k)) + 1)), h, beta, inverse, rss / (n - k)

    lo, hi = 0.0, 0.999
    best = None
    for _ in range(ROUNDS):
        grid = np.linspace(lo, hi, GRID)
        found = [solve(r) for r in sums(grid)]
        top = max(range(len(found)), key=lambda i: (found[i][0] if i == 0 else found[i][0] - 1e-10 * abs(found[i][0]), -i))
        best = found[top]
        lo, hi = grid[max(top - 1, 0)], grid[min(top + 1, GRID - 1)]
    log_likelihood, h, beta, inverse, sigma2 = best
    return NullModelGSA(rows, vectors, ("(Intercept)", *covar), beta, inverse, float(sigma2), float(h), n, float(log_likelihood))


def test_sets(model: NullModelGSA, sets: DataFrame) -> DataFrame:
    """geneSetName, genesObs, effect, effectSE, interval and two-sided P of the score test of membership (geneSetName, unit) given the null model."""
    k = len(model.terms)
    held = sets.select("geneSetName", "unit").distinct().join(model.vectors, "unit")
    member = held.select("geneSetName", "block", F.posexplode("u").alias("k", "s")).groupBy("geneSetName", "block", "k").agg(F.sum("s").alias("s"))
    size = held.groupBy("geneSetName").agg(F.count("*").alias("genesObs"))
    v = F.lit(model.h) * F.col("d") + (1 - model.h)
    left = F.col("z") - sum((F.col("x")[j] * float(model.beta[j]) for j in range(1, k)), F.col("x")[0] * float(model.beta[0]))
    got = member.join(model.rows, ["block", "k"]).withColumns({"v": v, "e": left})
    sums = got.groupBy("geneSetName").agg(F.sum(F.col("s") * F.col("e") / F.col("v")).alias("U"), F.sum(F.col("s") * F.col("s") / F.col("v")).alias("A"), *(F.sum(F.col("s") * F.col("x")[j] / F.col("v")).alias(f"h{j}") for j in range(k)))
    given = sum((F.col(f"h{i}") * F.col(f"h{j}") * float(model.inverse[i, j] * (1 if i == j else 2)) for i in range(k) for j in range(i, k)), F.lit(0.0))
    df = barrier(sums.withColumn("D", F.col("A") - given)).where("D > 1e-9 * A")
    df = barrier(df.withColumns({"effect": F.col("U") / F.col("D"), "effectSE": F.lit(model.sigma2**0.5) / F.sqrt("D")}))
    df = barrier(df.withColumn("z", F.col("effect") / F.col("effectSE"))).join(size, "geneSetName")
    half = Z975 * F.col("effectSE")
    return df.select("geneSetName", "genesObs", "effect", "effectSE", (F.col("effect") - half).alias("effectCIlower"), (F.col("effect") + half).alias("effectCIupper"), F.expr(norm_two_sided_sql("z")).alias("P"))
