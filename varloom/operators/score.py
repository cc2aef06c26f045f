"""Null models, and the tests that need only sums of their residuals: all variants in one pass, units and gene sets.

A null model is fitted by sums over samples: each step adds up the Gram matrix of the design and the gradient where the
samples lie, and a few numbers come to the driver. It is kept as two tables: its terms, and the samples with residual
``r``, variance weight ``v`` (1, or mu (1 - mu)) and design.

A genotype or burden score x has two parts: the baseline of a sample's sex, and what stored cells add to it. So the
sums that a test needs,

    U = sum x r,   A = sum x^2 v,   H_j = sum x v x_j,

are a closed form of the baselines and the model's totals by sex, plus sums over stored cells. The score's variance
given the covariates is D = A - H' (X'VX)^-1 H. In a linear model U / D is the coefficient of x in the regression on covariates and x, and
its standard error follows from U and D too (partialling out); in a logistic model U / sqrt(D) is the score statistic.
Nothing is made dense, no Python worker takes part, and no sample table is broadcast unless Spark finds it small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varloom.functions import dist
from varloom.functions.tails import norm_two_sided_sql, with_t

from . import geno as G
from .sets import union

#: Columns of a design, and levels of a text covariate; more are refused (the Gram matrix grows with the square).
MAX_TERMS, MAX_LEVELS = 64, 64
INTERCEPT = "(Intercept)"

#: The columns of a single-variant result, and of a burden result.
SINGLE_COLUMNS = ("VAR_id", "cohort", "varSetName", "name", "pheno", "covar", "geneticModel", "test", "caseMAC", "ctrlMAC", "caseMAF", "ctrlMAF", "caseN", "ctrlN", "caseCallRate", "ctrlCallRate", "effectAllele", "otherAllele", "effect", "effectSE", "effectCIlower", "effectCIupper", "OR", "P")


def term_name(text: str) -> str:
    """A name of letters, digits, dots and underscores that doesn't begin with a digit."""
    out = re.sub(r"[^A-Za-z0-9._]", ".", text)
    return out if re.match(r"[A-Za-z]|\.(?!\d)", out) else f"X{out}"


def design(samples: DataFrame, covar: list[str]) -> dict[str, Column]:
    """Terms and their columns: one, numbers as they are, text as indicators of all levels but the first; constant terms are left out."""
    covar = list(dict.fromkeys(covar))
    if gone := [c for c in covar if c not in samples.columns]:
        raise ValueError(f"no such covariates in the cohort: {gone}")
    kinds = dict(samples.dtypes)
    terms: dict[str, Column] = {}
    for c in covar:
        if kinds[c] == "string":
            levels = sorted(r[0] for r in samples.select(c).where(F.col(c).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect())
            if len(levels) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
            terms |= {term_name(f"{c}{v}"): (F.col(c) == v).cast("double") for v in levels[1:]}
        else:
            terms[term_name(c)] = F.col(c).cast("double")
    if terms:
        names = list(terms)
        ends = samples.agg(*(F.min(terms[n]).alias(f"lo{k}") for k, n in enumerate(names)), *(F.max(terms[n]).alias(f"hi{k}") for k, n in enumerate(names))).first()
        terms = {n: terms[n] for k, n in enumerate(names) if ends[f"lo{k}"] != ends[f"hi{k}"]}
    if len(terms) >= MAX_TERMS:
        raise ValueError(f"a design has at most {MAX_TERMS} terms")
    return {INTERCEPT: F.lit(1.0), **terms}


def independent(gram: np.ndarray) -> list[int]:
    """Columns of a Gram matrix that don't depend on earlier ones."""
    keep: list[int] = []
    for j in range(len(gram)):
        if gram[j, j] <= 0:
            continue
        rest = gram[j, j] - (gram[j, keep] @ np.linalg.solve(gram[np.ix_(keep, keep)], gram[keep, j]) if keep else 0)
        if rest > 1e-9 * gram[j, j]:
            keep.append(j)
    return keep


@dataclass(frozen=True)
class NullModel:
    """``samples``: IID, sex, y, mu, r, v, x (array of the terms). ``inverse`` is (X'VX)^-1; ``rss`` the sum of r^2."""

    kind: str
    pheno: str
    covar: tuple[str, ...]
    offset: str | None
    terms: tuple[str, ...]
    beta: np.ndarray
    inverse: np.ndarray
    rss: float
    n: int
    samples: DataFrame
    #: By sex: n, cases (sum of y), r, and v times each term.
    totals: dict[int, dict] = field(default_factory=dict)
    #: What the fit has kept in the executors' memory, of which ``samples`` is made.
    held: DataFrame | None = None

    def release(self) -> None:
        """Give the executors' memory back; ``samples`` is then read from its source again."""
        if self.held is not None:
            self.held.unpersist()

    @property
    def df(self) -> int:
        """Residual degrees of freedom of the null model."""
        return self.n - len(self.terms)

    def coefficients(self) -> list[tuple[str, float, float]]:
        """term, estimate, standard error."""
        scale = self.rss / self.df if self.kind == "linear" else 1.0
        return [(t, float(b), float(np.sqrt(c * scale))) for t, b, c in zip(self.terms, self.beta, np.diag(self.inverse), strict=True)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.coefficients(), "term string, estimate double, SE double")

    def save(self, path: str) -> None:
        """The model as tables: ``samples``, and ``model`` with its terms and their inverse."""
        self.samples.write.parquet(f"{path}/samples")
        rows = [(self.kind, self.pheno, list(self.covar), self.offset, list(self.terms), self.beta.tolist(), self.inverse.ravel().tolist(), self.rss, self.n)]
        schema = "kind string, pheno string, covar array<string>, offset string, terms array<string>, beta array<double>, inverse array<double>, rss double, n long"
        self.samples.sparkSession.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/model")

    @staticmethod
    def open(spark: SparkSession, path: str) -> NullModel:
        m, samples = spark.read.parquet(f"{path}/model").first(), spark.read.parquet(f"{path}/samples")
        k = len(m.terms)
        return NullModel(m.kind, m.pheno, tuple(m.covar), m.offset, tuple(m.terms), np.array(m.beta), np.array(m.inverse).reshape(k, k), m.rss, m.n, samples, _totals(samples, k))


def _totals(samples: DataFrame, terms: int) -> dict[int, dict]:
    sums = [F.count("*").alias("n"), F.sum("y").alias("cases"), F.sum("r").alias("r"), *(F.sum(F.col("v") * F.col("x")[j]).alias(f"vx{j}") for j in range(terms))]
    got = {r.sex: r for r in samples.groupBy("sex").agg(*sums).collect()}  # three rows
    none = {"n": 0, "cases": 0.0, "r": 0.0} | {f"vx{j}": 0.0 for j in range(terms)}
    return {s: {k: got[s][k] for k in none} if s in got else none for s in G.SEXES}


def _gram(rows: DataFrame, k: int, weight: Column, gradient: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'g by one aggregation over samples."""
    x = [F.col("x")[j] for j in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.withColumns({"_w": weight, "_g": gradient}).agg(*(F.sum(F.col("_w") * x[i] * x[j]) for i, j in pairs), *(F.sum(F.col("_g") * x[j]) for j in range(k))).first()
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, got, strict=False):
        gram[i, j] = gram[j, i] = v
    return gram, np.array(got[len(pairs) :], float)


def fit_null(samples: DataFrame, pheno: str, covar: list[str] = (), kind: str = "linear", offset: str | None = None, tolerance: float = 1e-10, most: int = 25) -> NullModel:
    """A linear or logistic model of a phenotype on covariates, for the samples (IID, sex, ...) that have all of them.

    Terms that depend on earlier ones are left out. A logistic fit takes Newton steps until the coefficients rest; ValueError if they don't.
    """
    covar = list(dict.fromkeys(covar))
    if gone := [c for c in (pheno, offset) if c and c not in samples.columns]:
        raise ValueError(f"no such columns in the cohort: {gone}")
    needed = [pheno, *covar, *([offset] if offset else [])]
    rows = samples.dropna(subset=[c for c in needed if c in samples.columns])
    terms = design(rows, covar)
    base = rows.select("IID", "sex", F.col(pheno).cast("double").alias("y"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("o"), F.array(*terms.values()).alias("x"))
    # read once for every step; what an executor loses of it is read again
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    if not base.limit(1).count():
        raise ValueError("no sample has the phenotype and all covariates")
    if kind == "logistic":
        ends = base.agg(F.count_if(~F.col("y").isin(0.0, 1.0)).alias("odd"), F.countDistinct("y").alias("classes")).first()
        if ends.odd or ends.classes < 2:
            raise ValueError(f"{pheno} must have cases (1) and controls (0) only, and some of both")
    elif kind != "linear":
        raise ValueError(f"no such kind of model: {kind}")
    names = list(terms)
    gram, _ = _gram(base, len(names), F.lit(1.0), F.lit(0.0))
    keep = independent(gram)
    names = [names[j] for j in keep]
    rows = base.withColumn("x", F.array(*(F.col("x")[j] for j in keep)))
    beta = np.zeros(len(names))
    linear = lambda b: sum((float(c) * F.col("x")[j] for j, c in enumerate(b)), F.col("o"))
    if kind == "linear":
        gram, gradient = _gram(rows, len(names), F.lit(1.0), F.col("y") - F.col("o"))
        beta = np.linalg.solve(gram, gradient)
    else:
        for _ in range(most):
            fitted = rows.withColumn("mu", 1 / (1 + F.exp(-linear(beta))))
            gram, gradient = _gram(fitted, len(names), F.col("mu") * (1 - F.col("mu")), F.col("y") - F.col("mu"))
            step = np.linalg.solve(gram, gradient)
            beta = beta + step
            if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()):
                break
        else:
            raise ValueError(f"the null model of {pheno} doesn't converge")
    mu = linear(beta) if kind == "linear" else 1 / (1 + F.exp(-linear(beta)))
    own = rows.withColumn("mu", mu).select("IID", "sex", "y", "mu", (F.col("y") - F.col("mu")).alias("r"), (F.lit(1.0) if kind == "linear" else F.col("mu") * (1 - F.col("mu"))).alias("v"), "x")
    gram, _ = _gram(own, len(names), F.col("v"), F.lit(0.0))
    facts = own.agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rss")).first()
    return NullModel(kind, pheno, tuple(covar), offset, tuple(names), beta, np.linalg.inv(gram), facts.rss, facts.n, own, _totals(own, len(names)), base)


def _by_sex(model: NullModel, column: str, total: str) -> Column:
    """Sum over sexes of a column (b0, b1, b2 with ``column`` = "b") times the model's total."""
    return sum((F.col(f"{column}{s}") * float(model.totals[s][total]) for s in G.SEXES[1:]), F.col(f"{column}0") * float(model.totals[0][total]))


def _statistics(df: DataFrame, model: NullModel) -> DataFrame:
    """U and D of rows with b0, b1, b2, and the sums of deviations: du (dev r), da ((x^2 - b^2) v), dh<j> (dev v x_j)."""
    k = len(model.terms)
    square = sum((F.col(f"b{s}") * F.col(f"b{s}") * float(model.totals[s]["vx0"]) for s in G.SEXES[1:]), F.col("b0") * F.col("b0") * float(model.totals[0]["vx0"]))
    df = G.barrier(df.withColumns({"U": _by_sex(model, "b", "r") + F.col("du"), "A": square + F.col("da"), **{f"h{j}": _by_sex(model, "b", f"vx{j}") + F.col(f"dh{j}") for j in range(k)}}))
    given = sum((F.col(f"h{i}") * F.col(f"h{j}") * float(model.inverse[i, j] * (1 if i == j else 2)) for i in range(k) for j in range(i, k)), F.lit(0.0))
    return G.barrier(df.withColumn("D", F.col("A") - given))


def _tested(df: DataFrame, model: NullModel, able: Column, subtract: int | None = None) -> DataFrame:
    """effect, effectSE, CI, OR and P of rows with U, A, D, h<j>; null where ``able`` doesn't hold or nothing is left of x beside the covariates.

    ``subtract``: the model's covariate of this number less x takes its place.
    """
    able = able & (F.col("D") > 1e-9 * F.col("A"))
    if model.kind == "logistic":
        df = G.barrier(df.withColumns({"z": F.when(able, F.col("U") / F.sqrt("D"))}))
        none = F.lit(None).cast("double")
        return df.withColumns({"effect": none, "effectSE": none, "effectCIlower": none, "effectCIupper": none, "OR": none, "P": F.expr(norm_two_sided_sql("z"))}).drop("z")
    left = model.df - 1
    coefficient, variance = F.col("U") / F.col("D"), 1 / F.col("D")
    if subtract is not None:
        slope = sum((F.col(f"h{j}") * float(model.inverse[subtract, j]) for j in range(len(model.terms))), F.lit(0.0))
        coefficient, variance = (1 - slope) * coefficient + float(model.beta[subtract]), float(model.inverse[subtract, subtract]) + (1 - slope) * (1 - slope) / F.col("D")
    residual = F.greatest(F.lit(model.rss) - F.col("U") * F.col("U") / F.col("D"), F.lit(0.0)) / max(left, 1)
    able = able & F.lit(left >= 1)
    df = G.barrier(df.withColumns({"effect": F.when(able, coefficient), "effectSE": F.when(able, F.sqrt(variance * residual))}))
    reach = float(dist.t_quantile_sf(0.025, max(left, 1)))
    df = with_t(df, "effect", "effectSE", F.lit(max(left, 1)))
    return df.withColumns({"effectCIlower": F.col("effect") - reach * F.col("effectSE"), "effectCIupper": F.col("effect") + reach * F.col("effectSE"), "OR": F.lit(None).cast("double")})


def _at(column: str, sex: Column) -> Column:
    return F.when(sex == 1, F.col(f"{column}1")).when(sex == 2, F.col(f"{column}2")).otherwise(F.col(f"{column}0"))


def cell_sums(geno: G.Geno, models: list[NullModel]) -> DataFrame:
    """VAR_id, sex, gt, and for model t the sums n<t>, y<t>, r<t> and v<t>_<j> (v times term j) of the stored cells of its samples.

    Models of other phenotypes and covariates have other samples: a sample carries its part in each model, or null where it is left
    out, so the genotypes are read once for all models.
    """
    part = F.struct("y", "r", "v", "x")
    if len(models) == 1:
        own = models[0].samples.select("IID", "sex", part.alias("m0"))
    else:
        rows = union([m.samples.select("IID", "sex", F.lit(t).alias("t"), part.alias("m")) for t, m in enumerate(models)])
        own = rows.groupBy("IID", "sex").agg(*(F.first(F.when(F.col("t") == t, F.col("m")), ignorenulls=True).alias(f"m{t}") for t in range(len(models))))
    sums = []
    for t, m in enumerate(models):
        at = lambda f, t=t: F.col(f"m{t}.{f}")
        sums += [F.count(f"m{t}").alias(f"n{t}"), F.sum(at("y")).alias(f"y{t}"), F.sum(at("r")).alias(f"r{t}")]
        sums += [F.sum(at("v") * at("x")[j] if j else at("v")).alias(f"v{t}_{j}") for j in range(len(m.terms))]
    return geno.stored.select("VAR_id", "IID", F.col("gt").cast("int").alias("gt")).join(own, "IID").groupBy("VAR_id", "sex", "gt").agg(*sums)


def class_sums(geno: G.Geno, model: NullModel, sums: DataFrame | None = None, task: int = 0) -> DataFrame:
    """One row for each variant: ploidy, g0, counts of all samples (k<sex><g>, n<sex>) and of cases (c<sex><g>), and ``cells``.

    ``cells`` has the sums (n, y, r, v and v times each term) of the stored cells of each sex and genotype, so at most twelve
    entries. They are added up before the shuffle; after it, every genetic model is a closed form of them. ``sums``: those of
    ``cell_sums``, if they have been made, where the model has the number ``task``.
    """
    k = len(model.terms)
    sums = cell_sums(geno, [model]) if sums is None else sums
    own = [F.col(f"{c}{task}").alias(c) for c in "nyr"] + [F.col(f"v{task}_{j}").alias(f"vx{j}") for j in range(k)]
    sums = sums.where(F.col(f"n{task}") > 0).select("VAR_id", "sex", "gt", *own)
    sums = sums.join(geno.variants.select("VAR_id", "ploidy"), "VAR_id").withColumn("gt", G.reset(F.col("gt"), F.col("ploidy"), F.col("sex")))
    aggs = [F.collect_list(F.struct("sex", "gt", "n", "y", "r", F.array(*(f"vx{j}" for j in range(k))).alias("vx"))).alias("cells")]
    for prefix, what in (("k", "n"), ("c", "y")):
        for s in G.SEXES:
            here = lambda cond, s=s, what=what: F.coalesce(F.sum(F.when((F.col("sex") == s) & cond, F.col(what))), F.lit(0))
            aggs += [here(F.lit(True)).alias(f"{prefix}stored{s}"), *(here(F.col("gt") == g).alias(f"{prefix}{s}{g}") for g in (0, 1, 2))]
    out = geno.variants.join(sums.groupBy("VAR_id").agg(*aggs), "VAR_id", "left")
    cols = {"cells": F.coalesce("cells", F.array().cast(sums_type(k)))}
    for prefix, size in (("k", "n"), ("c", "cases")):
        for s in G.SEXES:
            base = F.when(G.haploid(F.col("ploidy"), s), F.least("g0", F.lit(1))).otherwise(F.col("g0"))
            left = F.lit(model.totals[s][size]).cast("long") - F.coalesce(f"{prefix}stored{s}", F.lit(0)).cast("long")
            for g in (0, 1, 2):
                cols[f"{prefix}{s}{g}"] = F.coalesce(f"{prefix}{s}{g}", F.lit(0)).cast("long") + F.when(~G.absent(F.col("ploidy"), s) & (base == g), left).otherwise(0)
    cols |= {f"n{s}": F.lit(model.totals[s]["n"]).cast("long") for s in G.SEXES}
    gone = [f"{p}stored{s}" for p in "kc" for s in G.SEXES]
    return G.barrier(out.withColumns(cols).drop(*gone))


def sums_type(k: int) -> str:
    return "array<struct<sex:int,gt:int,n:bigint,y:double,r:double,vx:array<double>>>"


def score_variants(geno: G.Geno, model: NullModel, genetic_model: str = "allelic", impute: str = "meanImpute", cohort: str = "SM", var_set: str = "none", name: str = "none", sums: DataFrame | None = None, task: int = 0, **bounds) -> DataFrame:
    """A single-variant result of all variants: ``lm`` of a linear model, the score test (``score``) of a logistic one; also U and D.

    Alleles are flipped to the rarer one first (in the model's samples). Missing genotypes count as the variant's mean (``meanImpute``) or as
    reference. Every variant that the bounds leave has a row; tests are skipped (null) where caseMAC and ctrlMAC together are under 2 or the covariates leave nothing.
    A linear model has no controls: ctrlN is 0, other control columns are null.
    """
    k = len(model.terms)
    counted = G.filter_variants(G.flip(class_sums(geno, model, sums, task), prefixes=("k", "c")), **bounds)
    based = G.baselines(counted, genetic_model, impute, prefixes=("k", "c"))
    turned = lambda c: F.when(F.col("flipped"), F.when((c["sex"] == 1) & F.col("ploidy").isin("XnonPAR", "YnonPAR"), 1 - c["gt"]).otherwise(2 - c["gt"])).otherwise(c["gt"])
    value = lambda c: F.coalesce(G.of_model(turned(c), genetic_model).cast("double"), F.col("fill"))
    base = lambda c: F.when(c["sex"] == 1, F.col("b1")).when(c["sex"] == 2, F.col("b2")).otherwise(F.col("b0"))
    parts = F.transform("cells", lambda c: F.struct(value(c).alias("x"), base(c).alias("b"), c["r"].alias("r"), c["vx"].alias("vx")))
    df = G.barrier(based.withColumn("cells", parts))
    add = lambda f: F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + f(c))
    df = df.withColumns({"du": add(lambda c: (c["x"] - c["b"]) * c["r"]), "da": add(lambda c: (c["x"] * c["x"] - c["b"] * c["b"]) * c["vx"][0]), **{f"dh{j}": add(lambda c, j=j: (c["x"] - c["b"]) * c["vx"][j]) for j in range(k)}})
    df = _statistics(df.drop("cells"), model)
    linear = model.kind == "linear"
    # under the genetic model; frequencies are of the flipped alleles before it
    mac = lambda p, g: sum((F.col(f"{p}{s}{g}") for s in G.SEXES[1:]), F.col(f"{p}0{g}"))
    called = lambda p: mac(p, 0) + mac(p, 1) + mac(p, 2)
    null = lambda kind: F.lit(None).cast(kind)
    cases = sum(int(t["cases"]) for t in model.totals.values()) if not linear else model.n
    controls = model.n - cases
    allelic = genetic_model == "allelic"
    of_cases = G.frequency("k" if linear else "c")
    own = {"caseMAC": (mac("k", 1) + 2 * mac("k", 2)) if linear else (mac("c", 1) + 2 * mac("c", 2))}
    own["ctrlMAC"] = null("long") if linear else (mac("k", 1) + 2 * mac("k", 2)) - own["caseMAC"]
    own["caseN"], own["ctrlN"] = (called("k"), F.lit(0).cast("long")) if linear else (called("c"), called("k") - called("c"))
    own["caseCallRate"] = own["caseN"] / cases
    own["ctrlCallRate"] = null("double") if linear else own["ctrlN"] / controls
    own["caseMAF"] = of_cases if allelic else null("double")
    own["ctrlMAF"] = G.frequency_of(lambda s, g: F.col(f"k{s}{g}") - F.col(f"c{s}{g}")) if allelic and not linear else null("double")
    if {"REF", "ALT"} <= set(geno.variants.columns):
        own["effectAllele"], own["otherAllele"] = F.when(F.col("flipped"), F.col("REF")).otherwise(F.col("ALT")), F.when(F.col("flipped"), F.col("ALT")).otherwise(F.col("REF"))
    else:
        own["effectAllele"] = own["otherAllele"] = null("string")
    df = G.barrier(df.withColumns(own))
    df = _tested(df, model, F.col("caseMAC") + F.coalesce("ctrlMAC", F.lit(0)) >= 2)
    named = {"cohort": cohort, "varSetName": var_set, "name": name, "pheno": model.pheno, "covar": ",".join(model.covar), "geneticModel": genetic_model, "test": "lm" if linear else "score"}
    return df.withColumns({c: F.lit(v) for c, v in named.items()}).select(*SINGLE_COLUMNS, "U", "D")


def _score_sums(per: DataFrame, dev: DataFrame, key: str, model: NullModel) -> DataFrame:
    """``per`` (key, b0, b1, b2) with the sums of what (key, IID, dev) adds, and ``positive``: samples of a score above 0."""
    k = len(model.terms)
    own = model.samples.select("IID", "sex", "y", "r", "v", *(F.col("x")[j].alias(f"x{j}") for j in range(1, k)))
    rows = dev.select(key, "IID", "dev").join(own, "IID").join(per.select(key, "b0", "b1", "b2"), key)
    rows = rows.withColumn("b", _at("b", F.col("sex")))
    products = {"du": F.col("r"), "dh0": F.col("v"), "dy": F.col("y")} | {f"dh{j}": F.col("v") * F.col(f"x{j}") for j in range(1, k)}
    sums = rows.groupBy(key).agg(
        *(F.sum(F.col("dev") * c).alias(n) for n, c in products.items()),
        F.sum((2 * F.col("b") + F.col("dev")) * F.col("dev") * F.col("v")).alias("da"),
        F.sum("dev").alias("dsum"),
        *(F.count_if(F.col("sex") == s).alias(f"held{s}") for s in G.SEXES),
        F.count_if(F.col("b") + F.col("dev") > 1e-9).alias("held"),
    )
    out = per.join(sums, key, "left").na.fill(0, ["du", "da", "dy", "dsum", "held", *(f"dh{j}" for j in range(k)), *(f"held{s}" for s in G.SEXES)])
    rest = sum((F.when(F.col(f"b{s}") > 1e-9, F.lit(model.totals[s]["n"]) - F.col(f"held{s}")).otherwise(0) for s in G.SEXES[1:]), F.when(F.col("b0") > 1e-9, F.lit(model.totals[0]["n"]) - F.col("held0")).otherwise(0))
    return G.barrier(out.withColumn("positive", F.col("held") + rest))


def _burden_result(per: DataFrame, dev: DataFrame, key: str, model: NullModel, subtract: int | None = None) -> DataFrame:
    df = _statistics(_score_sums(per, dev, key, model), model)
    linear = model.kind == "linear"
    cases = model.n if linear else sum(int(t["cases"]) for t in model.totals.values())
    able = (F.col("positive") >= 2) & F.lit(linear or min(cases, model.n - cases) >= 2)
    of_all = sum((F.col(f"b{s}") * model.totals[s]["n"] for s in G.SEXES[1:]), F.col("b0") * model.totals[0]["n"]) + F.col("dsum")
    of_cases = of_all if linear else _by_sex(model, "b", "cases") + F.col("dy")
    df = df.withColumns({"meanCaseScore": of_cases / max(cases, 1), "meanCtrlScore": F.lit(None).cast("double") if linear else (of_all - of_cases) / max(model.n - cases, 1), "caseN": F.lit(cases), "ctrlN": F.lit(0 if linear else model.n - cases)})
    return _tested(df, model, able, subtract).withColumns({"pheno": F.lit(model.pheno), "covar": F.lit(",".join(model.covar)), "test": F.lit("lm" if linear else "score")})


def score_units(geno: G.Geno, members: DataFrame, model: NullModel, genetic_model: str = "allelic", impute: str = "meanImpute", maf_weights: str = "none", **bounds) -> DataFrame:
    """unit, pheno, covar, test, nvar, caseN, ctrlN, mean scores, effect, effectSE, CI, OR, P, U and D of the burden scores of units (unit, VAR_id, w)."""
    ids = model.samples.select("IID")
    own = G.Geno(geno.variants, geno.samples.join(ids, "IID", "left_semi"), geno.stored.join(ids, "IID", "left_semi"))
    per, dev = G.burden(own, members, genetic_model, impute, maf_weights, **bounds)
    return _burden_result(per, dev, "unit", model).select("unit", "pheno", "covar", "test", "nvar", "caseN", "ctrlN", "meanCaseScore", "meanCtrlScore", "effect", "effectSE", "effectCIlower", "effectCIupper", "OR", "P", "U", "D")


def score_gene_sets(per: DataFrame, dev: DataFrame, gene_sets: DataFrame, model: NullModel, subtract: str | None = None, drop_units: DataFrame | None = None) -> DataFrame:
    """Burden tests of gene sets from the sparse scores of units: per unit its baselines, and (unit, IID, dev).

    ``subtract``: a covariate of the model that holds the scores of more units; each set's own score is taken off it. A set none of whose units has scores has no row.
    """
    sets = gene_sets.select("geneSetName", "unit").distinct()
    if drop_units is not None:
        sets = sets.join(drop_units.select("unit").distinct(), "unit", "left_anti")
    if subtract is not None and term_name(subtract) not in model.terms:
        raise ValueError(f"{subtract} is no covariate of the null model")
    sizes = sets.groupBy("geneSetName").agg(F.count("*").cast("int").alias("geneSetSize"))
    base = sets.join(per.select("unit", "b0", "b1", "b2"), "unit").groupBy("geneSetName").agg(*(F.sum(f"b{s}").alias(f"b{s}") for s in G.SEXES), F.count("*").cast("int").alias("genesObs"))
    added = sets.join(dev.select("unit", "IID", "dev"), "unit").groupBy("geneSetName", "IID").agg(F.sum("dev").alias("dev"))
    at = model.terms.index(term_name(subtract)) if subtract is not None else None
    out = _burden_result(base, added, "geneSetName", model, at).join(sizes, "geneSetName")
    return out.select("geneSetName", "pheno", "covar", "test", "geneSetSize", "genesObs", "caseN", "ctrlN", "meanCaseScore", "meanCtrlScore", "effect", "effectSE", "effectCIlower", "effectCIupper", "OR", "P", "U", "D")


def score_grid(geno: G.Geno, tasks: list[tuple[str, list[str], str]], genetic_models: list[str] = ("allelic",), **options) -> DataFrame:
    """``score_variants`` of every task (phenotype, covariates, kind) and genetic model, with one pass over the genotypes for all of them.

    The sums, at most twelve rows for each variant, are kept in the executors' memory and disk while the results are made of them.
    """
    models = [fit_null(geno.samples, pheno, list(covar), kind) for pheno, covar, kind in tasks]
    sums = cell_sums(geno, models).persist(StorageLevel.MEMORY_AND_DISK)
    return union([score_variants(geno, m, g, sums=sums, task=t, **options) for t, m in enumerate(models) for g in genetic_models])
