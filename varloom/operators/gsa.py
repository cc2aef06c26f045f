"""Gene-set analysis over unit statistics: competitive and self-contained tests, conditional analysis, score enrichment, correlation blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from varloom.functions.dist import t_quantile_sf
from varloom.functions.expr import norm_tail_sql, qnorm_sql
from varloom.functions.tails import hypergeometric_upper, with_t


def prepare(stats: DataFrame, covar: list[str] = (), int_ranks: bool = False, cutoffs: tuple[float, float] | None = None) -> DataFrame:
    """Unit statistics with Z. Rows without P or a covariate go; infinite Z take the largest finite ones, or cutoffs hold for all."""
    if stats.groupBy("unit").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate units")
    some = stats.dropna(subset=["P", *covar])
    if int_ranks:
        # average ranks: places come from a distributed numbering, ties share their mean
        from .store import number_rows

        n = some.agg(F.count("*").alias("n"))
        place = number_rows(some.select((-F.col("P")).alias("neg"), "unit"), ["neg", "unit"], "i")
        mean = place.groupBy("neg").agg(F.avg("i").alias("rank"))
        place = place.join(mean, "neg").select("unit", "rank")
        some = some.join(place, "unit").crossJoin(F.broadcast(n)).withColumn("u", (F.col("rank") - 0.5) / F.col("n"))
        return some.withColumn("Z", F.expr(qnorm_sql("u"))).drop("rank", "n", "u")
    some = some.withColumn("Z", F.expr(qnorm_sql("1 - P")))
    if cutoffs:
        return some.withColumn("Z", F.least(F.greatest("Z", F.lit(cutoffs[0])), F.lit(cutoffs[1])))
    finite = F.when(F.abs("Z") != float("inf"), F.col("Z"))
    ends = some.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    return some.crossJoin(F.broadcast(ends)).withColumn("Z", F.when(F.col("Z") == float("inf"), F.col("hi")).when(F.col("Z") == -float("inf"), F.col("lo")).otherwise(F.col("Z"))).drop("lo", "hi")


def observed(stats: DataFrame, gene_sets: DataFrame, min_size: int = 1, max_size: float = float("inf")) -> DataFrame:
    """(geneSetName, unit, geneSetSize, genesObs) of the units with statistics, in sets whose observed size is within bounds."""
    sizes = gene_sets.groupBy("geneSetName").agg(F.count_distinct("unit").alias("geneSetSize"))
    got = gene_sets.select("geneSetName", "unit").distinct().join(stats.select("unit"), "unit")
    n = got.groupBy("geneSetName").agg(F.count("*").alias("genesObs")).where((F.col("genesObs") >= min_size) & (F.col("genesObs") <= max_size))
    return got.join(n, "geneSetName").join(sizes, "geneSetName")


def _totals(stats: DataFrame, covar: list[str]) -> tuple[list[str], dict[str, float], int]:
    """Sums of products of [1, covariates, Z] over all units; few numbers."""
    names = ["1", *covar, "Z"]
    col = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    got = stats.agg(*(F.sum(col(a) * col(b)).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:])).first().asDict()
    return names, got | {f"{b}|{a}": got[f"{a}|{b}"] for i, a in enumerate(names) for b in names[i:]}, int(got["1|1"])


def competitive_lm(stats: DataFrame, sets: DataFrame, covar: list[str] = (), one_sided: bool = True) -> DataFrame:
    """Competitive regression of Z on membership, both without what 1 and the covariates explain.

    The residual variance is divided by n - k - 2 and t has n - k - 1 degrees of freedom, k being the columns of [1, covariates].
    """
    import numpy as np

    names, got, n = _totals(stats, list(covar))
    x = names[:-1]
    k = len(x)
    xx = np.array([[got[f"{a}|{b}"] for b in x] for a in x])
    inv, xz = np.linalg.pinv(xx), np.array([got[f"{a}|Z"] for a in x])
    syy = got["Z|Z"] - xz @ inv @ xz
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    per = sets.join(stats.select("unit", "Z", *covar), "unit").groupBy("geneSetName").agg(F.max("geneSetSize").alias("geneSetSize"), F.max("genesObs").alias("genesObs"), F.sum("Z").alias("sz"), *(F.sum(col(c)).alias(f"s{i}") for i, c in enumerate(x)))
    dot = lambda v: sum((F.col(f"s{i}") * float(e) for i, e in enumerate(v)), F.lit(0.0))
    fitted = sum((F.col(f"s{i}") * F.col(f"s{j}") * float(inv[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    per = per.withColumn("ss", F.col("genesObs") - fitted).withColumn("sy", F.col("sz") - dot(inv @ xz)).where("ss > 1e-9")
    per = per.withColumn("effect", F.col("sy") / F.col("ss"))
    per = per.withColumn("effectSE", F.sqrt((F.lit(float(syy)) - F.col("effect") * F.col("effect") * F.col("ss")) / (n - k - 2) / F.col("ss")))
    return _intervals(per, n - k - 1, one_sided).select("geneSetName", "geneSetSize", "genesObs", "effect", "effectSE", "effectCIlower", "effectCIupper", "P")


def _intervals(per: DataFrame, freedom: int, one_sided: bool = True) -> DataFrame:
    """``per`` (effect, effectSE) with P and the interval of a t of so many degrees of freedom; one-sided tests look for larger effects, to infinity."""
    freedom = max(freedom, 1)
    half = float(t_quantile_sf(0.05 if one_sided else 0.025, freedom)) * F.col("effectSE")
    out = with_t(per, "effect", "effectSE", F.lit(freedom), one_sided)
    return out.withColumns({"effectCIlower": F.col("effect") - half, "effectCIupper": F.lit(float("inf")) if one_sided else F.col("effect") + half})


def z_test(stats: DataFrame, sets: DataFrame) -> DataFrame:
    """Self-contained: mean Z times the root of the set's size; upper tail."""
    per = sets.join(stats.select("unit", "Z"), "unit").groupBy("geneSetName").agg(F.avg("Z").alias("effect"), F.count("*").alias("genesObs"))
    per = per.withColumn("effectSE", 1 / F.sqrt("genesObs")).withColumn("z", F.col("effect") / F.col("effectSE"))
    return per.select("geneSetName", "genesObs", "effect", "effectSE", F.expr(norm_tail_sql("z")).alias("P"))


def t_test(stats: DataFrame, sets: DataFrame) -> DataFrame:
    """Self-contained: mean Z over its standard error; upper tail. Sets of one unit have none."""
    per = sets.join(stats.select("unit", "Z"), "unit").groupBy("geneSetName").agg(F.avg("Z").alias("effect"), F.stddev_samp("Z").alias("sd"), F.count("*").alias("genesObs")).where("genesObs > 1")
    per = per.withColumn("effectSE", F.col("sd") / F.sqrt("genesObs"))
    return with_t(per, "effect", "effectSE", F.col("genesObs") - 1, upper=True).select("geneSetName", "genesObs", "effect", "effectSE", "P")


def fisher_counts(stats: DataFrame, sets: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """2 x 2 counts of significant units and members, for each set and threshold (default 0.05 / number of units)."""
    spark = stats.sparkSession
    total = stats.agg(F.count("*").alias("n")).first().n
    levels = thresholds or [0.05 / total]
    sig = stats.agg(*(F.count_if(F.col("P") < t).alias(f"t{i}") for i, t in enumerate(levels))).first()
    t = spark.createDataFrame([(float(x), int(sig[f"t{i}"])) for i, x in enumerate(levels)], "threshold double, sig int")
    per = sets.join(stats.select("unit", "P"), "unit").crossJoin(F.broadcast(t))  # a few thresholds
    per = per.groupBy("geneSetName", "threshold", "sig").agg(F.count_if(F.col("P") < F.col("threshold")).alias("sig_in"), F.count("*").alias("m"))
    return per.select("geneSetName", "threshold", "sig_in", (F.col("sig") - F.col("sig_in")).alias("sig_out"), (F.col("m") - F.col("sig_in")).alias("rest_in"), (total - F.col("sig") - F.col("m") + F.col("sig_in")).alias("rest_out"))


def fisher(stats: DataFrame, sets: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Conditional odds ratio and upper-tail P of the counts."""
    from varloom.functions.dist import fisher_udf

    got = fisher_counts(stats, sets, thresholds)
    return got.withColumn("f", fisher_udf("sig_in", "sig_out", "rest_in", "rest_out")).select("geneSetName", "threshold", (F.col("sig_in") + F.col("rest_in")).alias("genesObs"), F.col("f.odds").alias("effect"), F.col("f.p").alias("P"))


def fisher_p(counts: DataFrame) -> DataFrame:
    """``fisher_counts`` with the upper-tail P of the table, without Python workers."""
    c = {k: F.col(k).cast("long") for k in ("sig_in", "sig_out", "rest_in", "rest_out")}
    n = c["sig_in"] + c["sig_out"] + c["rest_in"] + c["rest_out"]
    return counts.withColumn("P", hypergeometric_upper(c["sig_in"], c["sig_in"] + c["rest_in"], c["sig_in"] + c["sig_out"], n))


def conditional(stats: DataFrame, sets: DataFrame, condition: DataFrame, one_sided: bool = True) -> DataFrame:
    """Effect of each set given each condition set, by ordinary least squares of Z on [1, condition, set], with P and interval; pairs of equal membership are skipped."""
    names, got, n = _totals(stats, [])
    z = stats.select("unit", "Z")
    own = sets.select("geneSetName", "unit").join(z, "unit")
    a = own.groupBy("geneSetName").agg(F.count("*").alias("m"), F.sum("Z").alias("sz"))
    c = condition.select(F.col("geneSetName").alias("condition"), "unit").distinct().join(z, "unit")
    b = c.groupBy("condition").agg(F.count("*").alias("mc"), F.sum("Z").alias("szc"))
    both = own.select("geneSetName", "unit").join(c.select("condition", "unit"), "unit").groupBy("geneSetName", "condition").agg(F.count("*").alias("mb"))
    pairs = a.crossJoin(b).join(both, ["geneSetName", "condition"], "left").withColumn("mb", F.coalesce("mb", F.lit(0)))  # sets times conditions is the result's size
    s, zz = got["1|Z"], got["Z|Z"]
    m, mc, mb = (F.col(x).cast("double") for x in ("m", "mc", "mb"))
    cc = mc - mc * mc / n
    sc, sy, cy = mb - m * mc / n, F.col("sz") - m * (s / n), F.col("szc") - mc * (s / n)
    ss = m - m * m / n - sc * sc / cc
    y = sy - sc * cy / cc
    syy = F.lit(zz - s * s / n) - cy * cy / cc
    out = pairs.where("mc < " + str(n) + " and mc > 0").withColumn("ss", ss).where("ss > 1e-9").withColumn("effect", y / F.col("ss"))
    out = out.withColumn("effectSE", F.sqrt((syy - F.col("effect") * F.col("effect") * F.col("ss")) / (n - 4) / F.col("ss")))
    return _intervals(out, n - 3, one_sided).select("geneSetName", "condition", F.col("m").alias("genesObs"), "effect", "effectSE", "effectCIlower", "effectCIupper", "P")


def score_lm(stats: DataFrame, scores: DataFrame, limit: float | None = 3.0, one_sided: bool = True) -> DataFrame:
    """Regression of Z on each column of a long score table (unit, column, score), winsorised to ``limit`` deviations from its mean, with P."""
    got = scores.join(stats.select("unit", "Z"), "unit")
    if limit:
        ends = got.groupBy("column").agg(F.avg("score").alias("mu"), F.stddev_samp("score").alias("sd"))
        got = got.join(ends, "column").withColumn("score", F.least(F.greatest(F.col("score"), F.col("mu") - limit * F.col("sd")), F.col("mu") + limit * F.col("sd")))
    s = got.groupBy("column").agg(F.count("*").alias("n"), F.sum("score").alias("sx"), F.sum("Z").alias("sz"), F.sum(F.col("score") * F.col("score")).alias("xx"), F.sum(F.col("score") * F.col("Z")).alias("xz"), F.sum(F.col("Z") * F.col("Z")).alias("zz"))
    n = F.col("n")
    ss, sy, yy = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("xz") - F.col("sx") * F.col("sz") / n, F.col("zz") - F.col("sz") * F.col("sz") / n
    s = s.withColumn("ss", ss).where("ss > 0").withColumn("effect", sy / F.col("ss"))
    s = s.withColumn("effectSE", F.when(n > 3, F.sqrt((yy - F.col("effect") * F.col("effect") * F.col("ss")) / (n - 3) / F.col("ss"))))
    return with_t(s, "effect", "effectSE", F.greatest(n - 2, F.lit(1)), one_sided).select("column", "n", "effect", "effectSE", "P")


def block_correlations(scores: DataFrame, blocks: DataFrame, n_samples: int, absolute: bool = True, min_r2: float = 1e-4) -> DataFrame:
    """Pearson correlation of the scores of units in the same block: (block, unit_a, unit_b, r) with unit_a < unit_b.

    ``scores`` holds (unit, IID, score) without zeros; sums of products come from one join on the samples that two units of
    a block share. Correlations that don't exist or of r below the root of ``min_r2`` are 0.
    """
    s = scores.join(blocks.select("unit", "block"), "unit").where("score <> 0")
    one = s.groupBy("block", "unit").agg(F.sum("score").alias("sx"), F.sum(F.col("score") * F.col("score")).alias("xx"))
    one = blocks.select("block", "unit").join(one, ["block", "unit"], "left").fillna(0.0)
    x, y = s.select("block", "IID", F.col("unit").alias("unit_a"), F.col("score").alias("sa")), s.select("block", "IID", F.col("unit").alias("unit_b"), F.col("score").alias("sb"))
    xy = x.join(y, ["block", "IID"]).where("unit_a < unit_b").groupBy("block", "unit_a", "unit_b").agg(F.sum(F.col("sa") * F.col("sb")).alias("xy"))
    a, b = (one.select("block", F.col("unit").alias(f"unit_{k}"), F.col("sx").alias(f"s{k}"), F.col("xx").alias(f"q{k}")) for k in "ab")
    pairs = a.join(b, "block").where("unit_a < unit_b").join(xy, ["block", "unit_a", "unit_b"], "left")
    n = float(n_samples)
    top = F.coalesce("xy", F.lit(0.0)) - F.col("sa") * F.col("sb") / n
    bottom = (F.col("qa") - F.col("sa") * F.col("sa") / n) * (F.col("qb") - F.col("sb") * F.col("sb") / n)
    r: Column = F.when(bottom > 1e-12, top / F.sqrt(bottom)).otherwise(0.0)
    r = F.abs(r) if absolute else r
    pairs = pairs.withColumn("r", r)
    return pairs.select("block", "unit_a", "unit_b", F.when(F.abs("r") < min_r2**0.5, 0.0).otherwise(F.col("r")).alias("r"))


def near_pd(r):
    """The nearest correlation matrix (alternating projections of Higham, 2002). numpy in, numpy out: one block at a time."""
    import numpy as np

    y, shift = r.copy(), np.zeros_like(r)
    for _ in range(100):
        x = y - shift
        value, vector = np.linalg.eigh(x)
        psd = (vector * np.maximum(value, 1e-8)) @ vector.T
        shift = psd - x
        last, y = y, psd.copy()
        np.fill_diagonal(y, 1.0)
        if np.abs(y - last).max() < 1e-8:
            break
    return y


def add_z(stats: DataFrame) -> DataFrame:
    return stats.withColumn("Z", F.expr(qnorm_sql("1 - P")))


