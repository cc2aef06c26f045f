"""Queries on null models and on the tests made of their sums. The oracles fit the same models and test dense tables of all cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions.tails import Z975, erfc_sql, hill_sql, norm_two_sided_sql, t_quantile_sql
from varloom.operators import geno as G
from varloom.operators import score as S
from varloom.operators import shared
from varloom.operators import wald as W

from . import projection as P
from .geno_queries import BURDEN_SQL, NUDGE, members
from .set_queries import GENE_SQL, gene_sets

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def places(df, digits: int, *names):
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def newton_sql(source: str, steps: int = 8) -> str:
    """Coefficients b0 and b1 of a logistic model of y on x (columns of ``source``, with an offset o) as CTEs; the last is ``beta``."""
    out = ", beta0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)\n"
    for k in range(steps):
        out += f""", beta{k + 1} AS MATERIALIZED (SELECT b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM
  (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(m * (1 - m)) AS h00, sum(m * (1 - m) * x) AS h01, sum(m * (1 - m) * x * x) AS h11, sum(y - m) AS g0, sum((y - m) * x) AS g1
   FROM (SELECT *, 1 / (1 + exp(-(o + b0 + b1 * x))) AS m FROM {source}, beta{k})))\n"""
    return out + f", beta AS (SELECT * FROM beta{steps})\n"


LOGISTIC = ', src AS (SELECT IID, sex, pheno::DOUBLE AS y, "PC1" AS x, {o} AS o FROM samples)\n'
OFFSET = "(sex / 10.0::DOUBLE)"


@query(
    P.sql("rare", dense=False)
    + LOGISTIC.format(o=OFFSET)
    + newton_sql("src")
    + """, i AS (SELECT sum(m * (1 - m)) AS h00, sum(m * (1 - m) * x) AS h01, sum(m * (1 - m) * x * x) AS h11 FROM (SELECT *, 1 / (1 + exp(-(o + b0 + b1 * x))) AS m FROM src, beta))
SELECT '(Intercept)' AS term, round(b0, 8) + 0.0 AS estimate, round(sqrt(h11 / (h00 * h11 - h01 * h01)), 8) + 0.0 AS "SE" FROM beta, i UNION ALL SELECT 'PC1', round(b1, 8) + 0.0, round(sqrt(h00 / (h00 * h11 - h01 * h01)), 8) + 0.0 FROM beta, i"""
)
def null_model_logistic(spark, sf_dir):
    s = P.samples(spark, sf_dir, "rare").withColumn("o", F.col("sex") / 10.0)
    return places(S.fit_null(s, "pheno", ["PC1"], "logistic", offset="o").table(spark), 8, "estimate", "SE")


@query(
    P.sql("rare", dense=False)
    + """, src AS (SELECT qpheno - 50 * sex AS y, "PC1" AS x FROM samples), f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM src)
SELECT '(Intercept)' AS term, round(a, 5) + 0.0 AS estimate, round(sqrt((syy - b * b * sxx) / (n - 2) * (1.0::DOUBLE / n + mx * mx / sxx)), 5) + 0.0 AS "SE" FROM f UNION ALL SELECT 'PC1', round(b, 5) + 0.0, round(sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) + 0.0 FROM f"""
)
def null_model_linear(spark, sf_dir):
    s = P.samples(spark, sf_dir, "rare").withColumn("o", F.col("sex") * 50.0)
    return places(S.fit_null(s, "qpheno", ["PC1"], offset="o").table(spark), 5, "estimate", "SE")


#: Residual r and variance weight v of every sample.
LOGISTIC_FIT = P.sql("rare") + LOGISTIC.format(o="0.0::DOUBLE") + newton_sql("src") + ", fit AS (SELECT IID, y, x, y - m AS r, m * (1 - m) AS v FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM src, beta))\n"
LINEAR_FIT = P.sql("rare") + ', src AS (SELECT IID, qpheno AS y, "PC1" AS x FROM samples), fit AS (SELECT IID, y, x, y - a - b * x AS r, 1.0::DOUBLE AS v FROM src, (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM src))\n'


def score_sql(model: str = "g") -> str:
    """U and D of every variant of dense flipped cells, genotypes of a model and means for missing ones."""
    return f""", mc AS (SELECT c.VAR_id, ploidy, flipped, sex, {model} AS m, g, y, x, r, v FROM fcells c JOIN fit USING (IID)),
gi AS (SELECT *, coalesce(m, avg(m) OVER (PARTITION BY VAR_id)) AS d FROM mc),
inv AS (SELECT h11 / (h00 * h11 - h01 * h01) AS i00, -h01 / (h00 * h11 - h01 * h01) AS i01, h00 / (h00 * h11 - h01 * h01) AS i11 FROM (SELECT sum(v) AS h00, sum(v * x) AS h01, sum(v * x * x) AS h11 FROM fit)),
su AS (SELECT VAR_id, any_value(ploidy) AS ploidy, any_value(flipped) AS flipped, sum(d * r) AS u, sum(d * d * v) AS a, sum(d * v) AS h0, sum(d * v * x) AS h1, coalesce(sum(m), 0)::BIGINT AS mac, count(m) AS n FROM gi GROUP BY VAR_id),
st AS (SELECT *, a - (i00 * h0 * h0 + 2 * i01 * h0 * h1 + i11 * h1 * h1) AS d FROM su, inv)
"""


FREQUENCY = "CASE any_value(ploidy) WHEN 'diploid' THEN avg(g) FILTER ({c}) / 2 WHEN 'XnonPAR' THEN (coalesce(sum(g) FILTER (sex = 1 AND {c}), 0) + coalesce(sum(g) FILTER (sex = 2 AND {c}), 0)) / nullif(count(g) FILTER (sex = 1 AND {c}) + 2 * count(g) FILTER (sex = 2 AND {c}), 0) ELSE avg(g) FILTER (sex = 1 AND {c}) END"


@query(
    LOGISTIC_FIT
    + score_sql()
    + f""", ca AS (SELECT VAR_id, coalesce(sum(g) FILTER (y = 1), 0)::BIGINT AS "caseMAC", coalesce(sum(g) FILTER (y = 0), 0)::BIGINT AS "ctrlMAC", count(g) FILTER (y = 1) AS "caseN", count(g) FILTER (y = 0) AS "ctrlN", {FREQUENCY.format(c='y = 1')} AS "caseMAF", {FREQUENCY.format(c='y = 0')} AS "ctrlMAF",
 count(*) FILTER (y = 1) AS cases, count(*) FILTER (y = 0) AS controls FROM gi GROUP BY VAR_id),
t AS (SELECT *, CASE WHEN mac >= 2 AND d > 1e-9 * a THEN u / sqrt(d) END AS z FROM st JOIN ca USING (VAR_id))
SELECT VAR_id, "caseMAC", "ctrlMAC", round("caseMAF", 6) + 0.0 AS "caseMAF", round("ctrlMAF", 6) + 0.0 AS "ctrlMAF", "caseN", "ctrlN", round("caseN" / cases, 6) + 0.0 AS "caseCallRate", round("ctrlN" / controls, 6) + 0.0 AS "ctrlCallRate",
CASE WHEN flipped THEN "REF" ELSE "ALT" END AS "effectAllele", CASE WHEN flipped THEN "ALT" ELSE "REF" END AS "otherAllele", round(u, 6) + 0.0 AS "U", round(d, 6) + 0.0 AS "D", round({norm_two_sided_sql('z')}, 7) + 0.0 AS "P" FROM t JOIN var USING (VAR_id)"""
)
def sv_scores(spark, sf_dir):
    g = P.geno(spark, sf_dir, "rare")
    df = S.score_variants(g, S.fit_null(g.samples, "pheno", ["PC1"], "logistic"))
    df = df.select("VAR_id", "caseMAC", "ctrlMAC", "caseMAF", "ctrlMAF", "caseN", "ctrlN", "caseCallRate", "ctrlCallRate", "effectAllele", "otherAllele", "U", "D", "P")
    return places(places(df, 6, "caseMAF", "ctrlMAF", "caseCallRate", "ctrlCallRate", "U", "D"), 7, "P")


@query(
    LOGISTIC_FIT
    + score_sql("CASE WHEN g > 0 THEN 1 WHEN g = 0 THEN 0 END")
    + f""", t AS (SELECT *, CASE WHEN mac >= 2 AND d > 1e-9 * a THEN u / sqrt(d) END AS z FROM st) SELECT VAR_id, mac AS "MAC", n AS "N", round(u, 6) + 0.0 AS "U", round(d, 6) + 0.0 AS "D", round({norm_two_sided_sql('z')}, 7) + 0.0 AS "P" FROM t"""
)
def sv_scores_dominant(spark, sf_dir):
    g = P.geno(spark, sf_dir, "rare")
    df = S.score_variants(g, S.fit_null(g.samples, "pheno", ["PC1"], "logistic"), "dominant")
    df = df.select("VAR_id", (F.col("caseMAC") + F.col("ctrlMAC")).alias("MAC"), (F.col("caseN") + F.col("ctrlN")).alias("N"), "U", "D", "P")
    return places(places(df, 6, "U", "D"), 7, "P")


@query(
    LINEAR_FIT
    + score_sql()
    + f""", w AS (SELECT sum(r * r) AS rss, count(*) - 3 AS df FROM fit), e AS (SELECT VAR_id, mac, n, CASE WHEN mac >= 2 AND d > 1e-9 * a THEN u / d END AS effect, sqrt((rss - u * u / d) / df / d) AS se, df FROM st, w),
t0 AS (SELECT *, effect / se AS t FROM e), t AS (SELECT *, {hill_sql('t', 'df')} AS h FROM t0)
SELECT VAR_id, mac AS "caseMAC", n AS "caseN", round(effect, 4) + 0.0 AS effect, round(CASE WHEN effect IS NOT NULL THEN se END, 4) + 0.0 AS "effectSE", round(effect - {t_quantile_sql('df')} * se, 4) + 0.0 AS "effectCIlower", round(effect + {t_quantile_sql('df')} * se, 4) + 0.0 AS "effectCIupper", round({erfc_sql('h')}, 7) + 0.0 AS "P" FROM t"""
)
def sv_lm(spark, sf_dir):
    g = P.geno(spark, sf_dir, "rare")
    df = S.score_variants(g, S.fit_null(g.samples, "qpheno", ["PC1"]))
    return places(places(df.select("VAR_id", "caseMAC", "caseN", "effect", "effectSE", "effectCIlower", "effectCIupper", "P"), 4, "effect", "effectSE", "effectCIlower", "effectCIupper"), 7, "P")


FULL = ("effect", "effectSE", "effectCIlower", "effectCIupper")


def lm_sql(key: str, source: str, cut: int = 3) -> str:
    """SQL of the regression of q on s in ``source`` (key, q, s), with P and the interval."""
    return f""", lm0 AS (SELECT {key}, count(*) - 2 AS df, regr_slope(q, s) AS effect, sqrt((regr_syy(q, s) - regr_slope(q, s) * regr_sxy(q, s)) / (count(*) - 2) / regr_sxx(q, s)) AS se FROM {source} GROUP BY 1),
lmt AS (SELECT *, effect / se AS t FROM lm0){result_sql(key, cut)}"""


def result_sql(key: str, cut: int) -> str:
    """The result of ``lmt`` (effect, se, t, df)."""
    return f""", lm AS (SELECT *, {hill_sql('t', 'df')} AS h FROM lmt)
SELECT {key}, round(effect, {cut}) + 0.0 AS effect, round(se, {cut}) + 0.0 AS "effectSE", round(effect - {t_quantile_sql('df')} * se, {cut}) + 0.0 AS "effectCIlower", round(effect + {t_quantile_sql('df')} * se, {cut}) + 0.0 AS "effectCIupper", round({erfc_sql('h')}, 7) + 0.0 AS "P" FROM lm"""


@query(P.sql() + BURDEN_SQL + ", qs AS (SELECT unit, qpheno AS q, score AS s FROM sc)" + lm_sql("unit", "qs"))
def lm_burden(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    df = S.score_units(g, members(spark, sf_dir), S.fit_null(g.samples, "qpheno"))
    return places(places(df.select("unit", *FULL, "P"), 3, *FULL), 7, "P")


#: The same with a covariate x: both sides less what x explains.
PARTIAL = """, rg AS (SELECT {k}, regr_slope(s, x) AS bs, regr_intercept(s, x) AS js, regr_slope(q, x) AS bq, regr_intercept(q, x) AS jq FROM qs GROUP BY 1),
rr AS (SELECT {k}, s - js - bs * x AS s, q - jq - bq * x AS q FROM qs JOIN rg USING ({k})),
lm0 AS (SELECT {k}, count(*) - 3 AS df, sum(s * q) / sum(s * s) AS effect, sqrt((sum(q * q) - sum(s * q) * sum(s * q) / sum(s * s)) / (count(*) - 3) / sum(s * s)) AS se FROM rr GROUP BY 1), lmt AS (SELECT *, effect / se AS t FROM lm0)
"""


def partial_sql(key: str, cut: int) -> str:
    return PARTIAL.format(k=key) + result_sql(key, cut)


@query(P.sql() + BURDEN_SQL + ', qs AS (SELECT unit, sc.qpheno AS q, score AS s, "PC1" AS x FROM sc JOIN samples USING (IID))' + partial_sql("unit", 3))
def lm_burden_covar(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    df = S.score_units(g, members(spark, sf_dir), S.fit_null(g.samples, "qpheno", ["PC1"]))
    return places(places(df.select("unit", *FULL, "P"), 3, *FULL), 7, "P")


SETS_SQL = P.sql() + BURDEN_SQL + ", " + GENE_SQL + ', tot AS (SELECT IID, sum(score) AS t FROM sc GROUP BY 1), agg AS (SELECT "geneSetName", IID, any_value(qpheno) AS q, sum(score) AS s FROM gs JOIN sc USING (unit) GROUP BY 1, 2)\n'


def sparse_scores(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    return g, *G.burden(g, members(spark, sf_dir))


@query(SETS_SQL + lm_sql('"geneSetName"', "agg", cut=4))
def gene_set_burden_lm(spark, sf_dir):
    g, per, dev = sparse_scores(spark, sf_dir)
    df = S.score_gene_sets(per, dev, gene_sets(spark, sf_dir), S.fit_null(g.samples, "qpheno"))
    return places(places(df.select("geneSetName", *FULL, "P"), 4, *FULL), 7, "P")


@query(SETS_SQL + ', qs AS (SELECT "geneSetName", q, s, t - s AS x FROM agg JOIN tot USING (IID))' + partial_sql('"geneSetName"', 4))
def gene_set_burden_subtract(spark, sf_dir):
    """With the scores of all other units as a covariate: all units' less the set's own."""
    g = P.geno(spark, sf_dir)
    with shared.staged(g) as cells:
        per, dev = shared.burden(cells, members(spark, sf_dir))
    base = per.agg(*(F.sum(f"b{s}").alias(f"b{s}") for s in G.SEXES))  # one row
    own = g.samples.join(dev.groupBy("IID").agg(F.sum("dev").alias("d")), "IID", "left").crossJoin(base)
    at = F.when(F.col("sex") == 1, F.col("b1")).when(F.col("sex") == 2, F.col("b2")).otherwise(F.col("b0"))
    model = S.fit_null(own.withColumn("load", at + F.coalesce("d", F.lit(0.0))), "qpheno", ["load"])
    df = S.score_gene_sets(per, dev, gene_sets(spark, sf_dir), model, subtract="load")
    return places(places(df.select("geneSetName", *FULL, "P"), 4, *FULL), 7, "P")


def stores(spark, sf_dir):
    """Two aggregate stores, of the units before and after U50."""
    from varloom.operators.aggstore import AggStore

    g, m = P.geno(spark, sf_dir), members(spark, sf_dir)
    low = F.substring("unit", 2, 9).cast("int") < 50
    with shared.staged(g) as cells:
        return [AggStore.create(cells, m.where(part), {"id": "study", "genomeBuild": "synthetic"}, impute="meanImpute") for part in (low, ~low)]


@query(P.sql() + BURDEN_SQL + "SELECT unit, IID, round(score + 1.3e-8, 6) + 0.0 AS score FROM sc WHERE unit IN ('U7', 'U48', 'U63')")
def get_unit(spark, sf_dir):
    from varloom.operators import aggstore

    return aggstore.merge(stores(spark, sf_dir)).get_unit(["U7", "U48", "U63"], digits=None).withColumn("score", F.round(F.col("score") + NUDGE, 6) + F.lit(0.0))


@query(P.sql() + BURDEN_SQL + "SELECT IID, round(sum(score) + 1.3e-8, 5) + 0.0 AS aggregate FROM sc GROUP BY IID")
def collapse_stores(spark, sf_dir):
    from varloom.operators import aggstore

    return aggstore.collapse(stores(spark, sf_dir)).withColumn("aggregate", F.round(F.col("aggregate") + NUDGE, 5) + F.lit(0.0))


def shifts(samples, times: int):
    """Permutations that move all samples on by 7 k + 1 places."""
    from varloom.operators.store import number_rows

    n = samples.count()
    at = number_rows(samples.select("IID"), ["IID"], "position").select("position", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("perm_id"))
    return at.select("perm_id", "position", ((F.col("position") + 7 * F.col("perm_id")) % n + 1).alias("sample"))


PERMUTED_SQL = (
    P.sql()
    + BURDEN_SQL
    + """, re AS (SELECT IID, qpheno - avg(qpheno) OVER () AS r, row_number() OVER (ORDER BY IID) AS pos, count(*) OVER () AS n FROM samples),
ob AS (SELECT unit, sum(score * r) AS u FROM sc JOIN re USING (IID) GROUP BY 1),
pe AS (SELECT unit, k AS perm_id, sum(score * b.r) AS u FROM sc JOIN re a USING (IID), range(0, 40) p(k) JOIN re b ON b.pos = (a.pos + 7 * p.k) % a.n + 1 GROUP BY 1, 2)
"""
)


@query(PERMUTED_SQL + 'SELECT ob.unit, 40 AS "nResampling", round(any_value(ob.u), 4) + 0.0 AS "U", round((count(*) FILTER (WHERE abs(pe.u) > abs(ob.u) * (1 + 1e-9)) + 1) / 41.0::DOUBLE, 8) + 0.0 AS "P" FROM ob JOIN pe USING (unit) GROUP BY ob.unit')
def permutation_tests(spark, sf_dir):
    from varloom.operators import resample

    g, per, dev = sparse_scores(spark, sf_dir)
    df = resample.permutation_tests(per, dev, S.fit_null(g.samples, "qpheno"), shifts(g.samples, 40))
    return places(places(df, 4, "U"), 8, "P")


@query(PERMUTED_SQL + 'SELECT unit, perm_id, round(u, 4) + 0.0 AS "U" FROM pe')
def permutation_results(spark, sf_dir):
    from varloom.operators import resample

    g, per, dev = sparse_scores(spark, sf_dir)
    return places(resample.permutation_results(per, dev, S.fit_null(g.samples, "qpheno"), shifts(g.samples, 40)), 4, "U")


def newton_by_unit_sql(source: str, steps: int = 12) -> str:
    """Logistic coefficients of y on 1, x and s for every unit of ``source`` (unit, y, x, s) as CTEs; the last is ``fitted`` (unit, b2, v2)."""
    sums = f"""(SELECT unit, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(w) AS h00, sum(w * x) AS h01, sum(w * s) AS h02, sum(w * x * x) AS h11, sum(w * x * s) AS h12, sum(w * s * s) AS h22, sum(y - m) AS g0, sum((y - m) * x) AS g1, sum((y - m) * s) AS g2
   FROM (SELECT *, m * (1 - m) AS w FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x + b2 * s))) AS m FROM {source} JOIN step{{k}} USING (unit))) GROUP BY unit)"""
    minors = "(SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22 FROM {s})"
    out = f", step0 AS (SELECT DISTINCT unit, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {source})\n"
    for k in range(steps):
        out += f", step{k + 1} AS MATERIALIZED (SELECT unit, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det AS b0, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det AS b1, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det AS b2 FROM (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM {minors.format(s=sums.format(k=k))}))\n"
    return out + f", fitted AS (SELECT unit, b2, c22 / (h00 * c00 + h01 * c01 + h02 * c02) AS v2 FROM {minors.format(s=sums.format(k=steps))})\n"


@query(
    P.sql("rare")
    + BURDEN_SQL
    + ", us AS MATERIALIZED (SELECT unit, pheno::DOUBLE AS y, sex::DOUBLE AS x, score AS s FROM sc JOIN (SELECT IID, sex FROM samples) USING (IID))\n"
    + newton_by_unit_sql("us")
    + f""", t AS (SELECT *, sqrt(v2) AS se, b2 / sqrt(v2) AS z FROM fitted), m AS (SELECT unit, avg(s) FILTER (y = 1) AS mc, avg(s) FILTER (y = 0) AS mn FROM us GROUP BY 1)
SELECT unit, round(mc, 6) + 0.0 AS "meanCaseScore", round(mn, 6) + 0.0 AS "meanCtrlScore", round(b2, 6) + 0.0 AS effect, round(se, 6) + 0.0 AS "effectSE", round(b2 - {Z975!r} * se, 6) + 0.0 AS "effectCIlower", round(b2 + {Z975!r} * se, 6) + 0.0 AS "effectCIupper", round(exp(b2), 6) + 0.0 AS "OR", round({norm_two_sided_sql('z')}, 7) + 0.0 AS "P" FROM t JOIN m USING (unit)"""
)
def glm_burden(spark, sf_dir):
    g = P.geno(spark, sf_dir, "rare")
    df = W.glm_units(g, members(spark, sf_dir), S.fit_null(g.samples, "pheno", ["sex"], "logistic"))
    return places(places(df.select("unit", "meanCaseScore", "meanCtrlScore", *FULL, "OR", "P"), 6, "meanCaseScore", "meanCtrlScore", *FULL, "OR"), 7, "P")
