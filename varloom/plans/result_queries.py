"""Queries on result tables and gene-set analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions.expr import acat_term_sql, cauchy_tail_sql, norm_tail_sql, qnorm_sql, r6
from varloom.functions.tails import Z950, erfc_sql, hill_sql, norm_two_sided_sql, t_quantile_sql
from varloom.operators import gsa as A
from varloom.operators import gsa_null as N
from varloom.operators import results as R

from . import projection as P
from .set_queries import GENE_SQL, gene_sets

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: A burden-like result of the line items: a z statistic of the mean quantity for each unit of 20 parts, test and set.
Z_STAT = "(s / n - 25.5) * sqrt(n) / sqrt((ss - s * s / n) / (n - 1))"
RESULT = {"unit": "concat('U', cast(k as string))", "test": "concat('t', cast(t as string))", "varSetName": "concat('v', cast(v as string))", "P": norm_tail_sql("z")}


def result(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    rows = P.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / 20).alias("k"), (F.col("l_linenumber") % 3).cast("long").alias("t"), (F.col("l_orderkey") % 2).alias("v"), q.alias("q"))
    sums = rows.groupBy("k", "t", "v").agg(F.count("*").alias("n"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss")).where("n >= 3 and n * ss > s * s")
    return sums.withColumn("z", F.expr(Z_STAT.replace("sqrt(n)", "sqrt(cast(n as double))"))).select(*P.exprs(RESULT), "k", "t", "v", "n")


RESULT_SQL = f"""WITH res0 AS (SELECT l_partkey // 20 AS k, (l_linenumber % 3)::BIGINT AS t, l_orderkey % 2 AS v, count(*) AS n, sum(l_quantity::DOUBLE) AS s, sum(l_quantity::DOUBLE * l_quantity) AS ss FROM lineitem GROUP BY 1, 2, 3),
res1 AS (SELECT *, {Z_STAT.replace('25.5', '25.5::DOUBLE').replace('sqrt(n)', 'sqrt(n::DOUBLE)')} AS z FROM res0 WHERE n >= 3 AND n * ss > s * s), res AS (SELECT {P._fields(RESULT)}, k, t, v, n FROM res1)
"""


@query(RESULT_SQL + f", a AS (SELECT unit, \"varSetName\", avg({acat_term_sql('\"P\"')}) AS \"T\" FROM res GROUP BY 1, 2) SELECT unit, \"varSetName\", 'ACAT' AS test, round({cauchy_tail_sql('\"T\"')}, 6) + 0.0 AS \"P\" FROM a")
def acat_units(spark, sf_dir):
    return R.acat(result(spark, sf_dir), ["test"], ["unit", "varSetName", "test"]).withColumn("P", r6(F.col("P")))


@query(
    RESULT_SQL
    + f""", a AS (SELECT unit, "varSetName", avg({acat_term_sql('"P"')}) AS "T" FROM res GROUP BY 1, 2), b AS (SELECT unit, {cauchy_tail_sql('"T"')} AS "P" FROM a),
c AS (SELECT unit, avg({acat_term_sql('"P"')}) AS "T" FROM b GROUP BY 1) SELECT unit, 'ACAT' AS "varSetName", round({cauchy_tail_sql('"T"')}, 6) + 0.0 AS "P" FROM c"""
)
def acat_nested(spark, sf_dir):
    return R.acat(result(spark, sf_dir), ["test", "varSetName"], ["unit", "varSetName", "test"]).select("unit", "varSetName", r6(F.col("P")).alias("P"))


@query(RESULT_SQL + """, f AS (SELECT unit, test, "varSetName", CASE WHEN k % 10 = 0 THEN 0.0 WHEN k % 10 = 1 THEN 1.0 ELSE "P" END AS "P" FROM res),
m AS (SELECT min("P") FILTER (WHERE "P" > 0) AS lo, max("P") FILTER (WHERE "P" < 1) AS hi FROM f)
SELECT unit, test, "varSetName", round(CASE WHEN "P" = 0 THEN lo WHEN "P" = 1 THEN hi ELSE "P" END, 9) + 0.0 AS "P" FROM f, m""")
def fix_pvalues(spark, sf_dir):
    odd = result(spark, sf_dir).withColumn("P", F.when(F.col("k") % 10 == 0, 0.0).when(F.col("k") % 10 == 1, 1.0).otherwise(F.col("P")))
    return R.fix_p(odd).select("unit", "test", "varSetName", (F.round("P", 9) + F.lit(0.0)).alias("P"))


@query(RESULT_SQL + 'SELECT unit, test, "varSetName", round("P", 9) + 0.0 AS "P" FROM res ORDER BY res."P", unit LIMIT 10')
def top_result(spark, sf_dir):
    one = result(spark, sf_dir)
    return R.top_result(one.select("unit", "test", "varSetName", "P")).withColumn("P", F.round("P", 9) + F.lit(0.0))


@query(RESULT_SQL + f", z AS (SELECT test, {qnorm_sql('1 - \"P\" / 2')} AS q FROM res), l AS (SELECT test, quantile_cont(q * q, 0.5) / {R.MEDIAN_CHISQ1} AS lam FROM z GROUP BY 1) SELECT test, round(lam, 6) + 0.0 AS \"lambda\", round(1 + (lam - 1) * (1 / 800.0::DOUBLE + 1 / 1200.0::DOUBLE) * 500, 6) + 0.0 AS lambda1000 FROM l")
def inflation(spark, sf_dir):
    df = R.inflation(result(spark, sf_dir), ["test"], 800, 1200)
    return df.select("test", r6(F.col("lambda")).alias("lambda"), r6(F.col("lambda1000")).alias("lambda1000"))


@query(RESULT_SQL + """, one AS (SELECT unit, "P" FROM res WHERE t = 0 AND v = 0) SELECT unit, round(-log10("P"), 6) + 0.0 AS observed, round(-log10((row_number() OVER (ORDER BY "P", unit) - 0.5) / count(*) OVER ()), 6) + 0.0 AS expected FROM one""")
def qq_data(spark, sf_dir):
    df = R.qq_data(result(spark, sf_dir).where("t = 0 and v = 0"), "unit")
    return df.select("unit", r6(F.col("observed")).alias("observed"), r6(F.col("expected")).alias("expected"))


CONTIGS = [(str(c), 1000 + 10 * c) for c in range(1, 23)] + [("X", 900), ("Y", 500)]
CONTIG_SQL = "contigs AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n}, {i})" for i, (c, n) in enumerate(CONTIGS)) + ') AS t("CHROM", n, i)), offs AS (SELECT "CHROM", i, coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM contigs)\n'


@query(P.sql(dense=False) + ", " + CONTIG_SQL + 'SELECT VAR_id, "CHROM", cast("POS" + o AS BIGINT) AS x, i % 2 AS colour, round(-log10((VAR_id % 997 + 1) / 1000.0::DOUBLE), 6) + 0.0 AS "logP" FROM var JOIN offs USING ("CHROM")')
def manhattan_data(spark, sf_dir):
    v = P.variants(spark, sf_dir).select("VAR_id", "CHROM", "POS", ((F.col("VAR_id") % 997 + 1) / 1000.0).alias("P"))
    return R.manhattan_data(v, R.contig_offsets(spark, CONTIGS)).select("VAR_id", "CHROM", "x", "colour", r6(F.col("logP")).alias("logP"))


@query(RESULT_SQL + ", " + GENE_SQL + f'SELECT res.unit, round({qnorm_sql("1 - \"P\"")}, 5) + 0.0 AS "Z", EXISTS (SELECT 1 FROM gs WHERE gs.unit = res.unit AND "geneSetName" = \'S3\') AS in_geneset FROM res WHERE t = 1 AND v = 0')
def density_data(spark, sf_dir):
    df = R.density_data(result(spark, sf_dir).where("t = 1 and v = 0"), gene_sets(spark, sf_dir).where("geneSetName = 'S3'"))
    return df.withColumn("Z", F.round("Z", 5) + F.lit(0.0))


@query(RESULT_SQL + """SELECT 'unit' AS field, 'distinct' AS statistic, count(DISTINCT unit)::DOUBLE AS value FROM res UNION ALL SELECT 'test', 'distinct', count(DISTINCT test) FROM res
UNION ALL SELECT 'caseN', 'min', min(n) FROM res UNION ALL SELECT 'caseN', 'max', max(n) FROM res""")
def result_summary(spark, sf_dir):
    return R.summary(result(spark, sf_dir).withColumn("caseN", F.col("n")), ["unit", "test"])


@query(RESULT_SQL + ', other AS (SELECT concat(\'U\', p_partkey // 20) AS unit, count(*) AS score FROM part WHERE p_size <= 3 GROUP BY 1) SELECT unit, test, "varSetName", score FROM res LEFT JOIN other USING (unit)')
def merge_result(spark, sf_dir):
    unit = F.concat(F.lit("U"), F.floor(F.col("p_partkey") / 20).cast("string"))
    other = P.table(spark, sf_dir, "part").where("p_size <= 3").groupBy(unit.alias("unit")).agg(F.count("*").alias("score"))
    return R.merge_results(result(spark, sf_dir).select("unit", "test", "varSetName"), other, ["unit"])


@query(
    """WITH ex AS (SELECT s_suppkey * 300 AS start, s_suppkey * 300 + 100 + s_suppkey % 20 AS "end" FROM supplier WHERE s_suppkey <= 8),
e AS (SELECT *, coalesce(sum("end" - start + 51) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM ex),
p AS (SELECT p_partkey AS VAR_id, p_partkey * 17 % 2800 AS pos, (p_partkey % 97 + 1) / 100.0::DOUBLE AS p, p_size / 25.0::DOUBLE AS o FROM part)
SELECT VAR_id, cast(l + pos - start + 1 AS BIGINT) AS x, CASE WHEN o >= 1 THEN 1 ELSE -1 END AS side, round((CASE WHEN o >= 1 THEN 1 ELSE -1 END) * -log10(p), 6) + 0.0 AS y FROM p JOIN e ON pos BETWEEN start AND "end\""""
)
def mutation_plot_data(spark, sf_dir):
    ex = P.table(spark, sf_dir, "supplier").where("s_suppkey <= 8").select((F.col("s_suppkey") * 300).alias("start"), (F.col("s_suppkey") * 300 + 100 + F.col("s_suppkey") % 20).alias("end"))
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("VAR_id"), (F.col("p_partkey") * 17 % 2800).alias("POS"), ((F.col("p_partkey") % 97 + 1) / 100.0).alias("P"), (F.col("p_size") / 25.0).alias("OR"))
    return R.mutation_plot_data(p, ex).withColumn("y", r6(F.col("y")))


def stats(spark, sf_dir):
    return A.prepare(unit_stats(spark, sf_dir), ["size"])


def unit_stats(spark, sf_dir):
    return result(spark, sf_dir).where("t = 0 and v = 1").select("unit", F.when(F.col("k") % 50 == 3, F.lit(None)).when(F.col("k") % 50 == 7, 0.0).otherwise(F.col("P")).alias("P"), F.col("n").cast("double").alias("size"))


STATS_SQL = (
    RESULT_SQL
    + ", "
    + GENE_SQL
    + f""", u AS (SELECT unit, n::DOUBLE AS size, CASE WHEN k % 50 = 7 THEN 0.0 ELSE "P" END AS "P" FROM res WHERE t = 0 AND v = 1 AND k % 50 <> 3),
z0 AS (SELECT *, {qnorm_sql('1 - "P"')} AS z FROM u),
st AS (SELECT unit, size, "P", CASE WHEN isinf(z) THEN (SELECT max(z) FROM z0 WHERE NOT isinf(z)) ELSE z END AS "Z" FROM z0),
mem AS (SELECT "geneSetName", st.* FROM gs JOIN st USING (unit))
"""
)


@query(STATS_SQL + 'SELECT unit, size, round("Z", 5) + 0.0 AS "Z" FROM st')
def gsa_prepare(spark, sf_dir):
    return stats(spark, sf_dir).select("unit", "size", (F.round("Z", 5) + F.lit(0.0)).alias("Z"))


@query(STATS_SQL + f""", r AS (SELECT unit, rank() OVER (ORDER BY "P" DESC) + (count(*) OVER (PARTITION BY "P") - 1) / 2 AS r, count(*) OVER () AS n FROM u) SELECT unit, round({qnorm_sql('((r - 0.5) / n)')}, 5) + 0.0 AS "Z" FROM r""")
def gsa_prepare_int(spark, sf_dir):
    return A.prepare(unit_stats(spark, sf_dir), int_ranks=True).select("unit", (F.round("Z", 5) + F.lit(0.0)).alias("Z"))


#: P of a larger t, of a table q with effect, se and df.
UPPER_SQL = f", tt AS (SELECT *, effect / se AS t FROM q), h AS (SELECT *, {hill_sql('t', 'df')} AS h FROM tt)"
UPPER_P = f"CASE WHEN t > 0 THEN {erfc_sql('h')} / 2 ELSE 1 - {erfc_sql('h')} / 2 END"


@query(
    STATS_SQL
    + f""", x AS (SELECT "geneSetName", unit, size, "Z", CASE WHEN EXISTS (SELECT 1 FROM mem m WHERE m."geneSetName" = g."geneSetName" AND m.unit = st.unit) THEN 1.0 ELSE 0.0 END AS s FROM st, (SELECT DISTINCT "geneSetName" FROM mem) g),
a AS (SELECT "geneSetName", regr_slope(s, size) AS bs, regr_intercept(s, size) AS is_, regr_slope("Z", size) AS bz, regr_intercept("Z", size) AS iz FROM x GROUP BY 1),
r AS (SELECT x."geneSetName", s - is_ - bs * size AS sr, "Z" - iz - bz * size AS zr, s FROM x JOIN a USING ("geneSetName")),
e AS (SELECT "geneSetName", sum(sr * zr) / sum(sr * sr) AS effect, sum(zr * zr) AS yy, sum(sr * sr) AS ss, count(*) AS n, sum(s) AS m FROM r GROUP BY 1)
, q AS (SELECT *, sqrt((yy - effect * effect * ss) / (n - 4) / ss) AS se, n - 3 AS df FROM e WHERE ss > 1e-9){UPPER_SQL}
SELECT "geneSetName", cast(m AS BIGINT) AS "genesObs", round(effect, 5) + 0.0 AS effect, round(se, 5) + 0.0 AS "effectSE", round(effect - {t_quantile_sql('df', Z950)} * se, 5) + 0.0 AS "effectCIlower", round({UPPER_P}, 7) + 0.0 AS "P" FROM h"""
)
def gsa_lm(spark, sf_dir):
    s = stats(spark, sf_dir)
    df = A.competitive_lm(s, A.observed(s, gene_sets(spark, sf_dir)), ["size"])
    return df.select("geneSetName", "genesObs", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("effect", "effectSE", "effectCIlower")), (F.round("P", 7) + F.lit(0.0)).alias("P"))


@query(STATS_SQL + f', m AS (SELECT "geneSetName", avg("Z") AS effect, count(*) AS n FROM mem GROUP BY 1) SELECT "geneSetName", n AS "genesObs", round(effect, 5) + 0.0 AS effect, round(1 / sqrt(n), 6) + 0.0 AS "effectSE", round({norm_tail_sql("(effect * sqrt(n))")}, 6) + 0.0 AS "P" FROM m')
def gsa_ztest(spark, sf_dir):
    s = stats(spark, sf_dir)
    return A.z_test(s, A.observed(s, gene_sets(spark, sf_dir))).select("geneSetName", "genesObs", (F.round("effect", 5) + F.lit(0.0)).alias("effect"), r6(F.col("effectSE")).alias("effectSE"), r6(F.col("P")).alias("P"))


@query(
    STATS_SQL
    + """, th AS (SELECT unnest([0.05, 0.2]) AS threshold), tot AS (SELECT threshold::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (WHERE "P" < threshold) AS sig FROM st, th GROUP BY 1),
i AS (SELECT "geneSetName", threshold, count(*) FILTER (WHERE "P" < threshold) AS a, count(*) AS m FROM mem, tot GROUP BY 1, 2)
SELECT "geneSetName", threshold, a AS sig_in, sig - a AS sig_out, m - a AS rest_in, n - sig - m + a AS rest_out FROM i JOIN tot USING (threshold)"""
)
def gsa_fisher_counts(spark, sf_dir):
    s = stats(spark, sf_dir)
    return A.fisher_counts(s, A.observed(s, gene_sets(spark, sf_dir)), [0.05, 0.2])


@query(
    STATS_SQL
    + f""", g AS (SELECT DISTINCT "geneSetName" FROM mem), x AS (SELECT a."geneSetName", b."geneSetName" AS condition, "Z",
 CASE WHEN EXISTS (SELECT 1 FROM mem m WHERE m."geneSetName" = a."geneSetName" AND m.unit = st.unit) THEN 1.0 ELSE 0.0 END AS s, CASE WHEN EXISTS (SELECT 1 FROM mem m WHERE m."geneSetName" = b."geneSetName" AND m.unit = st.unit) THEN 1.0 ELSE 0.0 END AS c
 FROM st, g a, g b WHERE b."geneSetName" IN ('S0', 'S1')),
p AS (SELECT "geneSetName", condition, count(*) AS n, sum(s) AS m, covar_samp(s, c) / var_samp(c) AS bs, covar_samp("Z", c) / var_samp(c) AS bz, avg(s) AS ms, avg("Z") AS mz, avg(c) AS mc FROM x GROUP BY 1, 2),
r AS (SELECT x."geneSetName", x.condition, n, m, s - ms - bs * (c - mc) AS sr, "Z" - mz - bz * (c - mc) AS zr FROM x JOIN p USING ("geneSetName", condition)),
e AS (SELECT "geneSetName", condition, n, m, sum(sr * zr) AS sz, sum(sr * sr) AS ss, sum(zr * zr) AS yy FROM r GROUP BY 1, 2, 3, 4)
, q AS (SELECT *, sz / ss AS effect, sqrt((yy - sz * sz / ss) / (n - 4) / ss) AS se, n - 3 AS df FROM e WHERE ss > 1e-9){UPPER_SQL}
SELECT "geneSetName", condition, cast(m AS BIGINT) AS "genesObs", round(effect, 5) + 0.0 AS effect, round(se, 5) + 0.0 AS "effectSE", round(effect - {t_quantile_sql('df', Z950)} * se, 5) + 0.0 AS "effectCIlower", round({UPPER_P}, 7) + 0.0 AS "P" FROM h"""
)
def gsa_conditional(spark, sf_dir):
    s = stats(spark, sf_dir)
    sets = A.observed(s, gene_sets(spark, sf_dir))
    df = A.conditional(s, sets, gene_sets(spark, sf_dir).where("geneSetName in ('S0', 'S1')")).drop("effectCIupper")
    return df.withColumns({c: F.round(c, 7 if c == "P" else 5) + F.lit(0.0) for c in ("effect", "effectSE", "effectCIlower", "P")})


SCORES = {"unit": "concat('U', cast(floor(p_partkey / 20) as string))", "column": "concat('c', cast(p_size % 4 as string))"}


@query(
    STATS_SQL
    + f""", s0 AS (SELECT concat('U', p_partkey // 20) AS unit, concat('c', p_size % 4) AS "column", (sum(p_size) + 1000 * count(*) FILTER (WHERE p_partkey % 333 = 5))::DOUBLE AS score FROM part GROUP BY 1, 2), s1 AS (SELECT s0.*, "Z" FROM s0 JOIN st USING (unit)),
m AS (SELECT "column", avg(score) AS mu, stddev_samp(score) AS sd FROM s1 GROUP BY 1), w AS (SELECT "column", "Z", least(greatest(score, mu - 2 * sd), mu + 2 * sd) AS x FROM s1 JOIN m USING ("column")),
q AS (SELECT "column", count(*) AS n, count(*) - 2 AS df, regr_slope("Z", x) AS effect, sqrt((regr_syy("Z", x) - regr_slope("Z", x) * regr_sxy("Z", x)) / (count(*) - 3) / regr_sxx("Z", x)) AS se FROM w GROUP BY 1){UPPER_SQL}
SELECT "column", n, round(effect, 5) + 0.0 AS effect, round(se, 5) + 0.0 AS "effectSE", round({UPPER_P}, 7) + 0.0 AS "P" FROM h"""
)
def score_winsor(spark, sf_dir):
    odd = F.count_if(F.col("p_partkey") % 333 == 5)
    rows = P.table(spark, sf_dir, "part").select(*P.exprs(SCORES), "p_size", "p_partkey").groupBy("unit", "column").agg((F.sum("p_size") + 1000 * odd).cast("double").alias("score"))
    df = A.score_lm(stats(spark, sf_dir), rows, limit=2.0)
    return df.withColumns({c: F.round(c, 7 if c == "P" else 5) + F.lit(0.0) for c in ("effect", "effectSE", "P")})


def unit_block_scores(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem").join(P.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = items.groupBy(F.expr("concat('U', cast(l_partkey % 100 as string))").alias("unit"), F.expr("o_custkey % 150").alias("IID")).agg(F.sum("l_quantity").alias("score"))
    blocks = P.table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("id")).distinct().select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("unit"), F.floor(F.col("id") / 5).alias("block"))
    return s, blocks


@query(
    """WITH s AS (SELECT concat('U', l_partkey % 100) AS unit, o_custkey % 150 AS IID, sum(l_quantity) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT concat('U', k) AS unit, k // 5 AS block FROM range(0, 100) a(k)), d AS (SELECT b.unit, block, i.i AS IID, coalesce(score, 0) AS x FROM b CROSS JOIN range(0, 150) i(i) LEFT JOIN s ON s.unit = b.unit AND s.IID = i.i)
SELECT a.block, a.unit AS unit_a, c.unit AS unit_b, round(CASE WHEN abs(corr(a.x, c.x)) < 0.01 THEN 0 ELSE abs(corr(a.x, c.x)) END, 5) + 0.0 AS r FROM d a JOIN d c ON a.block = c.block AND a.IID = c.IID AND a.unit < c.unit GROUP BY 1, 2, 3"""
)
def block_corr(spark, sf_dir):
    s, blocks = unit_block_scores(spark, sf_dir)
    return A.block_correlations(s, blocks, 150).withColumn("r", F.round("r", 5) + F.lit(0.0))


CHOOSE = "(lgamma(({n}) + 1.0::DOUBLE) - lgamma(({k}) + 1.0::DOUBLE) - lgamma(({n}) - ({k}) + 1.0::DOUBLE))"


@query(
    STATS_SQL
    + f""", th AS (SELECT unnest([0.05, 0.2]) AS threshold), tot AS (SELECT threshold::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (WHERE "P" < threshold) AS sig FROM st, th GROUP BY 1),
i AS (SELECT "geneSetName", threshold, count(*) FILTER (WHERE "P" < threshold) AS a, count(*) AS m FROM mem, tot GROUP BY 1, 2), e AS (SELECT * FROM i JOIN tot USING (threshold)),
k AS (SELECT *, unnest(range(a, least(m, sig) + 1)) AS k FROM e)
SELECT "geneSetName", threshold, any_value(a) AS sig_in, round(sum(exp({CHOOSE.format(n='sig', k='k')} + {CHOOSE.format(n='n - sig', k='m - k')} - {CHOOSE.format(n='n', k='m')})), 7) + 0.0 AS "P" FROM k WHERE m - k <= n - sig GROUP BY 1, 2"""
)
def gsa_fisher_p(spark, sf_dir):
    s = stats(spark, sf_dir)
    df = A.fisher_p(A.fisher_counts(s, A.observed(s, gene_sets(spark, sf_dir)), [0.05, 0.2]))
    return df.select("geneSetName", "threshold", "sig_in", (F.round("P", 7) + F.lit(0.0)).alias("P"))


@query(None)
def gsa_fisher(spark, sf_dir):
    s = stats(spark, sf_dir)
    return A.fisher(s, A.observed(s, gene_sets(spark, sf_dir)), [0.05, 0.2])


@query(None)
def gsa_ttest(spark, sf_dir):
    s = stats(spark, sf_dir)
    return A.t_test(s, A.observed(s, gene_sets(spark, sf_dir)))


@query(None)
def gsa_mlm(spark, sf_dir):
    s = stats(spark, sf_dir)
    scores, blocks = unit_block_scores(spark, sf_dir)
    model = N.fit(s, blocks, A.block_correlations(scores, blocks, 150), ["size"])
    return N.test_sets(model, A.observed(s, gene_sets(spark, sf_dir)))


@query(
    STATS_SQL
    + f""", x AS (SELECT "geneSetName", size, "Z", CASE WHEN EXISTS (SELECT 1 FROM mem m WHERE m."geneSetName" = g."geneSetName" AND m.unit = st.unit) THEN 1.0 ELSE 0.0 END AS s FROM st, (SELECT DISTINCT "geneSetName" FROM mem) g),
a AS (SELECT "geneSetName", regr_slope(s, size) AS bs, regr_intercept(s, size) AS is_, regr_slope("Z", size) AS bz, regr_intercept("Z", size) AS iz FROM x GROUP BY 1),
r AS (SELECT x."geneSetName", s - is_ - bs * size AS sr, "Z" - iz - bz * size AS zr, s FROM x JOIN a USING ("geneSetName")),
e AS (SELECT "geneSetName", sum(sr * zr) / sum(sr * sr) AS effect, sqrt(sum(zr * zr) / (count(*) - 2) / sum(sr * sr)) AS se, sum(s)::BIGINT AS m FROM r GROUP BY 1), z AS (SELECT *, effect / se AS z FROM e)
SELECT "geneSetName", m AS "genesObs", round(effect, 5) + 0.0 AS effect, round(se, 5) + 0.0 AS "effectSE", round({norm_two_sided_sql('z')}, 7) + 0.0 AS "P" FROM z"""
)
def gsa_mlm_unrelated(spark, sf_dir):
    """Of units that are blocks of one, the mixed model is an ordinary one."""
    s = stats(spark, sf_dir)
    alone = s.select("unit", F.col("unit").alias("block"))
    none = alone.select("block", F.col("unit").alias("unit_a"), F.col("unit").alias("unit_b"), F.lit(0.0).alias("r")).where("false")
    df = N.test_sets(N.fit(s, alone, none, ["size"]), A.observed(s, gene_sets(spark, sf_dir)))
    return df.select("geneSetName", "genesObs", *((F.round(c, 7 if c == "P" else 5) + F.lit(0.0)).alias(c) for c in ("effect", "effectSE", "P")))
