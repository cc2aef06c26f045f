"""Queries on genotypes. The oracles count a dense table of all cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions.expr import erfc_sql, r6
from varloom.operators import geno as G

from . import projection as P

QUERIES: dict[str, tuple] = {}
#: Added before rounding sums that can be exact halves, so that rounding doesn't depend on the order of summation; the SQL adds the same.
NUDGE = 1.3e-8
SUMMARY_COLS = ["AF", "callRate", "hweP"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


def hwe_cte(source: str, keys: str) -> str:
    """SQL: genotype counts and hweP of a dense table with VAR_id, ploidy, sex, g."""
    chi = "coalesce(" + " + ".join(f"(o{i} - e{i}) * (o{i} - e{i}) / nullif(e{i}, 0)" for i in range(3)) + ", 0)"
    one = lambda g: f"count(*) FILTER (WHERE g = {g} AND (ploidy <> 'XnonPAR' OR sex = 2)) AS o{g}"
    return f""", hc AS (SELECT {keys}, ploidy, count(*) AS n, count(g) AS called, count(*) FILTER (WHERE g = 0) AS geno0, count(*) FILTER (WHERE g = 1) AS geno1, count(*) FILTER (WHERE g = 2) AS geno2, {one(0)}, {one(1)}, {one(2)},
  CASE ploidy WHEN 'diploid' THEN avg(g) / 2 WHEN 'XnonPAR' THEN (coalesce(sum(g) FILTER (WHERE sex = 1), 0) + coalesce(sum(g) FILTER (WHERE sex = 2), 0)) / nullif(count(g) FILTER (WHERE sex = 1) + 2 * count(g) FILTER (WHERE sex = 2), 0) ELSE avg(g) FILTER (WHERE sex = 1) END AS af
  FROM {source} GROUP BY {keys}, ploidy),
hp AS (SELECT *, (o1 + 2 * o2) / nullif(cast(2 * (o0 + o1 + o2) AS DOUBLE), 0) AS p, o0 + o1 + o2 AS m FROM hc),
he AS (SELECT *, round_even(m * (1 - p) * (1 - p), 0) AS e0, round_even(2 * m * p * (1 - p), 0) AS e1, round_even(m * p * p, 0) AS e2 FROM hp),
hx AS (SELECT *, {chi} AS chi FROM he),
hw AS (SELECT *, CASE WHEN ploidy = 'YnonPAR' THEN 1.0 ELSE {erfc_sql('sqrt(chi / 2)')} END AS hwe FROM hx)
"""


SUMMARY = 'round(af, 6) + 0.0 AS "AF", round(called / n, 6) + 0.0 AS "callRate", geno0, geno1, geno2, round(hwe, 6) + 0.0 AS "hweP"'


@query(P.sql() + hwe_cte("cells", "VAR_id") + f"SELECT VAR_id, {SUMMARY} FROM hw")
def summarise_geno(spark, sf_dir):
    return rounded(G.summarise(G.counts(P.geno(spark, sf_dir))), *SUMMARY_COLS)


@query(P.sql("rare") + hwe_cte("cells", "VAR_id") + f"SELECT VAR_id, {SUMMARY} FROM hw")
def summarise_geno_rare(spark, sf_dir):
    return rounded(G.summarise(G.counts(P.geno(spark, sf_dir, "rare"))), *SUMMARY_COLS)


@query(P.sql() + hwe_cte("fcells", "VAR_id") + f"SELECT VAR_id, {SUMMARY} FROM hw")
def flip_to_minor_stats(spark, sf_dir):
    return rounded(G.summarise(G.flip(G.counts(P.geno(spark, sf_dir)))), *SUMMARY_COLS)


@query(P.sql() + hwe_cte("fcells WHERE \"superPop\" IS NOT NULL", 'VAR_id, "superPop"') + f'SELECT VAR_id, "superPop", {SUMMARY} FROM hw')
def summarise_splitby(spark, sf_dir):
    return rounded(G.summarise_by(P.geno(spark, sf_dir), "superPop"), *SUMMARY_COLS)


@query(
    P.sql()
    + """SELECT VAR_id, round(af0, 6) + 0.0 AS "AF", round(maf, 6) + 0.0 AS "MAF", cast(ac AS BIGINT) AS "AC", cast(mac AS BIGINT) AS "MAC", carriers, round(cr, 6) + 0.0 AS "callRate"
FROM faf JOIN (SELECT VAR_id, coalesce(sum(g), 0) AS ac, count(*) FILTER (WHERE g >= 1) AS carriers, count(g) / count(*) AS cr FROM cells GROUP BY 1) USING (VAR_id)
JOIN (SELECT VAR_id, coalesce(sum(g), 0) AS mac FROM fcells GROUP BY 1) USING (VAR_id)"""
)
def variant_af(spark, sf_dir):
    raw = G.counts(P.geno(spark, sf_dir))
    a = raw.select("VAR_id", r6(G.frequency()).alias("AF"), G.allele_count().alias("AC"), G.carriers().alias("carriers"), r6(G.call_rate()).alias("callRate"))
    b = G.flip(raw).select("VAR_id", r6(G.frequency()).alias("MAF"), G.allele_count().alias("MAC"))
    return a.join(b, "VAR_id")


@query(P.sql() + 'SELECT IID, round(count(g) / count(*), 6) + 0.0 AS "callRate" FROM cells GROUP BY IID')
def sample_callrate(spark, sf_dir):
    return rounded(G.sample_call_rate(P.geno(spark, sf_dir)), "callRate")


def _model_sql(model: str) -> str:
    g = "CASE WHEN g > 0 THEN 1 WHEN g = 0 THEN 0 END" if model == "dominant" else "CASE WHEN g = 2 THEN 1 WHEN g IN (0, 1) THEN 0 END"
    return P.sql() + f"SELECT VAR_id, flipped, count(*) FILTER (WHERE m = 0) AS geno0, count(*) FILTER (WHERE m = 1) AS geno1, round(avg(m), 6) + 0.0 AS mean_gt FROM (SELECT *, {g} AS m FROM fcells) GROUP BY 1, 2"


def _model(spark, sf_dir, model):
    df = G.recode(G.flip(G.counts(P.geno(spark, sf_dir))), model)
    return df.select("VAR_id", "flipped", G.genotype_count(0).alias("geno0"), G.genotype_count(1).alias("geno1"), r6(G.mean_genotype()).alias("mean_gt"))


@query(_model_sql("dominant"))
def recode_dominant(spark, sf_dir):
    return _model(spark, sf_dir, "dominant")


@query(_model_sql("recessive"))
def recode_recessive(spark, sf_dir):
    return _model(spark, sf_dir, "recessive")


@query(P.sql() + """SELECT VAR_id, IID, round(coalesce(g, m), 6) + 0.0 AS dosage FROM (SELECT *, avg(g) OVER (PARTITION BY VAR_id) AS m FROM fcells)
JOIN dosage USING (VAR_id, IID) WHERE coalesce(g, m) IS NOT NULL""")
def mean_impute(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    based = G.baselines(G.flip(G.counts(g)))
    return G.values(g, based).join(based.select("VAR_id", "fill"), "VAR_id").select("VAR_id", "IID", r6(F.coalesce(F.col("gt").cast("double"), "fill")).alias("dosage")).where("dosage is not null")


@query(P.sql() + "SELECT VAR_id, IID, coalesce(g, 0) AS dosage FROM fcells JOIN dosage USING (VAR_id, IID)")
def missing_to_ref(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    return G.values(g, G.flip(G.counts(g))).select("VAR_id", "IID", F.coalesce("gt", F.lit(0)).alias("dosage"))


@query(P.sql() + "SELECT VAR_id, CASE WHEN maf * (1 - maf) > 0 THEN round(w / sqrt(maf * (1 - maf)), 6) + 0.0 END AS w FROM faf JOIN var USING (VAR_id)")
def mb_weights(spark, sf_dir):
    df = G.flip(G.counts(P.geno(spark, sf_dir)))
    return df.select("VAR_id", r6(G.mb_weight(F.col("w"), G.frequency())).alias("w"))


@query(P.sql("rare") + "SELECT VAR_id, IID, g AS genotype FROM cells WHERE g >= 1")
def carriers(spark, sf_dir):
    return G.carrier_rows(P.geno(spark, sf_dir, "rare"))


@query(
    P.sql()
    + """SELECT VAR_id, "superPop", count(*) FILTER (WHERE g >= 1) AS "carrierN", round(avg(c), 6) + 0.0 AS "carrierFreq", round(stddev_samp(c) / sqrt(count(*)), 6) + 0.0 AS "carrierFreqSE"
FROM (SELECT *, CASE WHEN g >= 1 THEN 1.0 WHEN g = 0 THEN 0.0 END AS c FROM cells) GROUP BY 1, 2"""
)
def carrier_freq_by_group(spark, sf_dir):
    return rounded(G.carrier_frequency(P.geno(spark, sf_dir), "superPop"), "carrierFreq", "carrierFreqSE")


BURDEN_SQL = """, im AS (SELECT *, coalesce(g, avg(g) OVER (PARTITION BY VAR_id)) AS d FROM fcells)
, sc AS (SELECT unit, IID, any_value("superPop") AS "superPop", any_value(pheno) AS pheno, any_value(qpheno) AS qpheno, sum(w * d) AS score FROM im JOIN (SELECT VAR_id FROM faf WHERE maf IS NOT NULL) USING (VAR_id) GROUP BY unit, IID)
"""


def members(spark, sf_dir):
    return P.variants(spark, sf_dir).select("unit", "VAR_id", "w")


def unit_scores(spark, sf_dir, **options):
    g = P.geno(spark, sf_dir)
    return g, G.scores(g, *G.burden(g, members(spark, sf_dir), **options))


@query(P.sql() + BURDEN_SQL + "SELECT unit, IID, round(score + 1.3e-8, 6) + 0.0 AS score FROM sc")
def aggregate_units(spark, sf_dir):
    return unit_scores(spark, sf_dir)[1].withColumn("score", F.round(F.col("score") + NUDGE, 6) + F.lit(0.0))


@query(
    P.sql()
    + """SELECT unit, IID, round(sum(w / sqrt(maf * (1 - maf)) * CASE WHEN g > 0 THEN 1 ELSE 0 END) + 1.3e-8, 6) + 0.0 AS score FROM fcells JOIN faf USING (VAR_id)
WHERE maf BETWEEN 0.05 AND 0.3 GROUP BY unit, IID"""
)
def aggregate_units_dominant_mb(spark, sf_dir):
    return unit_scores(spark, sf_dir, model="dominant", impute="missingToRef", maf_weights="mb", MAF=(0.05, 0.3))[1].withColumn("score", F.round(F.col("score") + NUDGE, 6) + F.lit(0.0))


@query(P.sql() + BURDEN_SQL + 'SELECT unit, "superPop", round(avg(score) + 1.3e-8, 6) + 0.0 AS "meanBurden" FROM sc GROUP BY 1, 2')
def burden_by_group(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    df = G.mean_burden(g, *G.burden(g, members(spark, sf_dir)), "superPop")
    return df.withColumn("meanBurden", F.round(F.col("meanBurden") + NUDGE, 6) + F.lit(0.0))


@query(P.sql() + BURDEN_SQL + "SELECT IID, round(sum(score) + 1.3e-8, 5) + 0.0 AS aggregate FROM sc GROUP BY IID")
def collapse_aggs(spark, sf_dir):
    from varloom.operators.sets import collapse_scores

    _, s = unit_scores(spark, sf_dir)
    low = F.substring("unit", 2, 9).cast("int") < 50
    return collapse_scores([s.where(low), s.where(~low)]).withColumn("aggregate", F.round(F.col("aggregate") + NUDGE, 5) + F.lit(0.0))


@query(P.sql() + BURDEN_SQL + "SELECT unit, count(*) AS n, round(sum(score) + 1.3e-8, 5) + 0.0 AS total FROM sc GROUP BY unit")
def merge_aggs(spark, sf_dir):
    from varloom.operators.sets import merge_scores

    _, s = unit_scores(spark, sf_dir)
    low = F.substring("unit", 2, 9).cast("int") < 50
    return merge_scores([s.where(low), s.where(~low)]).groupBy("unit").agg(F.count("*").alias("n"), (F.round(F.sum("score") + NUDGE, 5) + F.lit(0.0)).alias("total"))


@query(
    P.sql("rare")
    + """SELECT VAR_id, round(maf, 6) + 0.0 AS "MAF", cast(mac AS BIGINT) AS "MAC", carriers FROM faf
JOIN (SELECT VAR_id, sum(g) AS mac, count(*) FILTER (WHERE g >= 1) AS carriers, count(g) / count(*) AS cr, count(*) AS n FROM fcells GROUP BY 1) USING (VAR_id)
WHERE maf BETWEEN 0.005 AND 0.02 AND mac BETWEEN 10 AND 40 AND cr >= 0.9 AND carriers >= 8 AND carriers / n <= 0.03"""
)
def filter_variants_maf(spark, sf_dir):
    inf = float("inf")
    df = G.filter_variants(G.flip(G.counts(P.geno(spark, sf_dir, "rare"))), MAF=(0.005, 0.02), MAC=(10, 40), callRate=(0.9, 1), carriers=(8, inf), carrierFreq=(0, 0.03))
    return df.select("VAR_id", r6(G.frequency()).alias("MAF"), G.allele_count().alias("MAC"), G.carriers().alias("carriers"))


@query(
    P.sql()
    + """, ok AS (SELECT IID FROM cells WHERE pheno = 1 GROUP BY IID HAVING count(g) / count(*) >= 0.975)
SELECT VAR_id, cast(coalesce(sum(g), 0) AS BIGINT) AS "AC", count(*) AS n FROM cells JOIN ok USING (IID) GROUP BY 1"""
)
def filter_samples(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    g = G.filter_samples(g, (0.975, 1.0), keep=g.samples.where("pheno = 1"), complete=["qpheno"])
    return G.counts(g).select("VAR_id", G.allele_count().alias("AC"), G.size().alias("n"))
