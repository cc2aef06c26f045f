"""Queries on association tests, resampling, spatial clusters and VCF text."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import assoc as A
from varloom.operators import geno as G
from varloom.operators import spatial
from varloom.sources import vcf as V

from . import projection as P
from .geno_queries import BURDEN_SQL, NUDGE, members, unit_scores
from .set_queries import GENE_SQL, gene_sets

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def five(df, *names):
    return df.withColumns({n: F.round(n, 5) + F.lit(0.0) for n in names})


@query(
    P.sql()
    + BURDEN_SQL
    + """, cr AS (SELECT unit, IID, max(CASE WHEN g >= 1 THEN 1 ELSE 0 END) AS c, avg(CASE WHEN g IS NULL THEN 0.0 ELSE 1.0 END) AS call FROM fcells JOIN faf USING (VAR_id) WHERE VAR_id IN (SELECT VAR_id FROM fcells GROUP BY 1 HAVING max(g) >= 1) GROUP BY 1, 2)
SELECT unit, cast(count(*) FILTER (WHERE pheno = 1) AS INT) AS "caseN", cast(count(*) FILTER (WHERE pheno = 0) AS INT) AS "ctrlN", cast(sum(c) FILTER (WHERE pheno = 1) AS BIGINT) AS "caseCarriers", cast(sum(c) FILTER (WHERE pheno = 0) AS BIGINT) AS "ctrlCarriers",
round(avg(score) FILTER (WHERE pheno = 1) + 1.3e-8, 6) + 0.0 AS "meanCaseScore", round(avg(score) FILTER (WHERE pheno = 0) + 1.3e-8, 6) + 0.0 AS "meanCtrlScore", round(avg(call) FILTER (WHERE pheno = 1), 5) + 0.0 AS "caseCallRate" FROM sc JOIN cr USING (unit, IID) GROUP BY 1"""
)
def rvb_counts(spark, sf_dir):
    df = A.rvb(P.geno(spark, sf_dir), members(spark, sf_dir), ["pheno"], ["skat_burden"])
    df = df.select("unit", "caseN", "ctrlN", "caseCarriers", "ctrlCarriers", (F.round(F.col("meanCaseScore") + NUDGE, 6) + F.lit(0.0)).alias("meanCaseScore"), (F.round(F.col("meanCtrlScore") + NUDGE, 6) + F.lit(0.0)).alias("meanCtrlScore"), "caseCallRate")
    return five(df, "caseCallRate")


@query(None)
def rvb_binary_tests(spark, sf_dir):
    return A.rvb(P.geno(spark, sf_dir, "rare"), members(spark, sf_dir), ["pheno"], list(A.BINARY), covar=[["PC1"]], MAF=(0.0, 0.2))


@query(None)
def rvb_continuous_tests(spark, sf_dir):
    return A.rvb(P.geno(spark, sf_dir, "rare"), members(spark, sf_dir), ["qpheno"], list(A.CONTINUOUS), covar=[["PC1", "superPop"]], models=["allelic", "dominant"], continuous=True)


@query(None)
def singlevar_tests(spark, sf_dir):
    return A.singlevar(P.geno(spark, sf_dir, "rare"), ["pheno"], ["glm", "scoreSPA", "firth"])


@query(None)
def rvb_resampled(spark, sf_dir):
    return A.rvb(P.geno(spark, sf_dir, "rare"), members(spark, sf_dir), ["pheno"], ["skat_burden", "acatv"], n_resampling=20)


@query(P.sql() + BURDEN_SQL + ", " + GENE_SQL + 'SELECT "geneSetName", IID, round(sum(score) + 1.3e-8, 5) + 0.0 AS aggregate, count(DISTINCT unit) AS "genesObs" FROM gs JOIN sc USING (unit) GROUP BY 1, 2')
def gene_set_burden(spark, sf_dir):
    _, s = unit_scores(spark, sf_dir)
    return A.gene_set_scores(s, gene_sets(spark, sf_dir)).withColumn("aggregate", F.round(F.col("aggregate") + NUDGE, 5) + F.lit(0.0))


@query("SELECT p.i AS perm_id, (SELECT count(*) FROM customer)::INT AS n, (SELECT count(*) * (count(*) + 1) // 2 FROM customer)::BIGINT AS total FROM range(0, 30) p(i)")
def build_resampling(spark, sf_dir):
    t = A.resampling_table(spark, P.samples(spark, sf_dir, "rare").count(), 30)
    return t.groupBy("perm_id").agg(F.count_distinct("position").cast("int").alias("n"), F.sum("sample").alias("total"))


@query(None)
def spatial_clust(spark, sf_dir):
    v = P.variants(spark, sf_dir)
    return spatial.spatial_clusters(v.select("unit", F.lit("all").alias("varSetName"), "VAR_id", "w"), v, [(5, 2), (10, 5)])


#: VCF-like records made of parts: 6 samples, some with two alternative alleles.


def vcf_lines(spark, sf_dir):
    p = P.table(spark, sf_dir, "part").select(*P.exprs(P.VAR), "p_partkey")
    two = F.when(F.col("p_partkey") % 4 == 0, F.concat("ALT", F.lit(",N"))).otherwise(F.col("ALT"))
    codes = F.array(*map(F.lit, ("0/0", "0|1", "1/1", "./.", "1/0", "0/2", "2/2", "1/2")))
    gt = lambda i: F.concat(F.element_at(codes, (F.pmod(F.col("p_partkey") * (i + 1) + i, F.when(F.col("p_partkey") % 4 == 0, 8).otherwise(5)) + 1).cast("int")), F.lit(":9"))
    info = F.concat(F.lit("AC="), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ";DB").otherwise(""))
    body = p.select(F.col("p_partkey").alias("line"), F.concat_ws("\t", "CHROM", F.col("POS").cast("string"), F.lit("."), "REF", two, F.lit("."), F.lit("PASS"), info, F.lit("GT:DP"), *(gt(i) for i in range(6))).alias("value"))
    head = spark.createDataFrame([(-3, "##fileformat=VCFv4.2"), (-2, "##INFO=<ID=AC,Number=1>"), (-2, "##INFO=<ID=DB,Number=0>"), (-1, "#" + "\t".join(V.FIXED) + "\t" + "\t".join(f"s{i}" for i in range(6)))], "line long, value string")
    return head.unionByName(body)


VCF_SQL = (
    P.sql(dense=False)
    + """, v AS (SELECT *, VAR_id % 4 = 0 AS multi FROM var), a AS (SELECT *, unnest(CASE WHEN multi THEN ["ALT", 'N'] ELSE ["ALT"] END) AS one, unnest(CASE WHEN multi THEN [1, 2] ELSE [1] END) AS k FROM v),
g AS (SELECT *, (VAR_id * (i + 1) + i) % CASE WHEN multi THEN 8 ELSE 5 END AS c FROM a, range(0, 6) s(i)),
t AS (SELECT *, list_extract([0, 0, 1, NULL, 1, 0, 2, 1], cast(c + 1 AS INT)) AS a1, list_extract([0, 1, 1, NULL, 0, 2, 2, 2], cast(c + 1 AS INT)) AS a2 FROM g),
d AS (SELECT VAR_id AS line, k - 1 AS k, one AS "ALT", 's' || i AS "IID", CASE WHEN a1 IS NULL THEN NULL WHEN multi THEN (a1 = k)::INT + (a2 = k)::INT ELSE a1 + a2 END AS gt FROM t)
"""
)


def vcf_cells(spark, sf_dir):
    lines = vcf_lines(spark, sf_dir)
    recs = V.split_alleles(V.records(lines))
    names = V.samples(spark, V.header(lines))
    cells = recs.select("line", "k", "ALT", F.posexplode("texts").alias("sample_idx", "t")).join(F.broadcast(names), "sample_idx")
    return cells.select("line", "k", "ALT", "IID", V.dosage(F.col("t")).cast("int").alias("gt"))


@query(VCF_SQL + 'SELECT line, "IID", gt FROM d WHERE line % 4 <> 0')
def vcf_parse(spark, sf_dir):
    return vcf_cells(spark, sf_dir).where("line % 4 <> 0").select("line", "IID", "gt")


@query(VCF_SQL + 'SELECT line, k, "ALT", "IID", gt FROM d WHERE line % 4 = 0')
def vcf_multiallelic(spark, sf_dir):
    return vcf_cells(spark, sf_dir).where("line % 4 = 0")


@query(P.sql(dense=False) + """SELECT "CHROM", "POS", "REF", unnest(CASE WHEN VAR_id % 4 = 0 THEN ["ALT", 'N'] ELSE ["ALT"] END) AS "ALT", cast(VAR_id % 9 AS VARCHAR) AS "AC", CASE WHEN VAR_id % 2 = 0 THEN 'DB' ELSE 'NA' END AS "DB" FROM var""")
def vcf_info_table(spark, sf_dir):
    return V.info_table(vcf_lines(spark, sf_dir)).select("CHROM", "POS", "REF", "ALT", "AC", "DB")


@query(
    P.sql()
    + """, few AS (SELECT IID FROM samples WHERE IID < 12), c AS (SELECT v.VAR_id, f.IID, CASE WHEN d.VAR_id IS NULL THEN v.g0 ELSE d.gt END AS g FROM var v CROSS JOIN few f LEFT JOIN dosage d ON d.VAR_id = v.VAR_id AND d.IID = f.IID)
SELECT c.VAR_id, concat_ws(chr(9), any_value("CHROM"), any_value("POS"), c.VAR_id, any_value("REF"), any_value("ALT"), '.', '.', '.', 'GT') || chr(9) || string_agg(CASE WHEN g IS NULL THEN './.' WHEN g = 0 THEN '0/0' WHEN g = 1 THEN '0/1' ELSE '1/1' END, chr(9) ORDER BY c.IID) AS value FROM c JOIN var USING (VAR_id) GROUP BY 1"""
)
def write_vcf_lines(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    g = G.Geno(g.variants.withColumns({c: F.lit(None).cast("string") for c in ("ID", "QUAL", "FILTER")}), g.samples.where("IID < 12").withColumn("sample_idx", F.col("IID")), g.stored.where("IID < 12"))
    return V.lines_of(g, use_var_id=True).select("VAR_id", "value")


@query(
    P.sql()
    + """, c AS (SELECT v.VAR_id, s.IID, CASE WHEN d.VAR_id IS NULL THEN v.g0 ELSE d.gt END AS g FROM var v CROSS JOIN samples s LEFT JOIN dosage d ON d.VAR_id = v.VAR_id AND d.IID = s.IID)
SELECT c.VAR_id, concat_ws(chr(9), any_value("CHROM"), any_value("POS"), c.VAR_id, any_value("REF"), any_value("ALT"), '.', '.', '.', 'GT') || chr(9) || string_agg(CASE WHEN g IS NULL THEN './.' WHEN g = 0 THEN '0/0' WHEN g = 1 THEN '0/1' ELSE '1/1' END, chr(9) ORDER BY c.IID) AS value FROM c JOIN var USING (VAR_id) GROUP BY 1"""
)
def write_vcf_all(spark, sf_dir):
    """Lines of all samples of the panel."""
    g = P.geno(spark, sf_dir)
    g = G.Geno(g.variants.withColumns({c: F.lit(None).cast("string") for c in ("ID", "QUAL", "FILTER")}), g.samples.withColumn("sample_idx", F.col("IID")), g.stored)
    return V.lines_of(g, use_var_id=True).select("VAR_id", "value")
