"""Queries on annotation, cohorts, ranges and whole stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import ranges as R
from varloom.operators import store as S

from . import projection as P

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


VAR_SQL = P.sql(dense=False)


def tables(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem")
    sup = P.table(spark, sf_dir, "supplier")
    links = items.select(F.col("l_partkey").alias("VAR_id"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    parts = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("VAR_id"), "p_brand", "p_size")
    return {"var": P.variants(spark, sf_dir), "anno": links.join(sup.select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey").select("VAR_id", "s_suppkey", "s_nationkey", "s_acctbal"), "info": parts.where("p_size <= 30")}


ANNO_SQL = """, links AS (SELECT DISTINCT l_partkey AS VAR_id, l_suppkey AS s_suppkey FROM lineitem),
anno AS (SELECT VAR_id, s_suppkey, s_nationkey, s_acctbal FROM links JOIN supplier USING (s_suppkey)),
info AS (SELECT p_partkey AS VAR_id, p_brand, p_size FROM part WHERE p_size <= 30)
"""


@query(VAR_SQL + ANNO_SQL + 'SELECT VAR_id, "CHROM", "POS", p_brand FROM var LEFT JOIN info USING (VAR_id)')
def get_anno_left(spark, sf_dir):
    return S.get_anno(tables(spark, sf_dir), "var", ["VAR_id", "CHROM", "POS", "p_brand"], left=["info"])


@query(VAR_SQL + ANNO_SQL + "SELECT VAR_id, s_suppkey, s_acctbal, p_brand FROM anno JOIN info USING (VAR_id) WHERE s_acctbal > 0 AND p_size > 10")
def get_anno_inner_where(spark, sf_dir):
    return S.get_anno(tables(spark, sf_dir), "anno", ["VAR_id", "s_suppkey", "s_acctbal", "p_brand"], inner=["info"], where="s_acctbal > 0 and p_size > 10")


RANGES_SQL = f""", kr AS (SELECT s, j, s * 12 + j AS k FROM (SELECT s_suppkey AS s FROM supplier) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)),
ranges AS (SELECT k AS range_id, {P._fields(P.RANGES)} FROM kr)
"""
HIT = 'v."CHROM" = r."CHROM" AND v."POS" <= r."end" AND v."POS" + length(v."REF") - 1 >= r.start'


@query(VAR_SQL + ANNO_SQL + RANGES_SQL + f", hit AS (SELECT DISTINCT VAR_id FROM var v JOIN ranges r ON {HIT} WHERE range_id % 50 = 0) SELECT VAR_id, s_suppkey FROM anno SEMI JOIN hit USING (VAR_id)")
def get_anno_ranges(spark, sf_dir):
    t = tables(spark, sf_dir)
    hit = R.extract_ranges(t["var"], P.ranges(spark, sf_dir).where("range_id % 50 = 0"))
    return S.get_anno(t, "anno", ["VAR_id", "s_suppkey"], var_ids=hit)


COHORT_SQL = f""", coh AS (SELECT {P._fields(P.SAMPLE)} FROM customer WHERE c_nationkey < 13),
aligned AS (SELECT c.* FROM samples s LEFT JOIN coh c ON s."IID" = c."IID")
"""
RARE_SQL = P.sql("rare", dense=False)


def aligned(spark, sf_dir):
    cohort = P.table(spark, sf_dir, "customer").where("c_nationkey < 13").select(*P.exprs(P.SAMPLE))
    return S.align_cohort(P.samples(spark, sf_dir, "rare"), cohort)


@query(RARE_SQL + COHORT_SQL + 'SELECT "IID", sex, pheno FROM aligned WHERE "IID" IS NOT NULL')
def get_cohort(spark, sf_dir):
    return S.get_cohort(aligned(spark, sf_dir), ["IID", "sex", "pheno"])


@query(RARE_SQL + COHORT_SQL + 'SELECT "IID", sex, pheno FROM aligned')
def align_cohort_all(spark, sf_dir):
    return S.get_cohort(aligned(spark, sf_dir), ["IID", "sex", "pheno"], keep_all=True)


FOREIGN = {"CHROM": P.chrom("p_partkey"), "POS": f"({P.VAR['POS']}) + case when p_partkey % 7 = 0 then 1000000 else 0 end", "REF": P.VAR["REF"], "ALT": "case when p_partkey % 11 = 0 then 'N' else " + P.VAR["ALT"] + " end", "gene": "p_brand"}


def foreign(spark, sf_dir):
    t = P.table(spark, sf_dir, "part").select(*P.exprs(FOREIGN))
    return t.withColumn("CHROM", F.concat(F.lit("chr"), "CHROM"))


FOREIGN_SQL = f', ext AS (SELECT {P._fields(FOREIGN)} FROM part)\n'
EXT = """SELECT v.VAR_id, 'chr' || e."CHROM" AS "CHROM", e."POS", e."REF", e."ALT", e.gene FROM ext e {} JOIN var v ON v."CHROM" = e."CHROM" AND v."POS" = e."POS" """


@query(VAR_SQL + FOREIGN_SQL + EXT.format("") + 'AND v."REF" = e."REF" AND v."ALT" = e."ALT"')
def remap_4key(spark, sf_dir):
    return S.remap(foreign(spark, sf_dir), P.variants(spark, sf_dir))


@query(VAR_SQL + FOREIGN_SQL + EXT.format("LEFT"))
def remap_2key_keep_unmapped(spark, sf_dir):
    return S.remap(foreign(spark, sf_dir), P.variants(spark, sf_dir), alleles=False, keep_unmapped=True)


@query(VAR_SQL + RANGES_SQL + f"SELECT v.VAR_id FROM var v JOIN ranges r ON {HIT}")
def extract_ranges(spark, sf_dir):
    return R.extract_ranges(P.variants(spark, sf_dir), P.ranges(spark, sf_dir))


@query(VAR_SQL + RANGES_SQL + f'SELECT v.VAR_id, range_id, r.start, r."end" FROM var v JOIN ranges r ON {HIT}')
def map_variants(spark, sf_dir):
    return R.map_variants(P.variants(spark, sf_dir), P.ranges(spark, sf_dir), ["range_id", "start", "end"], bin_width=64)


@query(VAR_SQL + 'SELECT VAR_id, "CHROM", "POS", ploidy FROM var')
def ploidy_nonpar(spark, sf_dir):
    return P.variants(spark, sf_dir).select("VAR_id", "CHROM", "POS", "ploidy")


UNITS_SQL = VAR_SQL + ', units AS (SELECT unit, min("CHROM") AS "CHROM", min("POS") AS start, min("POS") + 20 AS "end" FROM var GROUP BY unit)\n'


def units(spark, sf_dir):
    return P.variants(spark, sf_dir).groupBy("unit").agg(F.min("CHROM").alias("CHROM"), F.min("POS").alias("start"), (F.min("POS") + 20).alias("end"))


@query(
    UNITS_SQL
    + """, g AS (SELECT *, CASE WHEN lag("end") OVER w IS NULL OR start - lag("end") OVER w - 1 > 30 THEN 1 ELSE 0 END AS new FROM units WINDOW w AS (PARTITION BY "CHROM" ORDER BY start, "end", unit))
SELECT unit, "CHROM", start, "end", cast(sum(new) OVER (ORDER BY "CHROM", start, "end", unit) AS BIGINT) AS block FROM g"""
)
def cor_blocks(spark, sf_dir):
    return R.add_blocks(units(spark, sf_dir), max_dist=30)


EXON = "SELECT concat('T', cast(s_suppkey % 25 as string)) AS transcript_id, " + P.chrom("(s_suppkey % 25)") + ' AS "CHROM", cast(floor(s_suppkey / 25) as int) * 60 + s_suppkey % 7 + 1 AS start, cast(floor(s_suppkey / 25) as int) * 60 + s_suppkey % 7 + 25 AS "end", case when s_suppkey % 2 = 0 then \'+\' else \'-\' end AS strand0 FROM supplier WHERE s_suppkey <= 2000'


def exons(spark, sf_dir):
    s = P.table(spark, sf_dir, "supplier").where("s_suppkey <= 2000")
    e = s.selectExpr("concat('T', cast(s_suppkey % 25 as string)) as transcript_id", P.chrom("(s_suppkey % 25)") + " as CHROM", "cast(cast(floor(s_suppkey / 25) as int) * 60 + s_suppkey % 7 + 1 as int) as start", "cast(cast(floor(s_suppkey / 25) as int) * 60 + s_suppkey % 7 + 25 as int) as end")
    return e.withColumn("strand", F.when(F.substring("transcript_id", 2, 9).cast("int") % 2 == 0, "+").otherwise("-"))


@query(
    VAR_SQL
    + f""", exons AS (SELECT transcript_id, "CHROM", start, "end", CASE WHEN cast(substr(transcript_id, 2) AS INT) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM ({EXON})),
e AS (SELECT *, (SELECT coalesce(sum(b."end" - b.start + 1), 0) FROM exons b WHERE b.transcript_id = a.transcript_id AND b.start < a.start) AS before, (SELECT sum(b."end" - b.start + 1) FROM exons b WHERE b.transcript_id = a.transcript_id) AS total FROM exons a),
hit AS (SELECT v.VAR_id, e.*, v."POS" AS p, least(greatest(v."POS", e.start), e."end") AS pt FROM var v JOIN e ON v."CHROM" = e."CHROM" AND v."POS" BETWEEN e.start - 12 AND e."end" + 12),
best AS (SELECT *, row_number() OVER (PARTITION BY VAR_id, transcript_id ORDER BY abs(p - pt), start) AS k FROM hit)
SELECT VAR_id, transcript_id, "CHROM", pt AS "POS", cast(CASE WHEN strand = '-' THEN total - (before + pt - start + 1) + 1 ELSE before + pt - start + 1 END AS BIGINT) AS "cdsPOS", p <> pt AS padded FROM best WHERE k = 1"""
)
def cds_map(spark, sf_dir):
    return R.map_to_cds(P.variants(spark, sf_dir), exons(spark, sf_dir))


def store(spark, sf_dir):
    g = P.geno(spark, sf_dir)
    t = tables(spark, sf_dir)
    return S.Store.create(t["var"], g.samples.withColumn("sample_idx", F.col("IID")), g.stored).upload_anno("links", t["anno"]).upload_anno("info", t["info"])


@query(
    VAR_SQL
    + ANNO_SQL
    + """, kept AS (SELECT DISTINCT VAR_id FROM var JOIN info USING (VAR_id) WHERE p_size > 15)
SELECT 'var' AS part, count(*) AS n, cast(sum(VAR_id) AS BIGINT) AS ids FROM var SEMI JOIN kept USING (VAR_id) UNION ALL
SELECT 'dosage', count(*), cast(sum(VAR_id) AS BIGINT) FROM dosage SEMI JOIN kept USING (VAR_id) UNION ALL
SELECT 'anno', count(*), cast(sum(VAR_id) AS BIGINT) FROM anno SEMI JOIN kept USING (VAR_id)"""
)
def subset_store(spark, sf_dir):
    s = S.subset(store(spark, sf_dir), inner=["info"], where="p_size > 15")
    one = lambda part, df: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("VAR_id").alias("ids"))
    return one("var", s.var).unionByName(one("dosage", s.stored)).unionByName(one("anno", s.annos["links"]))


@query(
    VAR_SQL
    + """, src AS (SELECT *, CASE WHEN VAR_id % 2 = 0 THEN 0 ELSE 1 END AS src FROM var),
n AS (SELECT VAR_id AS old, row_number() OVER (ORDER BY src, VAR_id) AS "VAR_id" FROM src)
SELECT n."VAR_id", "CHROM", "POS", cast((SELECT count(*) FROM dosage d WHERE d.VAR_id = n.old) AS BIGINT) AS stored FROM n JOIN var v ON v.VAR_id = n.old"""
)
def concat_store(spark, sf_dir):
    from dataclasses import replace

    s = store(spark, sf_dir)
    half = lambda k: replace(s, var=s.var.where(f"VAR_id % 2 = {k}"), stored=s.stored.where(f"VAR_id % 2 = {k}"))
    both = S.concat([half(0), half(1)])
    n = both.stored.groupBy("VAR_id").agg(F.count("*").alias("stored"))
    return both.var.join(n, "VAR_id", "left").select("VAR_id", "CHROM", "POS", F.coalesce("stored", F.lit(0)).alias("stored"))


@query(VAR_SQL + ANNO_SQL + "SELECT unnest(['info', 'links']) AS name, unnest(['VAR_id,p_brand,p_size', 'VAR_id,s_suppkey,s_nationkey,s_acctbal']) AS columns")
def list_anno(spark, sf_dir):
    return store(spark, sf_dir).catalog(spark)
