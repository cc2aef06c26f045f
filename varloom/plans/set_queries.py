"""Queries on variant sets and gene sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import sets as S

from . import projection as P
from .anno_queries import ANNO_SQL, VAR_SQL, tables

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def varset(spark, sf_dir):
    return S.build_varset(tables(spark, sf_dir), "var", "unit", "lowsize", inner=["info"], where="p_size <= 25", weight="w")


VARSET_SQL = VAR_SQL + ANNO_SQL + ", vs AS (SELECT DISTINCT unit, 'lowsize' AS \"varSetName\", VAR_id, w FROM var JOIN info USING (VAR_id) WHERE p_size <= 25)\n"


@query(VARSET_SQL + 'SELECT unit, "varSetName", VAR_id, round(w, 6) + 0.0 AS w FROM vs')
def build_varset(spark, sf_dir):
    return varset(spark, sf_dir).withColumn("w", F.round("w", 6) + F.lit(0.0))


@query(VARSET_SQL + "SELECT unit, \"varSetName\", string_agg(cast(VAR_id AS VARCHAR), ',' ORDER BY VAR_id) AS VAR_id, string_agg('1', ',' ORDER BY VAR_id) AS w FROM vs GROUP BY 1, 2")
def varset_packed(spark, sf_dir):
    return S.packed(varset(spark, sf_dir).withColumn("w", F.lit(1.0)))


@query(VARSET_SQL + "SELECT unit, \"varSetName\", VAR_id, cast(VAR_id % 5 AS DOUBLE) AS w FROM vs")
def varset_unpacked(spark, sf_dir):
    return S.unpack(S.packed(varset(spark, sf_dir).withColumn("w", (F.col("VAR_id") % 5).cast("double"))))


FIELDS = {"small": "case when p_size <= 10 then 1 when p_size <= 40 then 0 end", "big": "case when p_size > 30 then 1 else 0 end", "price": "case when p_size % 2 = 0 then cast(p_size as double) * 2 end"}


@query(
    f"""WITH f AS (SELECT {P._fields({'unit': P.VAR['unit'], 'VAR_id': 'p_partkey', **FIELDS})} FROM part)
SELECT unit, 'small' AS "varSetName", VAR_id, 1.0::DOUBLE AS w FROM f WHERE small = 1 UNION ALL SELECT unit, 'big', VAR_id, 1.0 FROM f WHERE big = 1 UNION ALL SELECT unit, 'price', VAR_id, price FROM f WHERE price IS NOT NULL"""
)
def build_varset_pivot(spark, sf_dir):
    f = P.table(spark, sf_dir, "part").select(*P.exprs({"unit": P.VAR["unit"], "VAR_id": "p_partkey", **FIELDS}))
    return S.build_varset_from_fields(f, "unit", list(FIELDS))


@query(VARSET_SQL + "SELECT DISTINCT unit, VAR_id, 1.0::DOUBLE AS w FROM vs")
def collapse_varset(spark, sf_dir):
    v = varset(spark, sf_dir)
    return S.collapse(v.unionByName(v.withColumn("varSetName", F.lit("again"))))


@query(VARSET_SQL + 'SELECT unit, "varSetName", "CHROM", min("POS") AS start, max("POS") AS "end" FROM vs JOIN var USING (VAR_id, unit) WHERE "POS" > 20 GROUP BY 1, 2, 3')
def varset_ranges(spark, sf_dir):
    return S.set_ranges(varset(spark, sf_dir), P.variants(spark, sf_dir), where="POS > 20")


@query(VAR_SQL + "SELECT 'chunk' || cast(cast(ceil(row_number() OVER (ORDER BY VAR_id) / 64) AS BIGINT) AS VARCHAR) AS unit, 'none' AS \"varSetName\", VAR_id, 1.0::DOUBLE AS w FROM var")
def varset_chunks(spark, sf_dir):
    return S.chunked(P.variants(spark, sf_dir), 64)


#: Units of 20 parts each, so there are more with more parts; a set for every last digit of small sizes.
UNIT = "floor(p_partkey / 20)"


def units(spark, sf_dir):
    """unit, i of all parts."""
    i = P.table(spark, sf_dir, "part").select(F.expr(UNIT).cast("long").alias("i")).distinct()
    return i.select(F.concat(F.lit("U"), F.col("i").cast("string")).alias("unit"), "i")


def gene_sets(spark, sf_dir):
    p = P.table(spark, sf_dir, "part").where("p_size <= 10")
    name, i = F.concat(F.lit("S"), (F.col("p_size") % 10).cast("string")), F.expr(UNIT).cast("long").cast("string")
    return p.select(name.alias("geneSetName"), F.concat(F.lit("U"), i).alias("unit"), F.lit(1.0).alias("w")).distinct()


GENE_SQL = "gs AS (SELECT DISTINCT 'S' || cast(p_size % 10 AS VARCHAR) AS \"geneSetName\", 'U' || cast(p_partkey // 20 AS VARCHAR) AS unit, p_partkey // 20 AS i, 1.0::DOUBLE AS w FROM part WHERE p_size <= 10)\n"


@query("WITH " + GENE_SQL + "SELECT \"geneSetName\", unit FROM gs WHERE i % 3 <> 0")
def drop_units(spark, sf_dir):
    return S.drop_units(gene_sets(spark, sf_dir), units(spark, sf_dir).where("i % 3 = 0")).select("geneSetName", "unit")


@query("WITH " + GENE_SQL + "SELECT \"geneSetName\", unit FROM gs WHERE \"geneSetName\" IN (SELECT \"geneSetName\" FROM gs WHERE i % 40 = 7)")
def get_gene_set(spark, sf_dir):
    return S.sets_with(gene_sets(spark, sf_dir), units=units(spark, sf_dir).where("i % 40 = 7")).select("geneSetName", "unit")


@query("WITH " + GENE_SQL + "SELECT DISTINCT \"geneSetName\", 'N' || cast(i // 2 + d AS VARCHAR) AS unit FROM gs, (SELECT unnest([0, 1]) AS d) WHERE i % 5 <> 0")
def remap_ids_keep_all(spark, sf_dir):
    return S.remap_ids(gene_sets(spark, sf_dir), dictionary(spark, sf_dir)).select("geneSetName", "unit")


@query("WITH " + GENE_SQL + "SELECT DISTINCT \"geneSetName\", 'N' || CASE WHEN (i // 2 + 1) % 2 = 0 THEN cast(i // 2 + 1 AS VARCHAR) WHEN (i // 2) % 2 = 0 THEN cast(i // 2 AS VARCHAR) END AS unit FROM gs WHERE i % 5 <> 0")
def remap_ids_keep_first(spark, sf_dir):
    even = units(spark, sf_dir).where("i % 2 = 0").select(F.concat(F.lit("N"), F.col("i").cast("string")).alias("unit"))
    return S.remap_ids(gene_sets(spark, sf_dir), dictionary(spark, sf_dir), "keep_first", even).select("geneSetName", "unit")


def dictionary(spark, sf_dir):
    i = units(spark, sf_dir).where("i % 5 <> 0").select("unit", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    return i.select("unit", F.concat(F.lit("N"), (F.floor(F.col("i") / 2) + F.col("d")).cast("string")).alias("new_unit"))


@query("WITH " + GENE_SQL + "SELECT \"geneSetName\", unit FROM gs WHERE i % 2 = 0")
def map_to_matrix(spark, sf_dir):
    return S.incidence(gene_sets(spark, sf_dir), units(spark, sf_dir).where("i % 2 = 0")).select("geneSetName", "unit")


@query(VAR_SQL + "SELECT unit, count(*) AS n FROM var GROUP BY 1")
def list_units(spark, sf_dir):
    return P.variants(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"))
