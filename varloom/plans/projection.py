"""The star schema as a genetics study: parts are variants, customers are samples, line items are genotypes.

The SQL fragments here are evaluated by Spark for the queries and by DuckDB for their oracles. Two panels differ in
their samples: ``rare`` has all customers, ``common`` the first 150, to which orders are dealt by key modulo 150.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.operators.geno import Geno

COMMON = 150


def chrom(k: str) -> str:
    return f"case {k} % 24 when 22 then 'X' when 23 then 'Y' else cast({k} % 24 + 1 as string) end"


VAR = {
    "VAR_id": "p_partkey",
    "CHROM": chrom("p_partkey"),
    "POS": "cast(floor(p_partkey / 24) as int) * 100 + p_size",
    "REF": "concat(substr('ACGT', cast(p_partkey % 4 + 1 as int), 1), case when p_partkey % 3 = 0 then 'ACGT' else '' end)",
    "ALT": "substr('ACGT', cast((p_partkey % 4 + p_partkey % 3 + 1) % 4 + 1 as int), 1)",
    "w": "p_retailprice / 1000",
    "mask": "p_size <= 25",
    "unit": "concat('U', cast(p_partkey % 100 as string))",
    "g0": "case when p_partkey % 10 = 0 then 2 else 0 end",
}
SAMPLE = {
    "IID": "c_custkey",
    "sex": "cast(c_custkey % 3 as int)",
    "pheno": "case when c_acctbal > 4500 then 1 else 0 end",
    "qpheno": "c_acctbal",
    "superPop": "c_mktsegment",
    "PC1": "cast(c_nationkey as double)",
}
#: Regions of the synthetic coordinates outside the pseudo-autosomal ones.
NONPAR = (("X", 201, 10_000_000), ("Y", 401, 10_000_000))
RANGES = {
    "CHROM": chrom("k"),
    "start": "cast(((s * 5 + j) % 8) * 100 + (k * 7) % 50 + 1 as int)",
    "end": "cast(((s * 5 + j) % 8) * 100 + (k * 7) % 50 + 131 as int)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exprs(fields: dict[str, str]) -> list:
    return [F.expr(e).alias(c) for c, e in fields.items()]


def nonpar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NONPAR), "CHROM string, start int, end int")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.operators.ranges import assign_ploidy

    return assign_ploidy(table(spark, sf_dir, "part").select(*exprs(VAR)), nonpar(spark))


def samples(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return (c.where(f"c_custkey < {COMMON}") if panel == "common" else c).select(*exprs(SAMPLE))


def geno(spark: SparkSession, sf_dir: str, panel: str = "common") -> Geno:
    iid = f"o_custkey % {COMMON}" if panel == "common" else "o_custkey"
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    pairs = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    cell = pairs.groupBy(F.col("l_partkey").alias("VAR_id"), F.expr(iid).alias("IID")).agg(F.expr(GT).alias("gt"))
    stored = cell.select("VAR_id", "IID", F.expr("case when VAR_id % 10 = 0 then 2 - gt else gt end").alias("gt"))
    return Geno(variants(spark, sf_dir), samples(spark, sf_dir, panel), stored)


GT = "case when min(l_quantity) <= 3 then null when count(*) >= 2 or sum(l_quantity) >= 45 then 2 else 1 end"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j"))
    return s.withColumn("k", F.expr("s * 12 + j")).select(F.col("k").alias("range_id"), *exprs(RANGES))


def _fields(fields: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{c}"' for c, e in fields.items())


def sql(panel: str = "common", dense: bool = True) -> str:
    """WITH clause of the study in DuckDB. ``cells`` is dense: it checks the sparse arithmetic by counting every cell."""
    only = f" WHERE c_custkey < {COMMON}" if panel == "common" else ""
    iid = f"o_custkey % {COMMON}" if panel == "common" else "o_custkey"
    regions = " OR ".join(f"(CHROM = '{c}' AND POS <= {e} AND POS + length(REF) - 1 >= {s})" for c, s, e in NONPAR)
    out = f"""WITH var0 AS (SELECT {_fields(VAR)} FROM part),
var AS (SELECT *, CASE WHEN {regions} THEN CHROM || 'nonPAR' ELSE 'diploid' END AS ploidy FROM var0),
samples AS (SELECT {_fields(SAMPLE)} FROM customer{only}),
dosage0 AS (SELECT l_partkey AS VAR_id, {iid} AS IID, {GT} AS gt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
dosage AS (SELECT VAR_id, IID, CASE WHEN VAR_id % 10 = 0 THEN 2 - gt ELSE gt END AS gt FROM dosage0)"""
    if dense:
        out += """,
cells0 AS (SELECT v.VAR_id, v.ploidy, v.unit, v.w, v.CHROM, s.IID, s.sex, s.pheno, s.qpheno, s."superPop", CASE WHEN d.VAR_id IS NULL THEN v.g0 ELSE d.gt END AS raw
  FROM var v CROSS JOIN samples s LEFT JOIN dosage d ON d.VAR_id = v.VAR_id AND d.IID = s.IID),
cells AS (SELECT * EXCLUDE (raw), CASE WHEN ploidy = 'diploid' THEN raw
    WHEN sex = 1 THEN CASE WHEN raw > 1 THEN 1 ELSE raw END WHEN sex = 2 AND ploidy = 'XnonPAR' THEN raw END AS g FROM cells0),
af AS (SELECT VAR_id, CASE ploidy
    WHEN 'diploid' THEN avg(g) / 2
    WHEN 'XnonPAR' THEN (coalesce(sum(g) FILTER (WHERE sex = 1), 0) + coalesce(sum(g) FILTER (WHERE sex = 2), 0)) / nullif(count(g) FILTER (WHERE sex = 1) + 2 * count(g) FILTER (WHERE sex = 2), 0)
    ELSE avg(g) FILTER (WHERE sex = 1) END AS af0 FROM cells GROUP BY VAR_id, ploidy),
fcells AS (SELECT c.* EXCLUDE (g), af0, coalesce(af0 > 0.5, false) AS flipped,
    CASE WHEN af0 > 0.5 THEN (CASE WHEN sex = 1 AND ploidy <> 'diploid' THEN 1 - g ELSE 2 - g END) ELSE g END AS g
  FROM cells c JOIN af USING (VAR_id)),
faf AS (SELECT *, CASE WHEN flipped THEN 1 - af0 ELSE af0 END AS maf FROM (SELECT DISTINCT VAR_id, af0, coalesce(af0 > 0.5, false) AS flipped FROM af))"""
    return out + "\n"
