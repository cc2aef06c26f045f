"""Delimited tables, BED, GTF, set files, GMT, and result files with a header of metadata."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.operators.results import KINDS, as_result, column_type, kind_of
from varloom.operators.sets import num_text, packed, unpack


def read_table(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """A delimited table with a header; types are inferred unless a schema is given. NA is null."""
    r = spark.read.option("sep", sep).option("header", True).option("nullValue", "NA")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_ranges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Closed intervals of a delimited table with CHROM, start and end, and whatever other columns it has."""
    df = read_table(spark, path, sep)
    if gone := {"CHROM", "start", "end"} - set(df.columns):
        raise ValueError(f"ranges need CHROM, start and end; missing: {sorted(gone)}")
    return df.withColumns({"CHROM": F.col("CHROM").cast("string"), "start": F.col("start").cast("int"), "end": F.col("end").cast("int")})


def read_bed(spark: SparkSession, path: str, extra: list[str] = ()) -> DataFrame:
    """BED intervals as closed 1-based ones; further columns by name, as text."""
    f = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    return f.select(F.col("f")[0].alias("CHROM"), (F.col("f")[1].cast("int") + 1).alias("start"), F.col("f")[2].cast("int").alias("end"), *(F.try_element_at("f", F.lit(i + 4)).alias(c) for i, c in enumerate(extra)))


def read_gtf(spark: SparkSession, path: str, attributes: list[str] = ("gene_id", "transcript_id", "gene_name", "gene_biotype", "transcript_biotype")) -> DataFrame:
    """GTF or GFF features: CHROM, source, type, start, end, strand and the named attributes."""
    f = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    attr = lambda a: F.nullif(F.regexp_extract(F.col("f")[8], rf'(?:^|;\s*){re.escape(a)}(?:\s+"?|=)([^";]+)', 1), F.lit(""))
    return f.select(F.col("f")[0].alias("CHROM"), F.col("f")[1].alias("source"), F.col("f")[2].alias("type"), F.col("f")[3].cast("int").alias("start"), F.col("f")[4].cast("int").alias("end"), F.col("f")[6].alias("strand"), *(attr(a).alias(a) for a in attributes))


def read_varsets(spark: SparkSession, path: str) -> DataFrame:
    """Long variant sets of unit|ids|weights|name lines; lines beginning with # are metadata."""
    f = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", r"\|").alias("f"))
    return unpack(f.select(F.col("f")[0].alias("unit"), F.col("f")[1].alias("VAR_id"), F.col("f")[2].alias("w"), F.col("f")[3].alias("varSetName")))


def write_varsets(sets: DataFrame, path: str, compression: str = "gzip") -> None:
    packed(sets).select(F.concat_ws("|", "unit", "VAR_id", "w", "varSetName").alias("value")).write.option("compression", compression).text(path)


def read_genesets(spark: SparkSession, path: str) -> DataFrame:
    """Long gene sets of name|units|weights|metadata lines."""
    f = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", r"\|").alias("f"))
    pair = F.explode(F.arrays_zip(F.split(F.col("f")[1], ",").alias("u"), F.split(F.col("f")[2], ",").alias("w"))).alias("x")
    return f.select(F.col("f")[0].alias("geneSetName"), pair, F.col("f")[3].alias("metadata")).select("geneSetName", F.col("x.u").alias("unit"), F.col("x.w").try_cast("double").alias("w"), "metadata")


def write_genesets(sets: DataFrame, path: str, compression: str = "gzip") -> None:
    rows = F.array_sort(F.collect_list(F.struct("unit", F.coalesce("w", F.lit(1.0)).alias("w"))))
    one = sets.groupBy("geneSetName").agg(rows.alias("r"), F.first("metadata").alias("metadata") if "metadata" in sets.columns else F.lit("").alias("metadata"))
    units, weights = F.array_join(F.transform("r", lambda x: x["unit"]), ","), F.array_join(F.transform("r", lambda x: num_text(x["w"])), ",")
    one.select(F.concat_ws("|", "geneSetName", units, weights, F.coalesce("metadata", F.lit(""))).alias("value")).write.option("compression", compression).text(path)


def read_gmt(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Gene sets of a GMT file (name, description, genes)."""
    f = spark.read.text(path).where(F.length("value") > 0).select(F.split("value", re.escape(sep)).alias("f"))
    return f.select(F.col("f")[0].alias("geneSetName"), F.explode(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))).alias("unit"), F.col("f")[1].alias("metadata")).where("unit <> ''").select("geneSetName", "unit", F.lit(1.0).alias("w"), "metadata")


def write_result(df: DataFrame, path: str, metadata: dict[str, str] | None = None, kind: str | None = None) -> None:
    """A tab-separated result with a header of metadata in a part of its own. Text columns are written as they are, null as NA, empty text quoted.

    What ``rvb``, ``singlevar``, ``score_variants`` and the gene-set tests return gets the columns of its kind that it lacks (``results.as_result``).
    """
    df = as_result(df, kind)
    kind = kind or kind_of(df.columns)
    spark = df.sparkSession
    head = [f"# type: {kind}", *(f"# {k}: {v}" for k, v in (metadata or {}).items())]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.text(f"{path}/header")
    df.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(f"{path}/rows")


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, str, dict[str, str]]:
    """A result, its kind, and its metadata. The kind is inferred from the columns where the header doesn't name it."""
    head = dict(re.match(r"# ([^:]+): (.*)", r["value"]).groups() for r in spark.read.text(f"{path}/header").collect())
    df = read_table(spark, f"{path}/rows")
    kind = head.pop("type", None) or kind_of(df.columns)
    if kind not in KINDS:
        raise ValueError(f"no such kind of result: {kind}")
    return df.withColumns({c: F.col(c).cast(column_type(c)) for c in KINDS[kind] if c in df.columns}), kind, head


def write_permutations(perms: DataFrame, path: str, n: int, times: int) -> None:
    """Permutations (perm_id, position, sample), one line each, with a header of three lines in a part of its own."""
    spark = perms.sparkSession
    spark.createDataFrame([("# method: residuals",), (f"# nSamples: {n}",), (f"# nResampling: {times}",)], "value string").coalesce(1).write.text(f"{path}/header")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "sample"))), lambda x: x["sample"].cast("string")), "\t")
    perms.groupBy("perm_id").agg(line.alias("v")).select(F.concat_ws("\t", F.col("perm_id").cast("string"), "v").alias("value")).write.text(f"{path}/rows")


def read_permutations(spark: SparkSession, path: str) -> DataFrame:
    """(perm_id, order): an array of sample numbers for each permutation."""
    f = spark.read.text(f"{path}/rows").select(F.split("value", "\t").alias("f"))
    return f.select(F.col("f")[0].cast("long").alias("perm_id"), F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.cast("int")).alias("order"))
