"""VCF text to variants and sparse genotypes, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varloom.operators.store import number_rows

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
#: Genotype codes and what they count; N is missing.
CODES = {"0/0": "0", "0|0": "0", "0/1": "1", "1/0": "1", "0|1": "1", "1|0": "1", "1/1": "2", "1|1": "2", "./.": "N", ".|.": "N", "./0": "0", "./1": "1", ".|1": "1", ".:0": "N", "0": "0", "1": "1", "2": "2"}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain or gzip-compressed VCF, with a number that grows along the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value"))


def header(lines: DataFrame) -> list[str]:
    """Sample names, from the first #CHROM line."""
    got = lines.where(F.col("value").startswith("#CHROM")).orderBy("line").limit(1).collect()
    if not got:
        raise ValueError("no #CHROM line")
    names = got[0]["value"].split("\t")[9:]
    if not names:
        raise ValueError("no samples in the header")
    return names


def samples(spark: SparkSession, names: list[str]) -> DataFrame:
    """IID, sex (unknown: 0) and place of the samples."""
    return spark.createDataFrame([(n, 0, i) for i, n in enumerate(names)], "IID string, sex int, sample_idx int")


def records(lines: DataFrame) -> DataFrame:
    """Fixed fields and the array of sample texts of each record."""
    f = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select("line", F.split("value", "\t").alias("f"))
    return f.select("line", *((F.col("f")[i].cast("int") if c == "POS" else F.col("f")[i]).alias(c) for i, c in enumerate(FIXED)), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("texts"))


def split_alleles(recs: DataFrame, keep_missing: bool = False) -> DataFrame:
    """A record for each alternative allele: its carriers have 1 for it and 0 for any other; texts without alternative alleles stay.

    With ``keep_missing`` ploidies other than two are split too and missing parts stay missing.
    """
    out = recs.select("line", "texts", *FIXED, F.size(F.split("ALT", ",")).alias("n"), F.posexplode(F.split("ALT", ",")).alias("k", "one"))
    own = (F.col("k") + 1).cast("string")

    def recode(t: Column) -> Column:
        gt = F.regexp_extract(t, r"^[^:]*", 0) if keep_missing else F.substring(t, 1, 3)
        alleles = F.split(gt, r"[/|]")
        sep = F.when(F.contains(gt, F.lit("|")), "|").otherwise("/")
        swap = lambda a: F.when((a == ".") & F.lit(keep_missing), a).when(a == own, "1").otherwise("0")
        joined = F.concat(F.array_join(F.transform(alleles, swap), "\x01"), F.lit(""))
        joined = F.concat(F.replace(joined, F.lit("\x01"), sep), F.substring(t, F.length(gt) + 1, 1 << 30) if keep_missing else F.lit(""))
        plain = gt.isin("0/0", "0|0", "./.", ".|.", "./0", "0/.", ".|0", "0|.", ".") if not keep_missing else ~gt.rlike("[1-9]")
        return F.when(plain, t).otherwise(joined)

    texts = F.when(F.col("n") > 1, F.transform("texts", recode)).otherwise(F.col("texts"))
    return out.select("line", "k", *(F.col("one").alias("ALT") if c == "ALT" else F.col(c) for c in FIXED), texts.alias("texts"))


def dosage(text: Column) -> Column:
    """0, 1 or 2 of a genotype text, null if missing; an unknown code is an error."""
    code = F.substring(text, 1, 3)
    known = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    got = F.try_element_at(known, code)
    return F.when(got == "N", F.lit(None)).when(got.isNotNull(), got.try_cast("tinyint")).otherwise(F.raise_error(F.concat(F.lit("unknown genotype: "), code)).cast("tinyint"))


def build(spark: SparkSession, path: str | list[str], build_name: str = "GRCh38"):
    """A store of VCF files: every allele a variant, numbered along the file; only cells other than 0 are stored."""
    from varloom.operators.store import Store, number_rows

    lines = read_lines(spark, path)
    names = header(lines)
    recs = split_alleles(records(lines))
    ids = number_rows(recs.select("line", "k"), ["line", "k"], "VAR_id")
    recs = recs.join(ids, ["line", "k"])
    var = recs.select(F.col("VAR_id").cast("long").alias("VAR_id"), *FIXED, F.lit(0).alias("g0"))
    cell = recs.select(F.col("VAR_id").cast("long").alias("VAR_id"), F.posexplode("texts").alias("sample_idx", "text")).withColumn("gt", dosage(F.col("text")).cast("int")).where("gt is null or gt > 0")
    s = samples(spark, names)
    return Store.create(var, s, cell.join(s.select("IID", "sample_idx"), "sample_idx").select("VAR_id", "IID", "gt"), build_name)


def info_ids(lines: DataFrame) -> list[str]:
    """Declared INFO fields."""
    got = lines.where(F.col("value").startswith("##INFO=")).select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("id")).distinct().orderBy("id").collect()
    return [r["id"] for r in got]


def info_table(lines: DataFrame, split_multiallelic: bool = True, fields: list[str] | None = None) -> DataFrame:
    """Fixed columns and a column for each declared INFO field: NA where a record lacks it, its own name for flags."""
    fields = fields if fields is not None else info_ids(lines)
    recs = records(lines)
    if split_multiallelic:
        recs = recs.withColumn("ALT", F.explode(F.split("ALT", ",")))
    parts = F.transform(F.split("INFO", ";"), lambda p: F.split(p, "=", 2))
    pairs = F.map_from_entries(F.transform(F.array_distinct(F.transform(parts, lambda p: p[0])), lambda k: F.struct(k, F.element_at(F.filter(parts, lambda p: p[0] == k), 1))))
    recs = recs.withColumn("_i", pairs)
    value = lambda f: F.when(F.try_element_at("_i", F.lit(f)).isNull(), "NA").when(F.size(F.try_element_at("_i", F.lit(f))) > 1, F.try_element_at("_i", F.lit(f))[1]).otherwise(F.lit(f))
    return recs.select(*FIXED[:7], *(value(f).alias(f) for f in fields))


def undeclared(lines: DataFrame) -> list[str]:
    """INFO fields that records use without a declaration."""
    used = records(lines).select(F.explode(F.split("INFO", ";")).alias("p")).select(F.split("p", "=")[0].alias("id")).where("id <> '.'").distinct()
    return sorted({r["id"] for r in used.collect()} - set(info_ids(lines)))


def lines_of(geno, site_only: bool = False, use_var_id: bool = False) -> DataFrame:
    """(CHROM, POS, VAR_id, value): VCF lines of the variants, genotypes in sample order."""
    v = geno.variants
    ids = F.col("VAR_id").cast("string") if use_var_id else F.coalesce("ID", F.lit("."))
    fixed = ["CHROM", "POS", ids, "REF", "ALT", F.coalesce("QUAL", F.lit(".")), F.coalesce("FILTER", F.lit(".")), F.lit(".")]
    if site_only:
        return v.select("CHROM", "POS", "VAR_id", F.concat_ws("\t", *fixed).alias("value"))
    order = number_rows(geno.samples.select("sample_idx", "IID"), ["sample_idx", "IID"], "place").select("IID", F.col("place").cast("int").alias("place"))
    n = geno.samples.count()
    text = lambda g: F.when(g.isNull(), "./.").when(g == 0, "0/0").when(g == 1, "0/1").otherwise("1/1")
    cells = geno.stored.join(order, "IID").groupBy("VAR_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("\t"), text(F.col("gt"))).alias("t")))).alias("cells"))
    got = v.join(cells, "VAR_id", "left").withColumns({"cells": F.coalesce("cells", F.array().cast("array<struct<place:int,t:string>>")), "base": F.concat(F.lit("\t"), text(F.col("g0")))})
    # runs of the baseline's text between one stored cell and the next, so the work is that of writing the line
    before = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at("cells", i)["place"])
    runs = F.transform("cells", lambda c, i: F.concat(F.repeat("base", c["place"] - before(i) - 1), c["t"]))
    last = F.when(F.size("cells") == 0, 0).otherwise(F.try_element_at("cells", F.lit(-1))["place"])
    return got.select("CHROM", "POS", "VAR_id", F.concat(F.concat_ws("\t", *fixed, F.lit("GT")), F.array_join(runs, ""), F.repeat("base", F.lit(n) - last)).alias("value"))


def header_lines(geno, site_only: bool = False) -> list[str]:
    head = "\t".join(FIXED[:8])
    if not site_only:
        head += "\tFORMAT\t" + "\t".join(str(r["IID"]) for r in geno.samples.orderBy("sample_idx").select("IID").collect())
    return ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#" + head]


def write(geno, path: str, site_only: bool = False, compression: str | None = None) -> None:
    """VCF part files in order of position; the header is a part of its own and comes first."""
    spark = geno.variants.sparkSession
    body = lines_of(geno, site_only).orderBy("CHROM", "POS", "VAR_id").select("value")
    options = {"compression": compression} if compression else {}
    spark.createDataFrame([(x,) for x in header_lines(geno, site_only)], "value string").coalesce(1).write.options(**options).text(f"{path}/header")
    body.write.options(**options).text(f"{path}/records")
