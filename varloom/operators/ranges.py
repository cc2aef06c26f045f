"""Interval operators: overlap joins, ploidy, blocks, coding positions. Intervals are closed and 1-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Regions of X and Y outside the pseudo-autosomal ones, by genome build.
NONPAR_HG19 = (("X", 1, 60000), ("X", 2699521, 154931043), ("X", 155260561, 155270560), ("Y", 1, 10000), ("Y", 2649521, 59034049), ("Y", 59363567, 59373566))
NONPAR_HG38 = (("X", 1, 10000), ("X", 2781480, 155701383), ("X", 156030896, 156040895), ("Y", 1, 10000), ("Y", 2781480, 56887902), ("Y", 57217416, 57227415))
NONPAR = {"hg19": NONPAR_HG19, "GRCh37": NONPAR_HG19, "hg38": NONPAR_HG38, "GRCh38": NONPAR_HG38}
BIN = 1 << 14


def norm_chrom(c: Column) -> Column:
    """Chromosome names without ``chr``, in capitals; 23, 24, 26 and M by their letters."""
    c = F.regexp_replace(F.upper(c.cast("string")), "^CHR", "")
    return F.when(c == "23", "X").when(c == "24", "Y").when(c.isin("26", "M"), "MT").otherwise(c)


def chrom_number(c: Column) -> Column:
    """1 to 22, X 23, Y 24, MT 26; null for other contigs."""
    c = norm_chrom(c)
    return F.when(c == "X", 23).when(c == "Y", 24).when(c == "MT", 26).otherwise(c.try_cast("int"))


def overlap(left: DataFrame, right: DataFrame, bin_width: int | None = None, pad: Column | int = 0) -> DataFrame:
    """Pairs of rows whose intervals (CHROM, start, end) overlap; columns of ``right`` come as ``r_<name>``.

    Both sides are dealt to position bins, so the join has an equality key beyond the chromosome and no side needs to
    fit in memory. A pair that shares several bins is reported in the first one only, so nothing has to be deduplicated
    and pairs stay as often as rows repeat.
    """
    width = bin_width or BIN
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))).alias("bin")
    lo, hi = F.col("r_start") - pad, F.col("r_end") + pad
    x = left.where("start <= end").select("*", bins(F.col("start"), F.col("end")))
    y = r.where("r_start <= r_end").select("*", bins(lo, hi)).withColumnRenamed("bin", "r_bin")
    first = F.floor(F.greatest(F.col("start"), lo) / width) == F.col("bin")
    return x.join(y, (x.CHROM == y.r_CHROM) & (x.bin == y.r_bin) & (x.start <= hi) & (x.end >= lo) & first).drop("bin", "r_bin")


def spans(var: DataFrame) -> DataFrame:
    """Variants with the interval of their reference allele."""
    return var.withColumn("start", F.col("POS")).withColumn("end", F.col("POS") + F.length("REF") - 1)


def extract_ranges(var: DataFrame, ranges: DataFrame, bin_width: int | None = None) -> DataFrame:
    """VAR_id of each variant and range that overlap, as often as they do."""
    side = ranges.select(norm_chrom(F.col("CHROM")).alias("CHROM"), "start", "end")
    own = spans(var).select("VAR_id", norm_chrom(F.col("CHROM")).alias("CHROM"), "start", "end")
    return overlap(own, side, bin_width).select("VAR_id")


def map_variants(var: DataFrame, features: DataFrame, fields: list[str], bin_width: int | None = None) -> DataFrame:
    """VAR_id and the chosen fields of each feature that a variant overlaps."""
    side = features.select(norm_chrom(F.col("CHROM")).alias("CHROM"), "start", "end", *(c for c in fields if c not in ("CHROM", "start", "end")))
    own = spans(var).select("VAR_id", norm_chrom(F.col("CHROM")).alias("CHROM"), "start", "end")
    return overlap(own, side, bin_width).select("VAR_id", *(F.col(f"r_{c}").alias(c) for c in fields))


def assign_ploidy(var: DataFrame, regions: DataFrame) -> DataFrame:
    """``var`` with ploidy: XnonPAR, YnonPAR or diploid. The regions are a handful of rows of a fixed table."""
    r = F.broadcast(regions.select(F.col("CHROM").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")))
    hit = (norm_chrom(F.col("CHROM")) == F.col("_c")) & (F.col("POS") <= F.col("_e")) & (F.col("POS") + F.length("REF") - 1 >= F.col("_s"))
    sure = var.join(r.select("_c", "_s", "_e"), hit, "left")
    one = sure.withColumn("ploidy", F.when(F.col("_c").isNotNull(), F.concat("_c", F.lit("nonPAR"))).otherwise("diploid")).drop("_c", "_s", "_e")
    return one


def add_blocks(units: DataFrame, max_dist: float = 2.5e6) -> DataFrame:
    """Units (unit, CHROM, start, end) with a block number: a new block begins where the gap to the one before is over ``max_dist``."""
    by = Window.partitionBy("CHROM").orderBy("start", "end", "unit")
    gap = F.col("start") - F.lag("end").over(by) - 1
    marked = units.withColumn("new", F.when(F.lag("end").over(by).isNull() | (gap > max_dist), 1).otherwise(0))
    marked = marked.withColumn("local", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # chromosomes are few: the number of earlier blocks is a table of one row each
    each = marked.groupBy("CHROM").agg(F.max("local").alias("n"))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("CHROM").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return marked.join(before.select("CHROM", "before"), "CHROM").select(*units.columns, (F.col("local") + F.col("before")).alias("block"))


def map_to_cds(var: DataFrame, exons: DataFrame, padding: int = 12) -> DataFrame:
    """Coding position of variants (VAR_id, CHROM, POS) in exons (transcript_id, CHROM, start, end, strand).

    A variant up to ``padding`` outside an exon counts at the exon's nearest end. The position is the one within the
    joined exons, from the far end on the minus strand.
    """
    up = Window.partitionBy("transcript_id").orderBy("start")
    width = F.col("end") - F.col("start") + 1
    e = exons.withColumn("before", F.coalesce(F.sum(width).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.withColumn("total", F.sum(width).over(Window.partitionBy("transcript_id")))
    e = e.select("transcript_id", norm_chrom(F.col("CHROM")).alias("CHROM"), "start", "end", "strand", "before", "total")
    points = var.select("VAR_id", norm_chrom(F.col("CHROM")).alias("CHROM"), "POS", F.col("POS").alias("start"), F.col("POS").alias("end"))
    got = overlap(points, e, pad=padding)
    at = F.least(F.greatest("POS", "r_start"), "r_end")
    place = F.col("r_before") + at - F.col("r_start") + 1
    got = got.withColumn("cdsPOS", F.when(F.col("r_strand") == "-", F.col("r_total") - place + 1).otherwise(place))
    # a variant within the padding of two exons counts at the nearer one
    near = Window.partitionBy("VAR_id", "r_transcript_id").orderBy(F.abs(F.col("POS") - at), "r_start")
    got = got.withColumn("rank", F.row_number().over(near)).where("rank = 1")
    return got.select("VAR_id", F.col("r_transcript_id").alias("transcript_id"), "CHROM", at.alias("POS"), "cdsPOS", (F.col("POS") != at).alias("padded"))
