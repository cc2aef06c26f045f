"""Result tables: combination of P-values, top lists, inflation, and the data behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from varloom.functions.expr import acat_term_sql, cauchy_tail_sql, qnorm_sql

#: Fixed value: median of the chi-square distribution of one degree of freedom.
MEDIAN_CHISQ1 = 0.454936423119572
#: Columns that each kind of result begins with.
RVB = "unit cohort varSetName name pheno covar geneticModel MAFweight test nvar caseCarriers ctrlCarriers meanCaseScore meanCtrlScore caseN ctrlN caseCallRate ctrlCallRate effect effectSE effectCIlower effectCIupper OR P".split()
SINGLEVAR = "VAR_id cohort varSetName name pheno covar geneticModel test caseMAC ctrlMAC caseMAF ctrlMAF caseN ctrlN caseCallRate ctrlCallRate effectAllele otherAllele effect effectSE effectCIlower effectCIupper OR P".split()
GSA = "geneSetName test covar threshold geneSetSize genesObs effect effectSE effectCIlower effectCIupper P".split()
KINDS = {"rvbResult": RVB, "singlevarResult": SINGLEVAR, "gsaResult": GSA}
#: Contig lengths of chromosomes 1 to 22, X and Y by genome build.
LENGTHS_37 = (249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566)
LENGTHS_38 = (248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415)
LENGTHS = {"hg19": LENGTHS_37, "GRCh37": LENGTHS_37, "hg38": LENGTHS_38, "GRCh38": LENGTHS_38}


#: Columns of results that hold text, and whole numbers; all others hold numbers.
TEXT = {"unit", "cohort", "varSetName", "name", "pheno", "covar", "geneticModel", "MAFweight", "test", "effectAllele", "otherAllele", "geneSetName"}
WHOLE = {"VAR_id", "nvar", "caseCarriers", "ctrlCarriers", "caseN", "ctrlN", "geneSetSize", "genesObs"}


def column_type(name: str) -> str:
    return "string" if name in TEXT else "long" if name in WHOLE else "double"


def as_result(df: DataFrame, kind: str | None = None, **values: str) -> DataFrame:
    """``df`` as a result: the columns of its kind first and in order, with their types, then all others.

    The kind is that of its key (unit, VAR_id or geneSetName) unless it is named. Columns that it lacks are null, or have the given values.
    """
    keys = {"geneSetName": "gsaResult", "VAR_id": "singlevarResult", "unit": "rvbResult"}
    kind = kind or next((k for c, k in keys.items() if c in df.columns), None)
    if kind not in KINDS:
        raise ValueError(f"no kind of result has these columns: {df.columns}")
    first = [(F.lit(values[c]) if c in values else F.col(c) if c in df.columns else F.lit(None)).cast(column_type(c)).alias(c) for c in KINDS[kind]]
    return df.select(*first, *(F.col(c) for c in df.columns if c not in KINDS[kind]))


def kind_of(columns: list[str]) -> str:
    """The kind of result that has these columns."""
    found = [k for k, c in KINDS.items() if set(c) <= set(columns)]
    if len(found) != 1:
        raise ValueError(f"columns fit {found or 'no kind of result'}")
    return found[0]


def top_result(df: DataFrame, n: int = 10) -> DataFrame:
    """The n rows of smallest P; equal ones by the first column."""
    return df.orderBy(F.col("P").asc_nulls_last(), df.columns[0]).limit(n)


def fix_p(df: DataFrame, method: str = "minmax", max_p: float = 0.99, min_p: float = 1e-32, group: list[str] = ()) -> DataFrame:
    """P-values of exactly 0 and 1 replaced: by the smallest and largest others of the whole table, by fixed values, or 1 by 1 - 1/d with d the group's size."""
    if method == "manual":
        lo, hi = F.lit(min_p), F.lit(max_p)
    elif method == "minmax":
        ends = df.agg(F.min(F.when(F.col("P") > 0, F.col("P"))).alias("_lo"), F.max(F.when(F.col("P") < 1, F.col("P"))).alias("_hi"))
        df = df.crossJoin(F.broadcast(ends))  # one row
        lo, hi = F.col("_lo"), F.col("_hi")
    elif method == "Liu":
        df = df.withColumn("_n", F.count("P").over(Window.partitionBy(*group)))
        lo, hi = F.lit(min_p), 1 - 1 / F.col("_n")
    else:
        raise ValueError(method)
    return df.withColumn("P", F.when(F.col("P") == 0, lo).when(F.col("P") == 1, hi).otherwise(F.col("P"))).drop("_lo", "_hi", "_n")


def acat(df: DataFrame, aggregate: list[str | list[str]], group: list[str], fix: str | None = "minmax") -> DataFrame:
    """P-values combined by the Cauchy method, over the columns of each step in turn; those get the value ACAT. Null P-values don't count."""
    out, group = df.where("P is not null"), list(group)
    for step in aggregate:
        names = [step] if isinstance(step, str) else list(step)
        keep = [g for g in group if g not in names]
        if fix:
            out = fix_p(out, fix, group=keep)
        t = F.avg(F.expr(acat_term_sql("P"))).alias("T")
        out = out.groupBy(*keep).agg(t).select(*keep, *(F.lit("ACAT").alias(n) for n in group if n in names), F.expr(cauchy_tail_sql("T")).alias("P"))
    return out


def inflation(df: DataFrame, by: list[str] = (), case_n: int | None = None, ctrl_n: int | None = None) -> DataFrame:
    """lambda of the P-values, and lambda1000 where sample numbers are known."""
    z = F.expr(qnorm_sql("1 - P / 2"))
    out = df.where("P is not null").withColumn("chi", z * z).groupBy(*by).agg((F.percentile("chi", F.lit(0.5)) / MEDIAN_CHISQ1).alias("lambda"))
    return out.withColumn("lambda1000", 1 + (F.col("lambda") - 1) * (1 / case_n + 1 / ctrl_n) * 500) if case_n and ctrl_n else out


def qq_data(df: DataFrame, key: str) -> DataFrame:
    """Observed and expected -log10 P. Expectations are (i - 0.5) / n, not random draws, so results repeat."""
    from .store import number_rows

    some = df.where("P is not null")
    n = some.agg(F.count("*").alias("n"))
    ranked = number_rows(some.select("P", key), ["P", key], "i").crossJoin(F.broadcast(n))
    return ranked.select(key, (-F.log10("P")).alias("observed"), (-F.log10((F.col("i") - 0.5) / F.col("n"))).alias("expected"))


def contig_offsets(spark, lengths: list[tuple[str, int]]) -> DataFrame:
    """Contigs with the summed length of those before, in the order given; a table of a few rows."""
    total, rows = 0, []
    for c, n in lengths:
        rows.append((c, total, len(rows)))
        total += n
    return spark.createDataFrame(rows, "CHROM string, offset long, contig_order int")


def manhattan_data(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows (CHROM, POS or start and end, P) with a position along all contigs and a colour by turns."""
    pos = F.col("POS") if "POS" in df.columns else (F.col("start") + F.col("end")) / 2
    return df.join(F.broadcast(offsets), "CHROM").withColumn("x", pos + F.col("offset")).withColumn("colour", F.col("contig_order") % 2).withColumn("logP", -F.log10("P")).drop("offset", "contig_order")


def density_data(df: DataFrame, gene_set: DataFrame) -> DataFrame:
    """Z of each unit and whether the set has it."""
    inside = gene_set.select("unit").distinct().withColumn("in_geneset", F.lit(True))
    return df.join(inside, "unit", "left").select("unit", F.expr(qnorm_sql("1 - P")).alias("Z"), F.coalesce("in_geneset", F.lit(False)).alias("in_geneset"))


def merge_results(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    return df.join(other, by, "left")


def summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct values of fields, and the range of sample numbers, as (field, statistic, value)."""
    parts = [F.count_distinct(f).cast("double").alias(f"{f}:distinct") for f in fields]
    parts += [g(F.col(c).cast("double")).alias(f"{c}:{k}") for c in ("caseN", "ctrlN") if c in df.columns for k, g in (("min", F.min), ("max", F.max))]
    one = df.agg(*parts)
    long = one.unpivot([], one.columns, "key", "value")
    return long.select(F.split("key", ":")[0].alias("field"), F.split("key", ":")[1].alias("statistic"), "value")


def mutation_plot_data(points: DataFrame, exons: DataFrame, gap: int = 50) -> DataFrame:
    """Variants (VAR_id, POS, P, OR) of one transcript on a strip of its exons with gaps of fixed width between them.

    ``x`` is the place on the strip, ``side`` 1 above the line (OR of 1 or more) and -1 below, ``y`` side times -log10 P.
    """
    by = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # exons of one transcript
    e = exons.select("start", "end").withColumn("left", F.coalesce(F.sum(F.col("end") - F.col("start") + 1 + gap).over(by), F.lit(0)))
    got = points.join(F.broadcast(e), (points.POS >= e.start) & (points.POS <= e.end))
    side = F.when(F.col("OR") >= 1, 1).otherwise(-1)
    return got.select("VAR_id", (F.col("left") + F.col("POS") - F.col("start") + 1).alias("x"), side.alias("side"), (side * -F.log10("P")).alias("y"))


