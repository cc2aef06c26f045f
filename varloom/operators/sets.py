"""Variant sets and gene sets, as long tables. The comma-packed text form exists only at the edge of files (``sources.files``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def build_varset(tables: dict[str, DataFrame], unit_table: str, unit: str, name: str, inner=(), where: str | None = None, weight: str = "1") -> DataFrame:
    """(unit, varSetName, VAR_id, w): distinct unit, variant and weight of a table after joins and a condition. The weight is any SQL expression."""
    from .store import get_anno

    got = get_anno(tables, unit_table, inner=inner, where=where)
    return got.select(F.col(unit).cast("string").alias("unit"), F.lit(name).alias("varSetName"), "VAR_id", F.expr(weight).cast("double").alias("w")).distinct()


def is_mask(df: DataFrame, fields: list[str]) -> dict[str, bool]:
    """Fields that hold only 0, 1 and null are masks; the others are weights."""
    odd = df.agg(*(F.max(F.when(F.col(f).isNotNull() & ~F.col(f).cast("double").isin(0.0, 1.0), 1).otherwise(0)).alias(f) for f in fields)).first()
    return {f: odd[f] == 0 for f in fields}


def build_varset_from_fields(df: DataFrame, unit: str, fields: list[str]) -> DataFrame:
    """A set for each field: masks keep variants of value 1 with weight 1, weight fields those that have one."""
    masks = is_mask(df, fields)
    long = df.select(F.col(unit).cast("string").alias("unit"), "VAR_id", *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(["unit", "VAR_id"], fields, "varSetName", "w")
    mask = F.col("varSetName").isin([f for f, m in masks.items() if m]) if any(masks.values()) else F.lit(False)
    return long.where("w is not null").where(~mask | (F.col("w") == 1)).select("unit", "varSetName", "VAR_id", "w")


def packed(sets: DataFrame) -> DataFrame:
    """unit, varSetName, VAR_id and w as comma-separated text, by VAR_id; a missing weight is a dot."""
    rows = F.array_sort(F.collect_list(F.struct("VAR_id", "w")))
    text = lambda c: F.array_join(F.transform("rows", lambda r: F.coalesce(num_text(r["w"]) if c == "w" else r[c].cast("string"), F.lit("."))), ",")
    return sets.groupBy("unit", "varSetName").agg(rows.alias("rows")).select("unit", "varSetName", text("VAR_id").alias("VAR_id"), text("w").alias("w"))


def num_text(x: Column) -> Column:
    """A number as text, whole numbers without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def unpack(text: DataFrame) -> DataFrame:
    """The long form of packed sets."""
    pair = F.explode(F.arrays_zip(F.split("VAR_id", ",").alias("v"), F.split("w", ",").alias("w"))).alias("x")
    return text.select("unit", "varSetName", pair).select("unit", "varSetName", F.col("x.v").cast("long").alias("VAR_id"), F.col("x.w").try_cast("double").alias("w"))


def chunked(var_ids: DataFrame, size: int) -> DataFrame:
    """Variants in chunks of ``size`` by VAR_id: units chunk1, chunk2, ..."""
    from .store import number_rows

    n = number_rows(var_ids.select("VAR_id").distinct(), ["VAR_id"], "n")
    return n.select(F.concat(F.lit("chunk"), F.ceil(F.col("n") / size).cast("string")).alias("unit"), F.lit("none").alias("varSetName"), "VAR_id", F.lit(1.0).alias("w"))


def collapse(sets: DataFrame) -> DataFrame:
    """All variants of each unit's sets once, with weight 1."""
    return sets.select("unit", "VAR_id").distinct().withColumn("w", F.lit(1.0))


def set_ranges(sets: DataFrame, var: DataFrame, where: str | None = None, keep_missing: bool = False) -> DataFrame:
    """CHROM, start and end of each set; sets on several chromosomes have a row for each. ``keep_missing``: sets none of whose variants is there have nulls.

    A table that has a variant of the sets more than once is an error with ``keep_missing``.
    """
    v = var.where(where) if where else var
    own = sets.select("unit", "varSetName", "VAR_id").distinct()
    if keep_missing and v.join(own, "VAR_id", "left_semi").groupBy("VAR_id").count().where("count > 1").limit(1).count():
        raise ValueError("the table has a variant more than once")
    got = own.join(v.select("VAR_id", "CHROM", "POS"), "VAR_id")
    if keep_missing:
        got = got.unionByName(own.select("unit", "varSetName").distinct().join(got, ["unit", "varSetName"], "left_anti"), allowMissingColumns=True)
    return got.groupBy("unit", "varSetName", "CHROM").agg(F.min("POS").alias("start"), F.max("POS").alias("end"))


def build_gene_set(source: DataFrame | dict[str, list[str]], spark=None) -> DataFrame:
    """geneSetName, unit, w, metadata of a mapping of names to units, or of a table whose 2 to 4 columns are these in order; weights are 1 unless given."""
    if isinstance(source, dict):
        rows = [(name, u) for name, own in source.items() for u in dict.fromkeys(own)]
        source = spark.createDataFrame(rows, "geneSetName string, unit string")
    if not 2 <= len(source.columns) <= 4:
        raise ValueError("gene sets have 2 to 4 columns: name, unit, weight, metadata")
    names = [F.col(f"`{c}`") for c in source.columns]
    weight = names[2].cast("double") if len(names) > 2 else F.lit(1.0)
    note = names[3].cast("string") if len(names) > 3 else F.lit("")
    return source.select(names[0].cast("string").alias("geneSetName"), names[1].cast("string").alias("unit"), weight.alias("w"), note.alias("metadata")).where("unit <> ''")


def drop_units(gene_sets: DataFrame, units: DataFrame) -> DataFrame:
    return gene_sets.join(units.select("unit").distinct(), "unit", "left_anti")


def sets_with(gene_sets: DataFrame, names: list[str] | None = None, units: DataFrame | None = None) -> DataFrame:
    """Whole sets by name, or that hold any of some units."""
    out = gene_sets.where(F.col("geneSetName").isin(names)) if names else gene_sets
    if units is not None:
        hit = out.join(units.select("unit"), "unit", "left_semi").select("geneSetName").distinct()
        out = out.join(hit, "geneSetName", "left_semi")
    return out


def remap_ids(gene_sets: DataFrame, dictionary: DataFrame, duplicates: str = "keep_all", targets: DataFrame | None = None) -> DataFrame:
    """Units replaced through (unit, new_unit). ``keep_first`` takes one new id for each unit: one that ``targets`` has, if any, then the smallest."""
    d = dictionary.select("unit", "new_unit").distinct()
    if duplicates == "keep_first":
        liked = d.join(targets.select(F.col("unit").alias("new_unit")).distinct().withColumn("liked", F.lit(1)), "new_unit", "left") if targets is not None else d.withColumn("liked", F.lit(1))
        by = Window.partitionBy("unit").orderBy(F.col("liked").desc_nulls_last(), "new_unit")
        d = liked.withColumn("k", F.row_number().over(by)).where("k = 1").select("unit", "new_unit")
    elif duplicates != "keep_all":
        raise ValueError(duplicates)
    rest = [c for c in gene_sets.columns if c != "unit"]
    return gene_sets.join(d, "unit").select(F.col("new_unit").alias("unit"), *rest).dropDuplicates(["geneSetName", "unit"])


def incidence(gene_sets: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, geneSetName) of the given units that are in sets: the sparse form of the unit by set matrix."""
    return gene_sets.select("unit", "geneSetName").distinct().join(units.select("unit").distinct(), "unit", "left_semi")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merge_scores(parts: list[DataFrame]) -> DataFrame:
    """The union of aggregate stores; a unit that two of them have is an error."""
    names = union([p.select("unit").distinct() for p in parts]).groupBy("unit").count().where("count > 1").limit(1)
    if names.count():
        raise ValueError("a unit is in several aggregate stores")
    return union(parts)


def collapse_scores(parts: list[DataFrame]) -> DataFrame:
    """Sum of all units' scores of each sample; missing ones count as 0."""
    return union([p.select("IID", "score") for p in parts]).groupBy("IID").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("aggregate"))
