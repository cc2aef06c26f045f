"""Annotation and cohort tables of a variant store: look-ups, uploads, remapping, subsets and unions."""

from __future__ import annotations

import re
import secrets
import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .geno import Geno
from .ranges import NONPAR, assign_ploidy, extract_ranges, norm_chrom

#: Variants of a range on disk, and ranges that a look-up names one by one; more are read as a whole.
SPAN, MOST_PARTS = 1 << 16, 4096
#: Fixed value: table names that uploads can't take.
PROTECTED = ("var", "var_ranges", "SM", "dosage", "anno", "cohort", "meta", "tmp")


class StoreError(ValueError):
    pass


def check_name(name: str, taken=(), overwrite: bool = False) -> str:
    """A table name of letters, digits and underscores that isn't protected or taken."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise StoreError(f"table names have letters, digits and underscores only: {name!r}")
    if name in PROTECTED:
        raise StoreError(f"{name!r} is a protected table name")
    if name in taken and not overwrite:
        raise StoreError(f"table {name!r} exists; set overwrite")
    return name


def get_anno(tables: dict[str, DataFrame], table: str, fields: str | list[str] = "*", left=(), inner=(), var_ids: DataFrame | None = None, where: str | None = None) -> DataFrame:
    """Fields of a table, left- and then inner-joined with others on VAR_id, for some variants and an SQL condition.

    Columns that several tables have come with the table's name in front, but for the first table's.
    """
    out = tables[table]
    for name, how in [*((t, "left") for t in left), *((t, "inner") for t in inner)]:
        other = tables[name]
        twice = {c for c in other.columns if c != "VAR_id" and c in out.columns}
        out = out.join(other.select(*(F.col(c).alias(f"{name}_{c}" if c in twice else c) for c in other.columns)), "VAR_id", how)
    if var_ids is not None:
        out = out.join(var_ids.select("VAR_id").distinct(), "VAR_id", "left_semi")
    if where:
        out = out.where(where)
    return out if fields == "*" else out.selectExpr(*([fields] if isinstance(fields, str) else fields))


def get_cohort(cohort: DataFrame, fields: str | list[str] = "*", keep_all: bool = False) -> DataFrame:
    """A cohort table; rows without IID only with ``keep_all``."""
    out = cohort if keep_all else cohort.where("IID is not null")
    return out if fields == "*" else out.select(*([fields] if isinstance(fields, str) else fields))


def remap(table: DataFrame, var: DataFrame, alleles: bool = True, keep_unmapped: bool = False) -> DataFrame:
    """``table`` by CHROM, POS (and REF, ALT) with the VAR_id of the store; its own VAR_id, if any, is replaced."""
    keys = ["POS", "REF", "ALT"] if alleles else ["POS"]
    side = var.select(F.col("VAR_id"), norm_chrom(F.col("CHROM")).alias("_chrom"), *(F.col(k).alias(f"_{k}") for k in keys))
    own = table.drop("VAR_id")
    on = (norm_chrom(own["CHROM"]) == side["_chrom"]) & reduce(lambda a, b: a & b, [own[k] == side[f"_{k}"] for k in keys])
    return own.join(side, on, "left" if keep_unmapped else "inner").select("VAR_id", *own.columns)


def validate_cohort(cohort: DataFrame) -> DataFrame:
    """A cohort with unique IIDs and sex 0, 1 or 2 (anything else is 0)."""
    gone = {"IID", "sex"} - set(cohort.columns)
    if gone:
        raise StoreError(f"a cohort needs IID and sex; missing: {sorted(gone)}")
    if cohort.where("IID is not null").groupBy("IID").count().where("count > 1").limit(1).count():
        raise StoreError("duplicate IIDs in the cohort")
    sex = F.col("sex").cast("string").try_cast("double")
    return cohort.withColumn("sex", F.when(sex.isin(1.0, 2.0), sex.cast("int")).otherwise(0))


def align_cohort(samples: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row for each sample of the store, in its order, with the cohort's columns; null IID for samples that the cohort lacks."""
    own = cohort.withColumn("_iid", F.col("IID"))
    key = samples.select(F.col("IID").alias("_sm"), *(["sample_idx"] if "sample_idx" in samples.columns else []))
    return key.join(own, key["_sm"] == own["_iid"], "left").drop("_sm", "_iid")


@dataclass(frozen=True)
class Store:
    """var (VAR_id, CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO, FORMAT, g0), samples (IID, sex, sample_idx), stored (VAR_id, IID, gt), and named tables."""

    var: DataFrame
    samples: DataFrame
    stored: DataFrame
    annos: dict[str, DataFrame] = field(default_factory=dict)
    cohorts: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)
    #: ``stored`` as it lies on disk, with the number of its range of variants (``part``), if this store was opened.
    ranged: DataFrame | None = None

    @staticmethod
    def create(var: DataFrame, samples: DataFrame, stored: DataFrame, build: str = "GRCh38") -> Store:
        return Store(var, samples, stored, meta={"version": "0.1", "id": secrets.token_hex(14), "genomeBuild": build, "creationDate": datetime.now(timezone.utc).isoformat()})

    def tables(self) -> dict[str, DataFrame]:
        return {"var": self.var, "SM": self.samples, **self.annos, **self.cohorts}

    def catalog(self, spark: SparkSession, kind: str = "anno") -> DataFrame:
        """Names and columns of the annotation or cohort tables."""
        rows = [(n, ",".join(t.columns)) for n, t in sorted((self.annos if kind == "anno" else self.cohorts).items())]
        return spark.createDataFrame(rows, "name string, columns string")

    def upload_anno(self, name: str, table: DataFrame, skip_remap: bool = False, ignore_alleles: bool = False, keep_unmapped: bool = False, overwrite: bool = False) -> Store:
        check_name(name, self.annos, overwrite)
        if name in self.cohorts:
            raise StoreError(f"{name!r} is a cohort")
        mapped = table if skip_remap or ("VAR_id" in table.columns and not {"CHROM", "POS"} <= set(table.columns)) else remap(table, self.var, not ignore_alleles, keep_unmapped)
        if "VAR_id" not in mapped.columns:
            raise StoreError("an annotation needs VAR_id, or CHROM, POS, REF and ALT")
        return replace(self, annos={**self.annos, name: mapped})

    def upload_cohort(self, name: str, table: DataFrame, overwrite: bool = False) -> Store:
        check_name(name, self.cohorts, overwrite)
        if name in self.annos:
            raise StoreError(f"{name!r} is an annotation")
        return replace(self, cohorts={**self.cohorts, name: align_cohort(self.samples, validate_cohort(table))})

    def drop_table(self, name: str) -> Store:
        if name in PROTECTED or name not in {**self.annos, **self.cohorts}:
            raise StoreError(f"no table to drop: {name!r}")
        return replace(self, annos={k: v for k, v in self.annos.items() if k != name}, cohorts={k: v for k, v in self.cohorts.items() if k != name})

    def get_anno(self, table: str, ranges: DataFrame | None = None, var_ids: DataFrame | None = None, **more) -> DataFrame:
        if ranges is not None:
            hit = extract_ranges(self.var, ranges)
            var_ids = hit if var_ids is None else hit.join(var_ids, "VAR_id", "left_semi")
        return get_anno(self.tables(), table, var_ids=var_ids, **more)

    def geno(self, var_ids: DataFrame | None = None, cohort: str | DataFrame = "SM", weights: DataFrame | None = None, anno: DataFrame | None = None) -> Geno:
        """Genotypes of some variants and the samples of a cohort, with ploidy, weights and annotation at the variants."""
        own = self.samples if cohort == "SM" else (self.cohorts[cohort] if isinstance(cohort, str) else cohort).where("IID is not null")
        var = self.var if var_ids is None else self.var.join(var_ids.select("VAR_id").distinct(), "VAR_id", "left_semi")
        if anno is not None:
            if anno.groupBy("VAR_id").count().where("count > 1").limit(1).count():
                raise StoreError("the annotation has a VAR_id more than once")
            if {"ploidy", "w", "AF"} & set(anno.columns):
                raise StoreError("ploidy, w and AF are protected fields")
            var = var.join(anno, "VAR_id", "left")
        if weights is not None:
            var = var.join(weights.select("VAR_id", "w"), "VAR_id", "left")
        spark = self.var.sparkSession
        build = self.meta.get("genomeBuild", "GRCh38")
        if "ploidy" not in var.columns:
            regions = spark.createDataFrame(list(NONPAR.get(build, ())), "CHROM string, start int, end int")
            var = assign_ploidy(var, regions)
        return Geno(var, own, self._stored(var, var_ids is not None).join(var.select("VAR_id"), "VAR_id", "left_semi").join(own.select("IID"), "IID", "left_semi"))

    def _stored(self, var: DataFrame, some: bool) -> DataFrame:
        """Stored genotypes; of ``some`` variants, only the ranges on disk that hold any of them."""
        if not some or self.ranged is None:
            return self.stored
        span = int(self.meta["span"])
        parts = [r[0] for r in var.select(F.floor(F.col("VAR_id") / span).cast("int").alias("p")).distinct().limit(MOST_PARTS + 1).collect()]
        return (self.ranged.where(F.col("part").isin(sorted(parts))) if len(parts) <= MOST_PARTS else self.ranged).select("VAR_id", "IID", "gt")

    def get_gt(self, var_set: DataFrame | None = None, var_ids: DataFrame | None = None, ranges: DataFrame | None = None, cohort: str | DataFrame = "SM", anno: DataFrame | None = None) -> Geno:
        """Genotypes of the variants of a set (VAR_id, w), of ids, or in ranges: exactly one of them. Warns of variants that the store lacks.

        A set's weights come along; sets of several units or names may name a variant more than once only with the same weight.
        """
        if sum(x is not None for x in (var_set, var_ids, ranges)) != 1:
            raise StoreError("name exactly one of var_set, var_ids and ranges")
        weights = None
        if var_set is not None:
            weights = var_set.select("VAR_id", "w").distinct()
            if weights.groupBy("VAR_id").count().where("count > 1").limit(1).count():
                raise StoreError("the set has a variant with several weights")
        ids = (extract_ranges(self.var, ranges) if ranges is not None else var_set if var_set is not None else var_ids).select("VAR_id").distinct()
        if ranges is None and (gone := ids.join(self.var, "VAR_id", "left_anti").count()):
            warnings.warn(f"{gone} variants are not in the store", stacklevel=2)
        return self.geno(ids, cohort, weights, anno)

    def save(self, path: str) -> None:
        self.var.write.partitionBy("CHROM").parquet(f"{path}/var")
        part = F.floor(F.col("VAR_id") / SPAN).cast("int")
        # sorted, so that the statistics of files tell which variants they hold; a range of variants is a folder
        ranged = self.stored.select("VAR_id", "IID", "gt").withColumn("part", part).repartitionByRange("VAR_id", "IID").sortWithinPartitions("VAR_id", "IID")
        ranged.write.partitionBy("part").parquet(f"{path}/dosage")
        for name, t in {"SM": self.samples, **{f"anno/{k}": v for k, v in self.annos.items()}, **{f"cohort/{k}": v for k, v in self.cohorts.items()}}.items():
            t.write.parquet(f"{path}/{name}")
        spark = self.var.sparkSession
        names = [("anno", n) for n in self.annos] + [("cohort", n) for n in self.cohorts]
        spark.createDataFrame([("meta", k, v) for k, v in {**self.meta, "span": str(SPAN)}.items()] + [(k, n, "") for k, n in names], "kind string, name string, value string").coalesce(1).write.parquet(f"{path}/catalog")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        rows = spark.read.parquet(f"{path}/catalog").collect()
        read = lambda p: spark.read.parquet(f"{path}/{p}")
        dosage = read("dosage")
        return Store(read("var").withColumn("CHROM", F.col("CHROM").cast("string")), read("SM"), dosage.drop("part"), {r.name: read(f"anno/{r.name}") for r in rows if r.kind == "anno"}, {r.name: read(f"cohort/{r.name}") for r in rows if r.kind == "cohort"}, {r.name: r.value for r in rows if r.kind == "meta"}, dosage if "part" in dosage.columns else None)


def subset(store: Store, var_ids: DataFrame | None = None, inner=(), where: str | None = None, tables: list[str] | None = None) -> Store:
    """The variants that joins with annotations and a condition leave, with their genotypes and annotations; cohorts stay whole."""
    ids = get_anno(store.tables(), "var", inner=inner, var_ids=var_ids, where=where).select("VAR_id").distinct()
    keep = lambda t: t.join(ids, "VAR_id", "left_semi")
    chosen = {k: v for k, v in store.annos.items() if tables is None or k in tables}
    return replace(store, var=keep(store.var), stored=keep(store.stored), annos={k: keep(v) for k, v in chosen.items()}, ranged=None, cohorts={k: v for k, v in store.cohorts.items() if tables is None or k in tables})


def concat(stores: list[Store]) -> Store:
    """The union of stores of the same samples and build; variants are numbered anew, store by store."""
    if len(stores) < 2:
        raise StoreError("concat needs two stores or more")
    first = stores[0]
    if len({s.meta.get("genomeBuild") for s in stores}) > 1:
        raise StoreError("the stores have different genome builds")
    for s in stores[1:]:
        a, b = first.samples.select("IID", "sample_idx"), s.samples.select("IID", "sample_idx")
        if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
            raise StoreError("the stores have different samples")
    var = reduce(DataFrame.unionByName, [s.var.withColumn("_src", F.lit(k)) for k, s in enumerate(stores)])
    ids = number_rows(var.select("_src", "VAR_id"), ["_src", "VAR_id"], "_new")
    stored = reduce(DataFrame.unionByName, [s.stored.withColumn("_src", F.lit(k)) for k, s in enumerate(stores)])
    renumber = lambda t: t.join(ids, ["_src", "VAR_id"]).withColumn("VAR_id", F.col("_new")).drop("_src", "_new")
    return Store.create(renumber(var), first.samples, renumber(stored), first.meta.get("genomeBuild", ""))


def number_rows(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Rows numbered from 1 in an order, without a single task for all: numbers within ranges, shifted by the sizes of earlier ones."""
    from pyspark.sql import Window

    ranged = df.select(*order).orderBy(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order)
    local = ranged.withColumn("_k", F.row_number().over(inside))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row for each range: at most as many as shuffle partitions
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(before), "_part").select(*order, (F.col("_k") + F.col("_b")).alias(into))
