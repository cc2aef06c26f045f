"""Variant sets on disk by unit: buckets of the units' CRC-32, so that a look-up reads the asked buckets only, and a side index of units and names."""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.operators.aggstore import bucket_of

BUCKETS = 64


def save_sets(sets: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write (unit, varSetName, VAR_id, w); a unit's rows are sorted in one file of its bucket."""
    dealt = sets.select("unit", "varSetName", "VAR_id", "w").withColumn("bucket", bucket_of(F.col("unit"), buckets))
    dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "unit", "varSetName", "VAR_id").write.partitionBy("bucket").parquet(f"{path}/sets")
    index = dealt.groupBy("unit", "varSetName", "bucket").agg(F.count("*").alias("n"))
    index.repartition(max(1, buckets // 16)).sortWithinPartitions("unit").write.parquet(f"{path}/index")
    sets.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


@dataclass(frozen=True)
class SetStore:
    sets: DataFrame
    index: DataFrame
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str) -> SetStore:
        return SetStore(spark.read.parquet(f"{path}/sets"), spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/layout").first().buckets)

    def list_units(self) -> DataFrame:
        return self.index.select("unit").distinct()

    def list_names(self) -> DataFrame:
        return self.index.select("varSetName").distinct()

    def sizes(self) -> DataFrame:
        """unit, varSetName, n: read from the index alone."""
        return self.index.select("unit", "varSetName", "n")

    def get(self, units: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
        """unit, varSetName, VAR_id, w of some units, names, or both. Warns of those that are absent; ValueError if neither is given."""
        return get_sets(self.sets, units, names, self.buckets, self.index)


def get_sets(sets: DataFrame, units: list[str] | None = None, names: list[str] | None = None, buckets: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """The sets of some units, names, or both, of a long table; with ``buckets`` only theirs are read."""
    if not units and not names:
        raise ValueError("name units, sets, or both")
    out = sets
    for column, asked in (("unit", units), ("varSetName", names)):
        if not asked:
            continue
        asked = list(dict.fromkeys(asked))
        there = (index if index is not None else sets).where(F.col(column).isin(asked)).select(column).distinct().count()
        if there < len(asked):
            warnings.warn(f"{len(asked) - there} of {len(asked)} values of {column} could not be found", stacklevel=3)
        if column == "unit" and buckets:
            out = out.where(F.col("bucket").isin(sorted({zlib.crc32(u.encode()) % buckets for u in asked})))
        out = out.where(F.col(column).isin(asked))
    return out.select("unit", "varSetName", "VAR_id", "w")
