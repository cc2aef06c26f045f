"""Stores of aggregated scores: unit x sample in sparse form, with a manifest that other stores are checked against.

A store keeps, for each unit, the score of a sample without stored cells (by sex) and, for each sample with some, what they
add. Nothing of the size units x samples is ever made; only ``get_unit`` gives the dense scores of the units it is asked
for. On disk units lie in buckets of their CRC-32, so ``get_unit`` reads the buckets of its units only. Scores are rounded to
``digits`` significant digits when they are read.
"""

from __future__ import annotations

import json
import warnings
import zlib
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varloom.functions.expr import signif

from . import geno as G
from . import shared
from .sets import union

BUCKETS, DIGITS, VERSION = 64, 6, "0.1"


class AggError(ValueError):
    pass


def bucket_of(unit: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(unit, "UTF-8")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class AggStore:
    """``units``: unit, b0, b1, b2, nvar; ``dev``: unit, IID, dev; ``samples``: IID, sex, position. ``params`` and ``meta`` are compared by ``check_alike``."""

    units: DataFrame
    dev: DataFrame
    samples: DataFrame
    params: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    #: Whether ``units`` and ``dev`` have a bucket column to prune by.
    buckets: int | None = None

    @staticmethod
    def create(geno: G.Geno, members: DataFrame, store_meta: dict | None = None, **options) -> AggStore:
        """Aggregate genotypes to the units of ``members`` (unit, VAR_id, w); ``options`` are those of ``geno.burden`` and are kept as parameters."""
        from .store import number_rows

        per, dev = shared.burden(geno, members, **options)
        order = ["sample_idx", "IID"] if "sample_idx" in geno.samples.columns else ["IID"]
        samples = geno.samples.select(*dict.fromkeys(["IID", "sex", *order])).join(number_rows(geno.samples, order, "position"), order).select("IID", "sex", "position")
        source = store_meta or {}
        meta = {"version": VERSION, "id": source.get("id", ""), "genomeBuild": source.get("genomeBuild", ""), "creationDate": datetime.now(timezone.utc).isoformat()}
        return AggStore(per.select("unit", "b0", "b1", "b2", "nvar"), dev.select("unit", "IID", "dev"), samples, {k: list(v) if isinstance(v, tuple) else v for k, v in sorted(options.items())}, meta)

    def list_units(self) -> DataFrame:
        return self.units.select("unit")

    def list_samples(self) -> DataFrame:
        """IID in the order of the store."""
        return self.samples.orderBy("position").select("IID")

    def _some(self, units: list[str]) -> AggStore:
        asked = F.col("unit").isin(units)
        if self.buckets:
            asked = F.col("bucket").isin(sorted({zlib.crc32(u.encode()) % self.buckets for u in units})) & asked
        return replace(self, units=self.units.where(asked), dev=self.dev.where(asked))

    def get_unit(self, units: list[str], digits: int | None = DIGITS) -> DataFrame | None:
        """unit, IID, score of all samples; None if no unit is found, a warning if some aren't."""
        if not units or any(not isinstance(u, str) for u in units):
            raise AggError("get_unit needs names of units")
        own = self._some(list(dict.fromkeys(units)))
        found = own.units.select("unit").count()
        if found < len(set(units)):
            warnings.warn(f"{len(set(units)) - found} of {len(set(units))} units could not be found", stacklevel=2)
        if not found:
            return None
        score = G.scores(G.Geno(own.units, self.samples, self.dev), own.units.select("unit", "b0", "b1", "b2"), own.dev)
        return score.withColumn("score", signif(F.col("score"), digits)) if digits else score

    def collapse(self) -> DataFrame:
        """IID, aggregate: the sum of all units' scores of each sample."""
        return collapse([self])

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        for name, t in (("units", self.units.drop("bucket")), ("dev", self.dev.drop("bucket"))):
            # a bucket's rows in one file, sorted, so files tell the units that they hold; large buckets take several
            dealt = t.withColumn("bucket", bucket_of(F.col("unit"), buckets))
            spread = dealt.repartition(buckets, "bucket") if name == "units" else dealt.repartition(buckets * 4, "bucket", F.pmod(F.hash("IID"), F.lit(4)))
            spread.sortWithinPartitions("bucket", "unit").write.partitionBy("bucket").parquet(f"{path}/{name}")
        self.samples.write.parquet(f"{path}/samples")
        spark = self.samples.sparkSession
        rows = [("meta", k, str(v)) for k, v in self.meta.items()] + [("param", k, json.dumps(v)) for k, v in self.params.items()] + [("layout", "buckets", str(buckets))]
        spark.createDataFrame(rows, "kind string, name string, value string").coalesce(1).write.parquet(f"{path}/manifest")

    @staticmethod
    def open(spark: SparkSession, path: str) -> AggStore:
        rows = spark.read.parquet(f"{path}/manifest").collect()
        of = lambda kind: {r.name: r.value for r in rows if r.kind == kind}
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return AggStore(read("units"), read("dev"), read("samples"), {k: json.loads(v) for k, v in of("param").items()}, of("meta"), int(of("layout")["buckets"]))


def check_alike(stores: list[AggStore], check_duplicates: bool = True) -> None:
    """AggError unless the stores have the same samples in the same order, parameters, version, source and build, and no unit twice."""
    first = stores[0]
    if check_duplicates:
        twice = union([s.list_units() for s in stores]).groupBy("unit").count().where("count > 1").orderBy("unit").limit(5).collect()
        if twice:
            raise AggError(f"units are in several stores: {', '.join(r.unit for r in twice)}")
    for s in stores[1:]:
        if s.params != first.params:
            raise AggError("the stores were made with different parameters")
        for key, what in (("version", "versions"), ("id", "variant stores"), ("genomeBuild", "genome builds")):
            if s.meta.get(key) != first.meta.get(key):
                raise AggError(f"the stores come from different {what}")
        a, b = first.samples.select("IID", "position"), s.samples.select("IID", "position")
        if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
            raise AggError("the stores have different samples, or another order of them")


def merge(stores: list[AggStore]) -> AggStore:
    """All units of stores that are alike."""
    if len(stores) < 2:
        raise AggError("merge needs two stores or more")
    check_alike(stores)
    plain = lambda t: t.drop("bucket")
    meta = {**stores[0].meta, "creationDate": datetime.now(timezone.utc).isoformat()}
    return AggStore(union([plain(s.units) for s in stores]), union([plain(s.dev) for s in stores]), stores[0].samples, stores[0].params, meta)


def collapse(stores: list[AggStore]) -> DataFrame:
    """IID, aggregate: the sum of all units of all stores, by the sums of baselines and of what is added; units may be in several stores."""
    check_alike(stores, check_duplicates=False)
    base = union([s.units.select("b0", "b1", "b2") for s in stores]).agg(*(F.coalesce(F.sum(f"b{k}"), F.lit(0.0)).alias(f"b{k}") for k in G.SEXES)).first()
    added = union([s.dev.select("IID", "dev") for s in stores]).groupBy("IID").agg(F.sum("dev").alias("dev"))
    own = reduce(lambda out, k: F.when(F.col("sex") == k, float(base[f"b{k}"])).otherwise(out), (1, 2), F.lit(float(base.b0)))
    return stores[0].samples.join(added, "IID", "left").select("IID", (own + F.coalesce("dev", F.lit(0.0))).alias("aggregate"))
