"""Permutation tests of burden scores: the residuals of a null model are permuted, and all permutations are summed in one pass.

A permutation table (perm_id, position, sample) comes from hashes (``assoc.resampling_table``), from a file
(``from_file``), or from the user; samples count from 1 in the order of IID. Every sample gets its permuted
residuals as arrays of ``WIDTH`` permutations each. A unit's score statistic under WIDTH permutations is then WIDTH sums over its
stored cells, plus the closed form of the baselines; a row of (unit, IID) is read once for each block of
permutations, never once for each permutation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import geno as G
from .score import NullModel, _score_sums, _statistics
from .shared import handed
from .store import number_rows

#: Permutations that a row carries.
WIDTH = 32
#: Two statistics closer than this, relatively, are equal: they are the same sum in another order.
EQUAL = 1e-9


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """perm_id, position, sample of a resampling file."""
    from varloom.sources.files import read_permutations

    return read_permutations(spark, path).select("perm_id", F.posexplode("order").alias("p", "sample")).select("perm_id", (F.col("p") + 1).alias("position"), "sample")


def check_permutations(perms: DataFrame, n: int) -> int:
    """The number of permutations; ValueError unless each holds every position and sample from 1 to n once."""
    each = perms.groupBy("perm_id").agg(F.count("*").alias("c"), F.count_distinct("position").alias("p"), F.count_distinct("sample").alias("s"), F.least(F.min("position"), F.min("sample")).alias("lo"), F.greatest(F.max("position"), F.max("sample")).alias("hi"))
    got = each.agg(F.count("*").alias("times"), F.count_if((F.col("c") != n) | (F.col("p") != n) | (F.col("s") != n) | (F.col("lo") != 1) | (F.col("hi") != n)).alias("odd")).first()
    if not got.times or got.odd:
        raise ValueError(f"{got.odd} of {got.times} permutations aren't orders of the {n} samples of the null model")
    return got.times


def permuted_residuals(model: NullModel, perms: DataFrame) -> DataFrame:
    """IID, sex, block, perm (ids of its permutations), rp (their residuals at this sample)."""
    return moved_residuals(model.samples, perms)


def moved_residuals(samples: DataFrame, perms: DataFrame) -> DataFrame:
    """``permuted_residuals`` of samples (IID, sex, r)."""
    own = samples.select("IID", "sex", "r").join(number_rows(samples.select("IID"), ["IID"], "position"), "IID")
    numbers = number_rows(perms.select("perm_id").distinct(), ["perm_id"], "k")
    moved = perms.select("perm_id", "position", "sample").join(own.select(F.col("position").alias("sample"), "r"), "sample").join(own.select("position", "IID", "sex"), "position").join(numbers, "perm_id")
    rows = F.sort_array(F.collect_list(F.struct("k", "perm_id", "r")))  # at most WIDTH
    blocks = moved.groupBy("IID", "sex", F.floor((F.col("k") - 1) / WIDTH).alias("block")).agg(rows.alias("rows"))
    return blocks.select("IID", "sex", "block", F.transform("rows", lambda x: x["perm_id"]).alias("perm"), F.transform("rows", lambda x: x["r"]).alias("rp"))


def drawn(spark: SparkSession, n: int, times: int, seed: int) -> DataFrame:
    """perm_id, position, sample: the orders of ``assoc.permutations``, by sorting the same random numbers, each drawn where it is needed."""

    def draw(frames):
        for f in frames:
            ids = f["id"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, np.diff(ids) != 1, True])
            value = np.empty(len(ids))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # a batch is one run of numbers, or few
                rng = np.random.default_rng(seed)
                rng.bit_generator.advance(int(ids[a]))
                value[a:b] = rng.random(b - a)
            yield pd.DataFrame({"perm_id": ids // n + 1, "value": value, "sample": ids % n + 1})

    rows = spark.range(n * times).mapInPandas(draw, "perm_id long, value double, sample long")
    placed = number_rows(rows, ["perm_id", "value", "sample"], "place")
    return placed.select("perm_id", (F.col("place") - (F.col("perm_id") - 1) * n).alias("position"), "sample")


def variant_scores(variants: DataFrame, cells: DataFrame, samples: DataFrame, times: int, seed: int) -> DataFrame:
    """VAR_id, permuted: each variant's scores of residuals in the orders of ``drawn``.

    ``variants``: VAR_id, fill, b0, b1, b2; ``cells``: VAR_id, IID, sex, gt; ``samples``: IID, sex, r. Nothing of the samples' number is in one task.
    """
    spark = samples.sparkSession
    blocks = handed(moved_residuals(samples, drawn(spark, samples.count(), times, seed)), "residuals")
    at = lambda k: F.coalesce(F.try_element_at("rp", F.lit(k + 1)), F.lit(0.0))
    totals = blocks.groupBy("block").agg(F.max(F.size("rp")).alias("size"), *(F.array(*(F.sum(F.when(F.col("sex") == s, at(k)).otherwise(0.0)) for k in range(WIDTH))).alias(f"t{s}") for s in G.SEXES))
    base = F.when(F.col("sex") == 1, F.col("b1")).when(F.col("sex") == 2, F.col("b2")).otherwise(F.col("b0"))
    dev = cells.join(variants, "VAR_id").select("VAR_id", "IID", (F.coalesce(F.col("gt").cast("double"), "fill") - base).alias("dev"))
    added = dev.join(blocks.select("IID", "block", "rp"), "IID").groupBy("VAR_id", "block").agg(F.array(*(F.sum(F.col("dev") * at(k)) for k in range(WIDTH))).alias("added"))
    every = variants.crossJoin(F.broadcast(totals)).join(added, ["VAR_id", "block"], "left")
    one = lambda k: F.col("b0") * F.element_at("t0", k) + F.col("b1") * F.element_at("t1", k) + F.col("b2") * F.element_at("t2", k) + F.coalesce(F.try_element_at("added", k), F.lit(0.0))
    each = every.select("VAR_id", "block", F.transform(F.sequence(F.lit(1), F.col("size")), one).alias("permuted"))
    return each.groupBy("VAR_id").agg(F.sort_array(F.collect_list(F.struct("block", "permuted"))).alias("_b")).select("VAR_id", F.flatten("_b.permuted").alias("permuted"))


def statistics(per: DataFrame, dev: DataFrame, model: NullModel, perms: DataFrame, key: str = "unit") -> DataFrame:
    """key, U and D (observed), block, perm, permuted (array of the permutations' U) of every unit that has stored cells.

    ``per``: key and the baselines b0, b1, b2; ``dev``: key, IID and what the sample's stored cells add (``geno.burden``).
    """
    blocks = permuted_residuals(model, perms)
    at = lambda k: F.coalesce(F.try_element_at("rp", F.lit(k + 1)), F.lit(0.0))
    # three rows for each block of permutations
    totals = blocks.groupBy("block").agg(F.max("perm").alias("perm"), *(F.array(*(F.sum(F.when(F.col("sex") == s, at(k)).otherwise(0.0)) for k in range(WIDTH))).alias(f"t{s}") for s in G.SEXES))
    sums = dev.select(key, "IID", "dev").join(blocks.select("IID", "block", "rp"), "IID").groupBy(key, "block").agg(F.array(*(F.sum(F.col("dev") * at(k)) for k in range(WIDTH))).alias("added"))
    observed = _statistics(_score_sums(per, dev, key, model), model).select(key, "U", "D", "A", "positive", "b0", "b1", "b2")
    got = sums.join(totals, "block").join(observed, key)
    base = lambda k: sum((F.col(f"b{s}") * F.element_at(f"t{s}", k) for s in G.SEXES[1:]), F.col("b0") * F.element_at("t0", k))
    each = F.transform(F.sequence(F.lit(1), F.size("perm")), lambda k: base(k) + F.element_at("added", k))
    return got.select(key, "U", "D", "A", "positive", "block", "perm", each.alias("permuted"))


def permutation_tests(per: DataFrame, dev: DataFrame, model: NullModel, perms: DataFrame, key: str = "unit") -> DataFrame:
    """key, nResampling, U, P: the share of permutations with a statistic further from 0, one added above and below.

    P is null where fewer than two samples have a score above 0, or the covariates leave nothing of it.
    """
    times = check_permutations(perms, model.n)
    beyond = F.size(F.filter("permuted", lambda u: F.abs(u) > F.abs(F.col("U")) * (1 + EQUAL)))
    each = statistics(per, dev, model, perms, key).withColumn("beyond", beyond)
    able = (F.max("positive") >= 2) & (F.max("D") > 1e-9 * F.max("A"))
    return each.groupBy(key).agg(F.max("U").alias("U"), F.when(able, (F.sum("beyond") + 1) / (times + 1)).alias("P")).select(key, F.lit(times).alias("nResampling"), "U", "P")


def permutation_results(per: DataFrame, dev: DataFrame, model: NullModel, perms: DataFrame, key: str = "unit") -> DataFrame:
    """key, perm_id, U: the statistic of every permutation; what ``permutation_tests`` counts."""
    check_permutations(perms, model.n)
    each = statistics(per, dev, model, perms, key)
    return each.select(key, F.inline(F.arrays_zip(F.col("perm").alias("perm_id"), F.col("permuted").alias("U"))))


def top_permutations(results: DataFrame, n: int, key: str = "unit") -> DataFrame:
    """The n permutations furthest from 0 of each unit, ties to the smaller perm_id."""
    by = Window.partitionBy(key).orderBy(F.desc(F.abs("U")), "perm_id")
    return results.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
