"""Tables that steps of an operator hand to the next one, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from . import geno as G


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or checkpoint directory; a local session without one gets a temporary folder, any other ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = named.get() if named.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def handed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: its lineage ends there, and a lost executor takes nothing of it along."""
    path = f"{folder(df.sparkSession)}/varloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.handed_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Delete a table of ``handed`` that nothing reads any more; other frames are left alone."""
    if path := getattr(df, "handed_path", None):
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def staged(geno: G.Geno) -> Iterator[G.Geno]:
    """``geno`` with its stored cells as a table, so that what is counted and what is summed don't derive them again; deleted at the end."""
    cells = handed(geno.stored, "cells")
    try:
        yield replace(geno, stored=cells)
    finally:
        drop(cells)


def burden(geno: G.Geno, members: DataFrame, model: str = "allelic", impute: str = "meanImpute", maf_weights: str = "none", **bounds) -> tuple[DataFrame, DataFrame]:
    """``geno.burden`` for results that read the scores several times: both its tables, made once, of variants counted once."""
    based = handed(G.burden_variants(geno, members, model, impute, maf_weights, **bounds), "variants")
    try:
        return tuple(handed(t, name) for t, name in zip(G.burden_sums(geno, members, based, model, maf_weights), ("units", "deviations"), strict=True))
    finally:
        drop(based)
