"""A corpus pipeline of five operators of ``varloom.llm``; it counts as part of that subpackage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. It reads ``docs`` as its predecessor left them,
written and read again: operators number rows by their place in those files. All stages but the last return the
columns of ``docs`` as they are. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import bpe, exact, mixing, near, toxicity
from varloom.llm._common import stage_table

#: Shares of the domains that are left after the first stage.
MIX = {"good": 0.88, "poor": 0.12}

#: Words of a shingle of the near_dedup stage; ``op6_near_dedup`` has its own number.
SHINGLE = 5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays."""
    return exact.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near.drop_near(docs, SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or dropped as their rates say."""
    domains = mixing.domains_of_labels(_labels(spark, sf_dir)).where("domain <> 'toxic'")
    return mixing.mix(docs, domains, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.corpus_digests(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("mixing", mix), ("bpe", encode)]
#: Trained models decide, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, f"stage-{name}")
    return docs
