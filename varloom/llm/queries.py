"""One query for each operator of this subpackage, and the SQL where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.report(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    return language.report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact

    return exact.report(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near

    return near.report(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.corpus_digests(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.rates(_table(spark, sf_dir, "documents"), mixing.domains_of_labels(_table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.report(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audit

    return audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_suffix_dedup, op3_language, op4_toxicity, op5_exact_dedup, op6_near_dedup, op7_bpe, op8_url_filter, op9_mixing, op10_warc, op11_ranked_search, op12_license_scan, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    from . import audit, lexical

    return {"op5_exact_dedup": OP5_SQL, "op11_ranked_search": lexical.SQL, "op13_filter_audit": audit.SQL}
