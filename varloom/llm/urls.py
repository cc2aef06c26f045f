"""URL filter: host and path rules, and a character language-model ratio for the rest.

The rules judge the urls that they fit. They also label the training urls of two
smoothed variable-order Markov models over characters, one of accepted and one
of rejected urls. A url without a rule is accepted if the difference of the two
log-likelihoods per character reaches a threshold calibrated on labelled urls
that the models haven't seen.

The n-gram counts come from every labelled url: Spark adds them up by n-gram
hash bucket, so what reaches the driver is at most ``4 * ORDERS * BUCKETS``
numbers however many urls there are. Counts are pre-aggregated before they are
shuffled, so common n-grams don't gather in one task. The calibration uses a
score histogram of ``BINS`` bins for each label, also added up in Spark.

Defined results: a null url, or one without ``://``, has an empty host and
path and no rule; an empty text has ratio 0. Without labelled urls of both
kinds every ratio is 0 and the threshold 0, so the method accepts. Repeated rows
give repeated rows; other columns are not read. Urls of any length are scored whole, in pieces that share their contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The rules of the query, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDERS = 6
#: Characters that are scored or counted at once; longer urls are cut without loss.
SLICE = 1 << 16
BUCKETS = 1 << 16
BINS = 2001
SPAN = 5.0
BACKOFF = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or nulls."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _slices(urls: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """(number of the url, text, lead) in slices of at most twice ``SLICE`` characters. Texts end with a mark; a longer one is cut,
    and each later piece starts with the ``lead`` characters before it, the longest context there is."""
    own, size = [], 0
    for i, url in enumerate(urls):
        text = f"{url}\x03"
        for at in range(0, len(text), SLICE):
            lead = min(at, ORDERS - 1)
            own.append((i, text[at - lead : at + SLICE], lead))
            size += len(own[-1][1])
            if size >= SLICE:
                yield own
                own, size = [], 0
    if own:
        yield own


def _grams(pieces: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Url, and bucket of context and of context with character (positions x orders), for every character and the end, but for leads."""
    codes = np.frombuffer("".join(t for _, t, _ in pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for _, t, _ in pieces])
    starts = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(pieces)), lengths)
    place = np.arange(len(codes)) - starts[piece]
    context = np.zeros((len(codes), ORDERS), np.uint64)
    h = np.full(len(codes), 17, np.uint64)
    for n in range(1, ORDERS):
        back = np.arange(len(codes)) - n
        c = np.where(place >= n, codes[np.maximum(back, 0)], 2)
        h = (h ^ (c + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        context[:, n] = h
    seen = (context ^ (codes[:, None] + np.uint64(977))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.arange(ORDERS, dtype=np.int64) * BUCKETS
    pick = lambda x: ((x ^ (x >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int64) + order
    own = place >= np.array([lead for *_, lead in pieces])[piece]
    return np.array([i for i, *_ in pieces])[piece][own], pick(context * np.uint64(0x94D049BB133111EB))[own], pick(seen)[own]


def _count(frames, spark_label: str = "label"):
    for f in frames:
        for label, own in f.groupby(spark_label):
            for pieces in _slices(own.url.tolist()):
                _, context, seen = _grams(pieces)
                for kind, x in enumerate((context, seen)):
                    cells, n = np.unique(x, return_counts=True)
                    yield pd.DataFrame({"cell": cells + (2 * int(label) + kind) * ORDERS * BUCKETS, "n": n})


class Models:
    """Counts by bucket of both models; interpolated from order 0 up, each order as far as its context has been seen."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float32)

    def ratio(self, urls: list[str]) -> np.ndarray:
        """log p(accepted model) - log p(rejected model), per character."""
        out = np.zeros(len(urls))
        for pieces in _slices(urls):
            row, context, seen = _grams(pieces)
            logs = []
            for c in self.counts:
                p = np.full(len(row), 1 / 256)
                for n in range(ORDERS):
                    p = (c[1][seen[:, n]] + BACKOFF * p) / (np.maximum(c[0][context[:, n]], c[1][seen[:, n]]) + BACKOFF)
                logs.append(np.bincount(row, np.log(p), len(urls)))
            out += logs[1] - logs[0]
        return out / np.array([len(u) + 1 for u in urls])


def fit(labelled: DataFrame) -> Models | None:
    """Models of a table (url, label: 1 accepted, 0 rejected); None without both labels."""
    cells = labelled.select("url", "label").mapInPandas(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toPandas()
    counts = np.zeros(4 * ORDERS * BUCKETS)
    counts[got.cell.to_numpy(np.int64)] = got.n.to_numpy()
    counts = counts.reshape(2, 2, ORDERS * BUCKETS)
    return Models(counts) if counts[0].any() and counts[1].any() else None


def ratios(url: Column, shared) -> Column:
    @F.pandas_udf("double")
    def of(urls: pd.Series) -> pd.Series:
        models: Models | None = shared.value
        texts = [u or "" for u in urls]
        return pd.Series(models.ratio(texts) if models is not None and texts else np.zeros(len(texts)))

    return of(url)


def calibrate(scored: DataFrame) -> float:
    """The threshold on (label, ratio) with the largest sum of both labels' accuracies; the middle one of equals; 0 without both labels."""
    place = F.least(F.greatest(F.floor((F.col("ratio") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1))
    got = scored.groupBy("label", place.alias("bin")).agg(F.count("*").alias("n")).collect()
    n = np.zeros((2, BINS + 1))
    for r in got:
        n[r.label, r.bin] += r.n
    if not n[0].any() or not n[1].any():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, 1)[:, :-1]], 1)
    right = below[0] / n[0].sum() + 1 - below[1] / n[1].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best[len(best) // 2] / BINS * 2 * SPAN - SPAN)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every page's url."""
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    ruled = pages.select("page_id", "url").select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = ruled.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    known = ruled.where(F.col("r").isNotNull()).select("url", (F.col("r.verdict") == "allow").cast("int").alias("label"), (F.abs(F.xxhash64("url")) % 5 == 0).alias("apart"))
    models = fit(known.where(~F.col("apart")))
    shared = spark.sparkContext.broadcast(models)
    threshold = calibrate(known.where("apart").select("label", ratios(F.col("url"), shared).alias("ratio"))) if models else 0.0
    out = ruled.withColumn("ratio", ratios(F.col("url"), shared))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "ratio")
