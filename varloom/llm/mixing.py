"""Mixing to target weights by soft membership, in DataFrame operations only.

A labelled table names the domain of some documents. Word counts per domain,
hashed into ``BUCKETS`` buckets, give a naive Bayes classifier; it predicts each
document's posterior over domains, tempered by length so that membership stays
soft. Nonnegative rates of the documents are then fitted so that the expected
token totals of the domains (sum of rate * tokens * posterior) have the target
shares: projected gradient steps on the squared differences, scaled by the
domains' Gram matrix, which is the same for all documents. Targets that ``STEPS`` steps
don't reach (no document may have the domain) give a warning that says how far off they are. A step needs one
pass that adds up one number for each domain; only those reach the driver.

The classifier learns from at most ``SAMPLE`` labelled ids of each domain that have
text, those of smallest hash; totals, Gram matrix and rates cover all documents. There may be
``DOMAINS`` domains at most.

Defined results: null and empty texts have no tokens and rate 1. Targets of domains
without labelled text are left out and the rest scaled to sum 1; without any domain all
rates are 1 and posteriors are empty. Labels with a null id or domain don't count, and of
several labels of an id the smallest domain does. Repeated rows get equal rates. Other
columns pass ``mix`` as they are.
The input must give the same rows in the same order when it is read again, as files do.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._common import fresh, stage_table

BUCKETS = 4096
SAMPLE = 2_500
DOMAINS = 32
TEMPER = 40.0
STEPS = 96
CLOSE = 1e-4
#: Target shares of the query and the pipeline, by domain.
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each word: its bucket from 1 on."""
    words = F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word")
    return docs.select(*keep, words).where("word <> ''").select(*keep, (F.pmod(F.xxhash64("word"), F.lit(BUCKETS)) + 1).cast("int").alias("bucket"))


def _fit(docs: DataFrame, labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, log priors, and log weights (domain x bucket)."""
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    there = docs.where("trim(text) <> ''").select("doc_id").distinct()
    known = stage_table(known.join(there, "doc_id", "left_semi"), "labelled")
    names = sorted(r.domain for r in known.select("domain").distinct().limit(DOMAINS + 1).collect())
    if len(names) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    picked = None
    for name in names:  # a bounded number of each domain, so none is missing
        own = known.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        picked = own if picked is None else picked.unionByName(own)
    text = docs.select("doc_id", "text").join(F.broadcast(known.limit(0) if picked is None else picked), "doc_id")
    got = _words(text, "domain").groupBy("domain", "bucket").agg(F.count("*").alias("n")).groupBy("domain").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).collect()
    got.sort(key=lambda r: r.domain)
    n = np.full((len(got), BUCKETS), 0.5)
    for row, r in zip(n, got, strict=True):
        for c in r.cells:
            row[c.bucket - 1] += c.n
    if not got:
        return [], np.zeros(0), n
    return [r.domain for r in got], np.log(n.sum(1) / n.sum()), np.log(n / n.sum(1, keepdims=True))


def memberships(docs: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """rid, n_tokens, p (array of posteriors) of each document that has tokens, and the domains in order."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "text")
    domains, prior, weights = _fit(docs, labelled)
    weights = weights - weights.mean(0, keepdims=True) if domains else weights
    sums = [F.sum(F.element_at(F.lit(w.tolist()), F.col("bucket"))).alias(f"s{d}") for d, w in enumerate(weights)]
    per = _words(numbered, "rid").groupBy("rid").agg(F.count("*").alias("n_tokens"), *sums)
    soft = [F.col(f"s{d}") * (TEMPER / (TEMPER + F.col("n_tokens"))) + float(prior[d]) for d in range(len(domains))]
    if not soft:
        return per.select("rid", "n_tokens", F.array().cast("array<double>").alias("p")), domains
    top = F.greatest(*soft) if len(soft) > 1 else soft[0]
    odds = F.array(*(F.exp(s - top) for s in soft))
    whole = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return per.withColumn("odds", odds).select("rid", "n_tokens", F.transform("odds", lambda x: x / whole).alias("p")), domains


def _dot(v) -> Column:
    """Posterior times a vector."""
    return sum((F.col("p")[d] * float(x) for d, x in enumerate(v)), F.lit(0.0))


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float]) -> DataFrame:
    """``members`` with a rate."""
    share = np.array([max(targets.get(d, 0.0), 0.0) for d in domains])
    if not domains or not share.any():
        return members.withColumn("rate", F.lit(1.0))
    share = share / share.sum()
    size = range(len(domains))
    got = members.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    if not got.n:
        return members.withColumn("rate", F.lit(1.0))
    a = (F.col("n_tokens") * (got.n / got.t)).alias("a")
    now = members.select("rid", "n_tokens", "p", a, F.lit(1.0).alias("rate"))
    gram = now.agg(*(F.avg(F.col("a") * F.col("a") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in size for j in size if j <= i)).first()
    g = np.array([[gram[f"g{max(i, j)}_{min(i, j)}"] for j in size] for i in size])
    scale = np.linalg.inv(g + 1e-6 * np.trace(g) * np.eye(len(domains)))
    rate = F.col("rate")
    for step in range(STEPS):
        if step and step % 8 == 0:  # keeps the expression short
            now = stage_table(now.withColumn("rate", rate), "rates")
            rate = F.col("rate")
        totals = now.select("a", "p", rate.alias("r")).agg(*(F.avg(F.col("r") * F.col("a") * F.col("p")[d]).alias(f"t{d}") for d in size)).first()
        error = np.array([totals[d] for d in size]) - share
        if np.abs(error).max() < CLOSE:
            break
        if step == STEPS - 1:
            warnings.warn(f"shares are {np.abs(error).max():.4f} from their targets after {STEPS} steps", stacklevel=2)
            break
        rate = F.greatest(F.lit(0.0), rate - F.col("a") * _dot(scale @ error))
    return now.select("rid", "n_tokens", "p", rate.alias("rate"))


def _rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, list[str]]:
    members, domains = memberships(docs, labelled)
    return stage_table(fit_rates(stage_table(members, "members"), domains, targets), "rated"), domains


def copies_at(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose mean is the rate: the fraction decides by a hash of the id."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("long")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p, rate, copies of every document."""
    docs = docs.select("doc_id", "text")
    rated, domains = _rated(docs, labelled, targets or TARGETS)
    out = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id").join(rated, "rid", "left")
    rate = F.coalesce("rate", F.lit(1.0))
    likeliest = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int")) if domains else F.lit(None).cast("string")
    domain = F.when(F.size("p") > 0, likeliest)
    return out.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), domain.alias("domain"), F.coalesce("p", F.array().cast("array<double>")).alias("p"), rate.alias("rate"), copies_at(rate, F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every row as often as its rate says, all columns as they are."""
    rid = fresh(docs, "rid")
    rated, _ = _rated(docs.select("doc_id", "text"), labelled, targets or TARGETS)
    kept = docs.withColumn(rid, F.monotonically_increasing_id())
    other = rated.select(F.col("rid").alias(rid), F.col("rate").alias(fresh(docs, "rate")))
    n = copies_at(F.coalesce(F.col(other.columns[1]), F.lit(1.0)), F.col("doc_id"))
    times = F.explode(F.sequence(F.lit(1), n))
    return kept.join(other, rid, "left").where(n > 0).select(*(F.col(f"`{c}`") for c in docs.columns), times.alias(fresh(docs, "copy"))).select(*(F.col(f"`{c}`") for c in docs.columns))
