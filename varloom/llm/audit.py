"""How the order of filters decides which of them removes a document, and what each order loses.

1. Every document gets its failure flags of ``FILTERS``, its part (``lang``) and its labels, in the JVM.
2. Copies of one text are counted before anything is gathered by text: a group of copies, however large, travels as one
   row for each part and label. The copies with the smallest doc_id pass filter E.
3. Documents of equal flags, part and labels become one row with their number, so what is crossed has at most 128 rows
   for each part and does not grow with the corpus.
4. These rows are crossed with the broadcast orders (120 rows, all permutations of the five filters) and exploded to
   five steps. The first failing step of a row in an order decides what that step removed, kept and found removed
   already; one conditional aggregation by part, order and step counts it.

Defined results: a null text is empty and fails A (and E, if a smaller doc_id has an empty text too); null and empty
``lang`` are one part, the empty string. A row without doc_id has no smaller or larger one: it passes E, and no other
row fails E because of it. Rows that repeat a doc_id are all counted; they do not make each other fail E. Labels that
repeat count as 1 if any of them is 1; without a label, neither ``good_lost`` nor ``toxic_lost`` counts a document. An
empty documents table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILTERS = "ABCDE"
#: White space that parts words, and the signs of filter D.
SPACE, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def text_flags(text: Column) -> dict[str, Column]:
    """The failure flags of the filters that look at one text only."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "n_words": F.size(words),
        "n_distinct": F.size(F.array_distinct(words)),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (true: fails), good, toxic, n: the documents as counted rows of equal flags, part and labels."""
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("key"), *(c.alias(k) for k, c in text_flags(text).items()))
    each = each.select("doc_id", "part", "key", (F.col("n_words") < LEAST_WORDS).alias("A"), (100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")).alias("B"), "C", "D")
    known = each.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = ["key", "part", "A", "B", "C", "D", "good", "toxic"]
    # rows of one doc_id first: the join has dealt them by it, and after that the smallest doc_id of a class tells how many rows it has
    rows = known.groupBy("doc_id", *alike).agg(F.count("*").alias("copies"))
    of_class = rows.groupBy(*alike).agg(F.sum("copies").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "copies"))).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("copies"))), F.lit(0)).alias("nameless"))
    # classes of one text: one for each part and label, so a group of copies meets as a few rows
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    passed = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.copies")).otherwise(0)
    both = of_class.withColumn("least", least).withColumn("passed", passed)
    split = both.select("part", "A", "B", "C", "D", "good", "toxic", F.inline(F.array(F.struct(F.lit(False).alias("E"), F.col("passed").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passed")).alias("n")))))
    return split.groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def orders(spark: SparkSession) -> DataFrame:
    """filter_order: all permutations of the filters, 120 rows."""
    return spark.createDataFrame([("".join(p),) for p in itertools.permutations(FILTERS)], "filter_order string")


def replay(flags: DataFrame) -> DataFrame:
    """Counts of every part, order and step of ``flagged`` rows; the columns are those of ``report``."""
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession)))
    letter = lambda k: F.substring("filter_order", k, 1)
    fails = lambda at: F.coalesce(*(F.when(at == f, F.col(f)) for f in FILTERS))
    first = F.coalesce(*(F.when(fails(letter(k)), k) for k in range(1, 6)), F.lit(6))
    several = sum((F.col(f).cast("int") for f in FILTERS[1:]), F.col(FILTERS[0]).cast("int"))
    found = crossed.select("part", "filter_order", "n", "good", "toxic", *FILTERS, first.alias("first"), several.alias("failed"))
    steps = found.select("*", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("step"))
    steps = steps.withColumn("fails", fails(F.expr("substring(filter_order, step, 1)")))
    here = F.col("first") == F.col("step")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    counts = steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("fails") & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("fails") & (F.col("failed") == 1)).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    counts = counts.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    share = counts.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counts.join(share, ["part", "filter"])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter."""
    out = replay(flagged(docs, labels.select("doc_id", "quality", "toxic")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) = 1 AS good, coalesce(max((toxic = 1)::INT), 0) = 1 AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT t.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(words) < 100 AS a,
         100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(min(t.doc_id) OVER (PARTITION BY text) < t.doc_id, false) AS e
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), p AS (
  SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fail, a::INT + b::INT + c::INT + d::INT + e::INT AS failed, count(*) AS n
  FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5
), r AS (
  SELECT p.*, filter_order,
         coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: fail[substring(filter_order, i, 1)])), 6) AS first
  FROM p, orders
), s AS (
  SELECT r.*, step, substring(filter_order, step, 1) AS filter FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), g AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (WHERE first > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE first = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fail[filter] AND first < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fail[filter] AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE first = step AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE first = step AND toxic), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter
FROM g
"""
