"""Ranked lexical search of many items by MaxScore, shard by shard.

1. The items' terms (``item_terms``) are few and short; they are collected in blocks of ``VOCABULARY`` bytes at most, and a
   block's terms are broadcast. A table of items of any size is searched block after block.
2. One pass over the documents counts each text's terms and keeps the number of terms and the occurrences of the block's
   terms: a staged table, whose sums give N, L and every document frequency.
3. A shard is a run of that table's rows with up to ``SHARD`` postings. Its postings lie by term and document with
   their exact integer impacts. For every item, the terms are split by the shard's upper bounds: as long as the sum of
   the smallest bounds stays under the item's present threshold, those terms are non-essential. Documents of essential
   terms are scored; the lists of non-essential terms are then probed from the highest bound down, and only for documents
   that can still qualify with all bounds that are left. The threshold is the score of the item's last place so far; a task
   carries it from shard to shard.
4. A task hands on the best of each item once, at its end. They are merged in two steps, by groups of tasks and then
   by item, so no task gets all shards' rows of an item.

Scores are integers and ties go to the smaller doc_id, so the result does not depend on how documents lie in shards.

Defined results: null and empty texts, and texts without a term, have no terms; they count neither for N nor for any
item. An item without terms, or whose terms no document holds, has no rows. Rows of ``docs`` that repeat a doc_id are
documents of their own and may both be ranked; rows without doc_id are ranked before all others of equal score. Each row of ``items`` is an item
of its own: repeated rows give repeated rankings. Empty tables give no rows. Only doc_id, item_id and text are read, whatever
other columns there are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import drop_stage, small_batches, stage_table, text_bytes, tidily

#: Places of an item's ranking.
TOP = 20
#: Bytes of distinct terms (and 64 for each) of one block of items; items that have more are a block each.
VOCABULARY = 32 << 20
#: Postings of a shard.
SHARD = 1 << 20
#: Bytes of a text whose terms are listed at once.
PIECE = 1 << 20
#: Groups of tasks whose best rows are merged first.
MERGED = 64
#: Stands for a missing doc_id, which comes first among equals.
NAMELESS = -(1 << 63)

#: Fixed rule: letters, digits and everything beyond ASCII make terms, A to Z as small letters; all other bytes part them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(raw: bytes) -> Counter:
    """How often each term occurs in a text."""
    found, at = Counter(), 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and _TABLE[raw[end]] != 32:  # a term is not cut
            end += 1
        found.update(raw[at:end].translate(_TABLE).split())
        at = end
    return found


def _item_terms(batches):
    for b in tidily(batches):
        data, off = text_bytes(b.column(1))
        raw = data.tobytes()
        rows, terms, n = [], [], []
        for k, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            for t, c in count_terms(raw[i:j]).items():
                rows.append(k)
                terms.append(t)
                n.append(c)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary()), pa.array(n, pa.int64())], names=["item", "term", "n"])


def item_terms(items: DataFrame) -> DataFrame:
    """item (number of the row), term (bytes), n (repeats) of rows item, text."""
    return items.select("item", "text").mapInArrow(_item_terms, "item long, term binary, n long")


def _postings(batches, shared):
    """doc_id, n (terms with repeats), and the block's terms and their occurrences of every document that has terms."""
    number = shared.value
    for b in tidily(batches):
        data, off = text_bytes(b.column(1))
        raw = data.tobytes()
        keep, size, terms, often = [], [], [], []
        for k, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            found = count_terms(raw[i:j])
            if found:
                own = [(number[t], c) for t, c in found.items() if t in number] if len(found) <= len(number) else [(x, found[t]) for t, x in number.items() if t in found]
                keep.append(k)
                size.append(found.total())
                terms.append([t for t, _ in own])
                often.append([c for _, c in own])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "often"])


class Query:
    """An item's terms with their weights (repeats times w), and its best documents so far."""

    def __init__(self, item: int, terms: np.ndarray, weights: np.ndarray):
        self.item, self.terms, self.weights = item, terms, weights
        self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self, top: int) -> int:
        """What a document's score must reach to be ranked."""
        return int(self.scores[-1]) if len(self.scores) >= top else 1

    def offer(self, scores: np.ndarray, docs: np.ndarray, top: int) -> None:
        s, d = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        by = np.lexsort((d, -s))[:top]
        self.scores, self.docs = s[by], d[by]


class Shard:
    """Postings of some documents: by term, the documents (by place) and their impacts."""

    def __init__(self, docs: np.ndarray, place: np.ndarray, term: np.ndarray, impact: np.ndarray, vocabulary: int):
        by = np.lexsort((place, term))
        self.docs, self.place, self.impact = docs, place[by], impact[by]
        self.begin = np.searchsorted(term[by], np.arange(vocabulary + 1))
        filled = np.flatnonzero(np.diff(self.begin))
        self.most = np.zeros(vocabulary, np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.impact, self.begin[filled])

    def search(self, q: Query, top: int) -> int:
        """Rank the shard's documents for an item; the number of postings that were looked at."""
        bound = q.weights * self.most[q.terms]
        some = np.flatnonzero(bound > 0)
        order = some[np.argsort(bound[some], kind="stable")]  # lowest bound first
        reach = np.cumsum(bound[order])  # what the first k + 1 terms can give together
        limit = q.threshold(top)
        if not len(order) or reach[-1] < limit:
            return 0
        first = int(np.searchsorted(reach, limit))  # terms before it can't lift a document over the threshold
        seen, score = [], np.zeros(len(self.docs), np.int64)
        for k in order[first:].tolist():
            i, j = self.begin[q.terms[k]], self.begin[q.terms[k] + 1]
            score[self.place[i:j]] += q.weights[k] * self.impact[i:j]
            seen.append(self.place[i:j])
        read = sum(map(len, seen))
        found = np.flatnonzero(score > 0)
        for k in range(first - 1, -1, -1):
            found = found[score[found] + reach[k] >= limit]
            if not len(found):
                return read
            i, j = self.begin[q.terms[order[k]]], self.begin[q.terms[order[k]] + 1]
            at = np.minimum(np.searchsorted(self.place[i:j], found), j - i - 1) + i
            hit = self.place[at] == found
            score[found[hit]] += q.weights[order[k]] * self.impact[at[hit]]
            read += len(found)
        found = found[score[found] >= limit]
        q.offer(score[found], self.docs[found], top)
        return read


def _ranked(batches, shared, top: int):
    """The best documents of a task, item by item."""
    items, terms, weights, total, length, vocabulary = shared.value
    cut = np.flatnonzero(np.diff(items)) + 1
    queries = [Query(int(i[0]), t, w) for i, t, w in zip(np.split(items, cut), np.split(terms, cut), np.split(weights, cut), strict=True)] if len(items) else []
    held, postings = [], 0

    def settle():
        nonlocal held, postings
        docs = np.concatenate([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        counts, term, often = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
        place = np.repeat(np.arange(len(docs)), counts)
        m = 75 + 25 * n * total // length
        shard = Shard(docs, place, term, 1_000_000_000 * often // (1000 * often + 12 * m[place]), vocabulary)
        for q in queries:
            shard.search(q, top)
        held, postings = [], 0

    for b in batches:
        terms_of, often = b.column(2), b.column(3)
        held.append((np.asarray(b.column(0)), np.asarray(b.column(1)), np.diff(np.asarray(terms_of.offsets)), np.asarray(terms_of.flatten()), np.asarray(often.flatten())))
        postings += len(held[-1][3])
        if postings >= SHARD:
            settle()
    if held:
        settle()
    for q in queries:
        if len(q.docs):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q.docs), q.item, np.int64)), pa.array(q.docs), pa.array(q.scores)], names=["item", "doc_id", "score"])


def _best(df: DataFrame, by: list[str], top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id")))
    return df.withColumn("rank", place).where(F.col("rank") <= top)


def _block(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """item, doc_id, score, rank of the items of one block of ``item_terms``."""
    spark = docs.sparkSession
    wanted = terms.toArrow()
    distinct = wanted.column("term").combine_chunks().dictionary_encode()
    if isinstance(distinct, pa.ChunkedArray):
        distinct = distinct.combine_chunks()
    words = spark.sparkContext.broadcast({w: k for k, w in enumerate(distinct.dictionary.to_pylist())})
    found = stage_table(docs.mapInArrow(lambda b: _postings(b, words), "doc_id long, n long, terms array<int>, often array<long>"), "postings")
    size = found.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * size.N + 2) / (2.0 * F.col("df") + 1))).alias("w")
    w = np.zeros(len(distinct.dictionary), np.int64)
    for r in holding.select("term", weight).toLocalIterator():  # at most one row for each of the block's terms
        w[r.term] = r.w
    items, number, n = np.asarray(wanted.column("item")), np.asarray(distinct.indices), np.asarray(wanted.column("n"))
    by = np.lexsort((number, items))
    shared = spark.sparkContext.broadcast((items[by], number[by], (n * w[number])[by], size.N, max(size.L, 1), len(w)))
    best = found.mapInArrow(lambda b: _ranked(b, shared, top), "item long, doc_id long, score long").withColumn("task", F.spark_partition_id() % MERGED)
    out = stage_table(_best(_best(best, ["item", "task"], top).drop("rank", "task"), ["item"], top), "ranked")
    drop_stage(found)
    words.destroy()
    shared.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every row of ``items``."""
    spark = docs.sparkSession
    small_batches(spark)
    numbered = stage_table(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "items")
    terms = stage_table(item_terms(numbered), "terms")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = terms.groupBy("item").agg(F.sum(F.length("term") + 64).alias("bytes"))
    total = each.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    blocks = max(1, -(-total // VOCABULARY))
    dealt = lambda k: F.expr(f"pmod(xxhash64(item), {k})")
    while blocks > 1 and each.groupBy(dealt(blocks)).agg(F.sum("bytes").alias("b"), F.count("*").alias("c")).where(f"b > {VOCABULARY} and c > 1").limit(1).count():
        blocks *= 2
    parts = [_block(texts, terms if blocks == 1 else terms.where(dealt(blocks) == k), top) for k in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    drop_stage(terms)
    named = F.when(F.col("doc_id") != NAMELESS, F.col("doc_id"))
    return out.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", named.alias("doc_id"), "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), p AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs
), r AS (
  SELECT item_id, row, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, row, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20
"""
