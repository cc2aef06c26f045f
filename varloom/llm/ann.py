"""Approximate nearest neighbours by a forest of hash strings.

Every tree writes a vector as a string of ``SYMBOLS`` symbols: the largest signed coordinate after
a random rotation, one rotation for each symbol (cross-polytope hashing). A tree is the array of all
vectors sorted by string. Such an array is cut into slots of about ``SLOT`` rows; a run of equal
strings longer than that is spread over several slots by a second hash, so no slot depends on skew.

A query descends every tree to its own string. Then it ascends all trees at once: each step admits
the string whose symbols cost least (the squared gap between the query's largest coordinate and the
admitted one, added up over the symbols; a string that shares the first symbol costs only what the
rest of it differs). It stops when every tree's own string is admitted and the admitted strings of all
trees together hold ``wanted(n)`` rows, a number that grows as a power of the table (a row counts once for each tree), and
so many that k + 1 of them must be different; a smaller table is admitted as a whole. Counts by string are a table of fixed size for each tree,
so the ascent needs no look at the vectors. Candidates are compared by exact cosine in double
precision where they lie, and only the nearest of each slot travel on.

Equal vectors are one class, kept with its smallest ids, which is all a result can hold of it: a hot
vector costs one row. Queries of a class are answered once.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows of null id; of rows with equal id and vector each counts. A table of fewer than k other vectors gives
all of them. Ties go to the smaller id. Vectors of another length than most are compared only with
those of their own length. Columns other than id and vector are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import release, stage_table

TREES = 16
SYMBOLS = 2
SLOT = 8192
K = 5
#: Coordinates that an ascent admits for a symbol; more where these hold too few rows.
NEAR = 24


def wanted(n: int) -> int:
    """Rows that the ascents of all trees together have to reach in a table of n distinct vectors."""
    return int(np.ceil(5 * n**0.7)) + 20


@lru_cache(maxsize=4)
def rotations(dim: int, trees: int = TREES) -> np.ndarray:
    """Random rotations, by tree and symbol (trees, symbols, dim, dim)."""
    rng = np.random.default_rng(2024 + dim)
    return np.linalg.qr(rng.normal(size=(trees, SYMBOLS, dim, dim)))[0]


def coordinates(x: np.ndarray, trees: int) -> np.ndarray:
    """Signed coordinates of unit vectors (row, tree, symbol, 2 dim)."""
    y = np.einsum("nd,tsde->ntse", x, rotations(x.shape[1], trees), optimize=True)
    return np.concatenate([y, -y], -1)


def unit(data: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and the same of length 1."""
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), dim)
    return x, x / np.sqrt((x * x).sum(1, keepdims=True))


def strings(x: np.ndarray, trees: int) -> np.ndarray:
    """The string of each row in each tree, as a number to the base 2 dim."""
    s = np.concatenate([coordinates(x[i : i + 4096], trees).argmax(-1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros((0, trees, SYMBOLS), int)
    out = np.zeros(s.shape[:2], np.int64)
    for k in range(SYMBOLS):
        out = out * (2 * x.shape[1]) + s[:, :, k]
    return out


def clean(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec (bytes of doubles) of the rows that take part."""
    e = F.col(embedding).cast("array<double>")
    good = F.col("e").isNotNull() & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("e", lambda v: v != 0)

    def pack(batches):
        for b in batches:
            col = b.column(1)
            flat, off = np.asarray(col.flatten(), np.float64), np.asarray(col.offsets)
            flat = flat + 0.0  # no negative zeros: equal vectors have equal bytes
            off = off - off[0]
            ends = [flat[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.binary())], names=["vec_id", "vec"])

    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & good)
    return rows.mapInArrow(pack, "vec_id long, vec binary")


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """cid (smallest id), vec, members (the k + 1 smallest ids) of each distinct vector."""
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("members"))


class Forest:
    """What a query needs to know of the trees: rows by string, and the slots of each string."""

    def __init__(self, counts: np.ndarray, dim: int, slot: int, k: int = K):
        self.counts, self.dim = counts, dim
        self.trees = len(counts)
        before = np.cumsum(counts, 1) - counts
        self.first = before // slot
        self.last = np.maximum(before + counts - 1, before) // slot
        # a string that is spread over several slots has them for itself
        width = int(self.last.max()) + 1
        self.base = np.arange(self.trees)[:, None] * width
        # a row lies once in each tree: more than k rows a tree, all trees together, are more than k distinct ones
        self.wanted = max(wanted(int(counts[0].sum())), self.trees * k + 1)

    def slot_of(self, tree: np.ndarray, string: np.ndarray, salt: np.ndarray) -> np.ndarray:
        lo, hi = self.first[tree, string], self.last[tree, string]
        return self.base[tree, 0] + lo + salt % (hi - lo + 1)

    def ascend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trees and strings that a query admits."""
        y = coordinates(x[None], self.trees)[0]
        near = NEAR
        while True:
            near = min(near, 2 * self.dim)
            order = np.argsort(-y, -1)[..., :near]
            gap = (y.max(-1, keepdims=True) - np.take_along_axis(y, order, -1)) ** 2
            cost, string = gap[:, 0], order[:, 0]
            for s in range(1, SYMBOLS):
                cost = (cost[:, :, None] + gap[:, s, None, :]).reshape(self.trees, -1)
                string = (string[:, :, None] * (2 * self.dim) + order[:, s, None, :]).reshape(self.trees, -1)
            tree = np.repeat(np.arange(self.trees), cost.shape[1])
            cost, string = cost.ravel(), string.ravel()
            n = self.counts[tree, string]
            by = np.argsort(cost, kind="stable")
            reached = np.cumsum(n[by])
            if reached[-1] >= self.wanted or near == 2 * self.dim:
                # own strings cost nothing and come first: every tree's is admitted, however many rows the first ones hold
                by = by[: max(int(np.searchsorted(reached, self.wanted)) + 1, self.trees)]
                by = by[n[by] > 0]
                return tree[by], string[by]
            near *= 2


def _count(trees: int, dim: int):
    size = (2 * dim) ** SYMBOLS

    def of(batches):
        for b in batches:
            s = strings(unit(b.column(0).to_pylist(), dim)[1], trees) + np.arange(trees) * size
            cells, n = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])

    return of


def _index_rows(shared, dim: int):
    def of(batches):
        forest: Forest = shared.value
        for b in batches:
            cid, vec = np.asarray(b.column(0)), b.column(1)
            s = strings(unit(vec.to_pylist(), dim)[1], forest.trees)
            for t in range(forest.trees):
                slot = forest.slot_of(np.full(len(s), t), s[:, t], cid * 2654435761 % 1000003)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.zeros(len(s), np.int32)), pa.array(cid), vec, pa.array([x.tobytes() for x in s[:, t]], pa.binary())], names=["slot", "kind", "cid", "vec", "strings"])

    return of


def _query_rows(shared, dim: int):
    def of(batches):
        forest: Forest = shared.value
        for b in batches:
            for cid, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree, string = forest.ascend(unit([vec], dim)[1][0])
                lo, hi = forest.first[tree, string], forest.last[tree, string]
                n = hi - lo + 1
                each = np.repeat(np.arange(len(tree)), n)
                slot = forest.base[tree[each], 0] + lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                by = np.argsort(slot, kind="stable")
                slot, picked = slot[by], string[each[by]]
                cut = np.flatnonzero(np.diff(slot, prepend=-1))
                rows = [picked[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(slot)], strict=True)]
                if rows:
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(slot[cut]), pa.array(np.ones(m, np.int32)), pa.array(np.full(m, cid)), pa.array([vec] * m, pa.binary()), pa.array(rows, pa.binary())], names=["slot", "kind", "cid", "vec", "strings"])

    return of


def _scan(dim: int, k: int):
    """Slots in order, each with its rows before its queries; only one slot's rows are held."""

    def of(batches):
        now, parts, slot = None, [], None
        for b in batches:
            slots, kinds = np.asarray(b.column(0)), np.asarray(b.column(1))
            cid, vec, text = np.asarray(b.column(2)), b.column(3), b.column(4)
            cut = np.flatnonzero(np.diff(slots * 2 + kinds, prepend=-1))
            out = [[], [], []]
            for i, j in zip(cut, [*cut[1:], len(slots)], strict=True):
                if slots[i] != now:
                    now, parts, slot = slots[i], [], None
                if kinds[i] == 0:
                    parts.append((cid[i:j], vec[i:j].to_pylist(), np.frombuffer(b"".join(text[i:j].to_pylist()), np.int64)))
                    continue
                if not parts:
                    continue
                if slot is None:
                    s = np.concatenate([p[2] for p in parts])
                    by = np.argsort(s, kind="stable")
                    x = unit([v for p in parts for v in p[1]], dim)[0][by]
                    slot = s[by], np.concatenate([p[0] for p in parts])[by], x, np.sqrt((x * x).sum(1))
                s, ids, x, length = slot
                for q, v, own in zip(cid[i:j].tolist(), vec[i:j].to_pylist(), text[i:j].to_pylist(), strict=True):
                    want = np.frombuffer(own, np.int64)
                    lo, hi = np.searchsorted(s, want), np.searchsorted(s, want, side="right")
                    n = hi - lo
                    if not n.sum():
                        continue
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    y = np.frombuffer(v, np.float64)
                    near = x[at] @ y / (length[at] * np.sqrt((y * y).sum()))
                    if len(at) > k + 1:
                        least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                        some = near >= least
                        at, near = at[some], near[some]
                    best = np.lexsort((ids[at], -near))[: k + 1]
                    out[0].append(np.full(len(best), q))
                    out[1].append(ids[at[best]])
                    out[2].append(near[best])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query", "cid", "score"])

    return of


def _search(classes: DataFrame, asked: DataFrame, dim: int, k: int, trees: int) -> DataFrame:
    """query (cid), cid, score: the k + 1 nearest classes found of each class in ``asked``, itself included."""
    spark = classes.sparkSession
    got = classes.select("vec").mapInArrow(_count(trees, dim), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(trees * (2 * dim) ** SYMBOLS, np.int64)
    counts[got.cell.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(Forest(counts.reshape(trees, -1), dim, SLOT, k))
    schema = "slot long, kind int, cid long, vec binary, strings binary"
    rows = classes.select("cid", "vec").mapInArrow(_index_rows(shared, dim), schema).unionByName(asked.select("cid", "vec").mapInArrow(_query_rows(shared, dim), schema))
    found = rows.repartition("slot").sortWithinPartitions("slot", "kind").mapInArrow(_scan(dim, k), "query long, cid long, score double")
    return found.groupBy("query", "cid").agg(F.max("score").alias("score"))


def nearest(table: DataFrame, queries, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``queries`` (a condition on vec_id) holds for."""
    vectors = clean(table, vec_id, embedding)
    classes = stage_table(classes_of(vectors, k), "classes")
    release(table.sparkSession)
    asked = vectors.where(queries)
    dims = [r[0] for r in classes.select((F.length("vec") / 8).cast("int").alias("d")).distinct().limit(65).collect()]
    if len(dims) > 64:
        raise ValueError("vectors of more than 64 lengths")
    wanted_classes = asked.select("vec").distinct()
    found = None
    for dim in dims:
        own = classes.where(F.length("vec") == 8 * dim)
        part = _search(own, own.join(wanted_classes, "vec", "left_semi"), dim, k, trees)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    top = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    ids = top.join(classes.select("cid", "members"), "cid").select("query", F.explode("members").alias("vec_id"), "score")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    lists = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    lists = stage_table(lists.join(classes.select(F.col("cid").alias("query"), "vec"), "query").select("vec", "list"), "lists")
    out = asked.select(F.col("vec_id").alias("query_id"), "vec").join(lists, "vec").select("query_id", F.filter("list", lambda x: x["vec_id"] != F.col("query_id")).alias("list"))
    out = out.select("query_id", F.posexplode(F.slice("list", 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
