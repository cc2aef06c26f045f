"""Suffix-array dedup: removal of every byte that a repeated string of ``LENGTH`` bytes covers.

1. Every window of ``LENGTH`` bytes has an anchor, the gram of least hash in it, so equal windows have equal
   anchors at equal places. One suffix in about 80 is an anchor; only those enter the index.
2. Anchors whose gram occurs once match nothing. A span, the bytes of all windows of an anchor, that occurs
   again as it is repeats as a whole. Both are found by counts that combine before the shuffle.
3. Spans of the same gram that differ may share windows. Each distinct one is fetched once, and the suffixes
   at its window starts go through logarithmic families of suffix arrays (``suffix.Levels``): batch by batch,
   a family for each shard of grams. Grams of more than ``HOT`` distinct spans would make uneven shards; their
   windows are counted by fingerprint instead, runs of ``CHUNK`` first and then single ones, with the same result.
4. Matches go back to their documents as byte ranges, and the bytes outside are kept.

Windows and spans are compared by 128 and more bits of independent polynomial fingerprints. Strings are judged
on the input, never across documents, and overlapping repeats count.

Defined results: null counts as empty; texts shorter than ``LENGTH`` bytes stay whole. Rows are told apart by their
place, so repeated rows and repeated or null ids are fine: repeated rows repeat each other's bytes. The input must
give the same rows in the same order when it is read again, as files do. Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import suffix
from ._common import chunks, drop_stage, mix64, release, small_batches, stage_table, staged, sweep, text_bytes, tidily
from .suffix import BASES, LENGTH, Levels, Prints

HOT = 512
#: Windows that are first compared together, for such grams.
CHUNK = 8
#: A text is searched in pieces of so many window starts; suffixes in a family before it starts anew at the next gram.
PIECE = 1 << 21
FAMILY = 1 << 20


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Texts of bounded size: data, offsets, row and place of each piece. Pieces of a text share no window."""
    n = np.diff(offsets)
    if not len(n) or n.max() <= PIECE + LENGTH:
        rows = np.arange(len(n))
        return data, offsets, rows, np.zeros(len(n), np.int64)
    parts = [(r, p, min(p + PIECE + LENGTH - 1, m)) for r, m in enumerate(n.tolist()) for p in range(0, max(m - LENGTH + 1, 1), PIECE)]
    out = np.concatenate([data[offsets[r] + a : offsets[r] + b] for r, a, b in parts])
    return out, np.concatenate([[0], np.cumsum([b - a for _, a, b in parts])]), np.array([r for r, _, _ in parts]), np.array([a for _, a, _ in parts], np.int64)


def _anchor_rows(batches):
    for b in tidily(batches):
        rid = np.asarray(b.column(0))
        data, offsets, rows, place = _pieces(*text_bytes(b.column(1)))
        for i, j in chunks(offsets, 1 << 20):
            text, at, key, span, left, right = suffix.anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(text):
                text = text + i
                packed = ((at + place[text]) << 16) | (left << 8) | right
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, span, rid[rows[text]], packed)], names=["key", "span", "rid", "at"])


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")


def _contexts(batches):
    """The bytes of each span that a document was picked for."""
    for b in tidily(batches):
        data, offsets = text_bytes(b.column(0))
        spans = b.column(1)
        flat, ends = spans.flatten(), np.asarray(spans.offsets)
        ends = ends - ends[0]
        key, span, at, n = (np.asarray(flat.field(k)) for k in range(4))
        row = np.repeat(np.arange(len(spans)), np.diff(ends))
        lo = offsets[row] + (at >> 16) - ((at >> 8) & 255)
        hi = offsets[row] + (at >> 16) + (at & 255)
        raw = [data[i:j].tobytes() for i, j in zip(lo, hi, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(span), pa.array(at & 0xFFFF), pa.array(n), pa.array(raw, pa.binary())], names=["key", "span", "shape", "n", "bytes"])


def _windows(shape: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Span, distance from window start to anchor, and both fingerprints of every window of some spans."""
    left, right = shape >> 8, shape & 255
    n = left + right - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + k
    prints = [Prints(data, base).of(start, start + LENGTH) for base in BASES]
    return row, left[row] - k, prints[0], prints[1]


def _runs(row: np.ndarray, back: np.ndarray, n: int):
    """Byte ranges around the anchor for each of n spans, of its matched windows (by falling distance)."""
    begins, ends = [[] for _ in range(n)], [[] for _ in range(n)]
    if len(row):
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (back[1:] != back[:-1] - 1)])
        at = np.flatnonzero(first)
        for r, i, j in zip(row[at].tolist(), back[at].tolist(), back[np.concatenate([at[1:], [len(row)]]) - 1].tolist(), strict=True):
            begins[r].append(-i)
            ends[r].append(LENGTH - j)
    return begins, ends


def _out(key, span, begins, ends):
    some = [k for k, b in enumerate(begins) if b]
    return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(span[some]), pa.array([begins[k] for k in some], pa.list_(pa.int32())), pa.array([ends[k] for k in some], pa.list_(pa.int32()))], names=["key", "span", "begins", "ends"])


def _families(batches):
    """Matched ranges of spans, sorted by key: a family of levels takes them batch by batch."""
    family, held, size = Levels(), [], 0

    def close():
        nonlocal family, held, size
        at = 0
        for key, span, row, back in held:
            found = family.matched[at : at + len(row)]
            at += len(row)
            yield _out(key, span, *_runs(row[found], back[found], len(key)))
        family, held, size = Levels(), [], 0

    for b in batches:
        keys = np.asarray(b.column(0))
        cut = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, int)
        i = 0
        while i < len(keys):
            # up to about 4000 spans, then on to the end of a key
            j = len(keys) if i + 4000 >= len(keys) else int(cut[np.searchsorted(cut, i + 4000)]) if cut[-1] >= i + 4000 else len(keys)
            if held and size > FAMILY and keys[i] != held[-1][0][-1]:
                yield from close()
            part = b.slice(i, j - i)
            raw = part.column(4).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            row, back, one, two = _windows(np.asarray(part.column(2)), data, offsets - offsets[0])
            family.add(one, two, np.asarray(part.column(3))[row] > 1)
            held.append((keys[i:j], np.asarray(part.column(1)), row, back))
            size += len(row)
            i = j
    yield from close()


def _chunk_rows(batches):
    """Runs of up to ``CHUNK`` neighbouring windows of each span.

    ``core`` is the fingerprint of what all windows of a full run share, ``whole`` that of all their bytes; ``one`` and
    ``two`` are the windows' own fingerprints, from window ``hi`` down to ``lo``.
    """
    for b in batches:
        for i in range(0, b.num_rows, 4000):
            part = b.slice(i, 4000)
            raw = part.column(4).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            key, span, shape, n = (np.asarray(part.column(k)) for k in range(4))
            row, back, one, two = _windows(shape, data, offsets)
            chunk = back // CHUNK
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (chunk[1:] != chunk[:-1])]))
            last = np.concatenate([first[1:], [len(row)]])
            r, hi, lo = row[first], back[first], back[last - 1]
            anchor = offsets[r] + (shape[r] >> 8)
            prints = [Prints(data, base) for base in BASES]
            at = anchor - CHUNK * chunk[first]
            core = prints[0].of(at, at + LENGTH - CHUNK + 1) ^ key[r].view(np.uint64)
            whole = prints[1].of(anchor - hi, anchor + LENGTH - lo) ^ mix64((lo * 1000 + hi).astype(np.uint64))
            cut = [[x[a:z].tobytes() for a, z in zip(first, last, strict=True)] for x in (one, two)]
            cols = [key[r], span[r], n[r], lo.astype(np.int32), hi.astype(np.int32), core.view(np.int64), whole.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), *(pa.array(c, pa.binary()) for c in cut)], names=["key", "span", "n", "lo", "hi", "core", "whole", "one", "two"])


def _window_rows(batches):
    for b in batches:
        n, hi = np.asarray(b.column(2)), np.asarray(b.column(3))
        one, two = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.int64) for k in (4, 5))
        size = np.array([len(x) // 8 for x in b.column(4).to_pylist()], int)
        row = np.repeat(np.arange(len(n)), size)
        back = hi[row] - (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))
        cols = [np.asarray(b.column(0))[row], np.asarray(b.column(1))[row], n[row], back.astype(np.int32), one, two]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["core", "whole", "n", "back", "one", "two"])


def _hot_hits(contexts: DataFrame) -> DataFrame:
    """key, span, back (array): the matched windows of spans whose grams have many.

    Runs are made once, at most 26 of a span. Equal runs of windows count as one row from the first aggregation on. Single windows are compared only in runs whose core
    other, different runs have.
    """
    runs = stage_table(contexts.mapInArrow(_chunk_rows, "key long, span long, n long, lo int, hi int, core long, whole long, one binary, two binary"), "runs")
    wholes = stage_table(runs.groupBy("core", "whole").agg(F.sum("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("one").alias("one"), F.max("two").alias("two")), "wholes")
    shared = stage_table(wholes.groupBy("core").agg(F.count("*").alias("d")).where("d > 1").select("core"), "cores")
    windows = wholes.join(shared, "core", "left_semi").select("core", "whole", "n", "hi", "one", "two").mapInArrow(_window_rows, "core long, whole long, n long, back int, one long, two long")
    again = stage_table(windows.groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").select("one", "two"), "again")
    found = windows.where("n = 1").join(again, ["one", "two"]).groupBy("core", "whole").agg(F.collect_list("back").alias("back"))
    marks = found.unionByName(wholes.where("n > 1").select("core", "whole", F.sequence("lo", "hi").alias("back")))
    marks = stage_table(marks, "marks")
    return runs.select("key", "span", "core", "whole").join(marks, ["core", "whole"]).groupBy("key", "span").agg(F.flatten(F.collect_list("back")).alias("back"))


def _hot_runs(batches):
    for b in batches:
        lists = b.column(2)
        begins, ends = [], []
        for own in lists.to_pylist():
            back = np.sort(np.array(own))[::-1]
            x, y = _runs(np.zeros(len(back), int), back, 1)
            begins.append(x[0])
            ends.append(y[0])
        yield _out(np.asarray(b.column(0)), np.asarray(b.column(1)), begins, ends)


COVER = "key long, span long, begins array<int>, ends array<int>"


def _covers(contexts: DataFrame, hot: DataFrame, shards: int) -> DataFrame:
    """Matched ranges (from the anchor on) of distinct spans that share a gram."""
    tagged = contexts.join(hot.withColumn("hot", F.lit(True)), "key", "left")
    columns = ["key", "span", "shape", "n", "bytes"]
    cool = tagged.where("hot is null").select(*columns)
    found = cool.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(_families, COVER)
    hits = _hot_hits(tagged.where("hot").select(*columns))
    return found.unionByName(hits.mapInArrow(_hot_runs, COVER))


def _result(batches):
    for b in tidily(batches):
        data, offsets = text_bytes(b.column(1))
        marks = b.column(2)
        marks = pa.array([[]] * len(marks), marks.type) if marks.null_count == len(marks) else marks
        lists = marks.fill_null([]) if marks.null_count else marks
        flat, ends = lists.flatten(), np.asarray(lists.offsets)
        ends = ends - ends[0]
        begin, end = np.asarray(flat.field(0)), np.asarray(flat.field(1))
        rows = []
        for i in range(len(lists)):
            own = data[offsets[i] : offsets[i + 1]]
            lo, hi = begin[ends[i] : ends[i + 1]], end[ends[i] : ends[i + 1]]
            if not len(lo):
                rows.append((len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
                continue
            change = np.bincount(lo, minlength=len(own) + 1) - np.bincount(hi, minlength=len(own) + 1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(own), int(gone.sum()), spans, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """rid, begin, end: byte ranges that cover all repeated windows of each row (they may overlap)."""
    spark = docs.sparkSession
    small_batches(spark)
    anchors = _numbered(docs).select("rid", "text").mapInArrow(_anchor_rows, "key long, span long, rid long, at long")
    keys = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    keys = stage_table(keys.where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")), "keys")
    release(spark)
    again = stage_table(anchors.join(keys, "key"), "anchors")
    drop_stage(keys)
    release(spark)
    best = F.min(F.struct("rid", "at")).alias("best")
    spans = stage_table(again.where("mixed").groupBy("key", "span").agg(F.count("*").alias("n"), best).select("key", "span", "n", "best.rid", "best.at"), "spans")
    hot = stage_table(spans.groupBy("key").agg(F.count("*").alias("d")).where(F.col("d") > HOT).select("key"), "hot")
    picked = spans.groupBy("rid").agg(F.collect_list(F.struct("key", "span", "at", "n")).alias("spans"))
    texts = _numbered(docs).select("rid", "text").join(picked, "rid").select("text", "spans")
    contexts = stage_table(texts.mapInArrow(_contexts, "key long, span long, shape long, n long, bytes binary"), "contexts")
    release(spark)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spans.count() // 20_000)
    mark = staged()
    covers = stage_table(_covers(contexts, hot, shards), "covers")
    sweep(spark, mark, covers)
    drop_stage(contexts)
    release(spark)
    place, left, right = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    whole = again.where("not mixed").select("rid", (place - left).cast("int").alias("begin"), (place + right).cast("int").alias("end"))
    parts = again.where("mixed").join(covers, ["key", "span"]).select("rid", place.cast("int").alias("place"), F.explode(F.arrays_zip("begins", "ends")).alias("x"))
    return whole.unionByName(parts.select("rid", (F.col("place") + F.col("x.begins")).alias("begin"), (F.col("place") + F.col("x.ends")).alias("end")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    marks = repeated_ranges(docs).groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    return _numbered(docs).join(marks, "rid", "left").select("doc_id", "text", "marks").mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
