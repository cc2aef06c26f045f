"""MinHash near-dedup with HyperMinHash registers.

A document's set holds the hashes (64 bits) of its distinct shingles of ``shingle`` words (``SHINGLE`` unless given); words are hashed with a
secret key of the run. Documents of equal sets (of equal size and two sums of 64 bits each) form a class. A class of ``SMALL`` shingles or more has a sketch: the hashes are dealt to ``BUCKETS`` buckets, and a
bucket's register of 16 bits holds the number of leading zeros of its smallest hash and ``MANTISSA`` bits after the first one.

1. Candidates: classes that agree in a band of ``BAND`` registers, empty ones filled by those of other buckets. Sets too small for a sketch use their smallest
   hashes instead (prefix filter, exact); sets up to 1.25 times larger use both, so no pair falls between. A pair of
   similarity 0.8 agrees in no band with probability under 1e-6.
2. Each bucket of candidates is compared with its best-connected member, so comparisons are fewer than members. A pair
   whose similarity estimated from the registers, less the expected register collisions, lies over six
   deviations below the limit is dropped. The rest is compared on full sets.
3. Links give components. In a bucket that lies in one component nothing is left to find. In the others, a member
   that shares too few shingles with anything (it has more private ones than the limit allows) is done; the rest
   is compared with the member of fewest private shingles, its heart. In groups around a heart that still lie in several
   components, members outside the largest component look up what they share with others, by an index of what sets members
   apart. One task settles a group of ``GROUP`` members and ``WEIGHT`` shingles at most. Larger groups are dealt to blocks, and each
   block of members that look up meets each block of the group in a task of its own (``_split``). So no link is
   lost, no larger group is gathered, and members of one component are not compared.

Defined results: null, empty and white-space texts have the empty set and are linked with nothing. Fewer words than
a shingle make one shingle. Repeated rows are of one class. A component is named by its smallest doc_id (null
first). The input must give the same rows in the same order when it is read again, as files do. Other columns are
not read, and pass ``drop_near`` as they are.
"""

from __future__ import annotations

import hashlib
import secrets
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import chunks, drop_stage, fresh, mix64, release, small_batches, stage_table, staged, sweep, text_bytes, tidily
from .graph import components

SHINGLE = 4
PERCENT = 80
BUCKETS, MANTISSA, BAND = 128, 10, 4
SMALL = 64
#: Members that one task settles, and shingles of all of them; the share of both that is left to members that look up, in larger groups.
GROUP, WEIGHT, ASKING = 8192, 1 << 22, 0.25
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


#: Fixed rule: A to Z as small letters; words are parted by what ``bytes.split`` parts at, [\x20\x09-\x0D].
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """A keyed hash (64 bits) of each word, computed once for each distinct word.

    Every run draws a key of its own on the driver, so nobody can build words, or texts of them, that collide.
    """

    #: Words whose hashes are kept; others are hashed again.
    KEPT = 1 << 16

    def __init__(self, key: bytes = b"words"):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(self) < self.KEPT:
            self[word] = h
        return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, hashes: WordHashes | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = data.tobytes().translate(_LOWER)
    at = offsets.tolist()
    texts = [raw[i:j].split() for i, j in zip(at[:-1], at[1:], strict=True)]
    per = np.cumsum([0, *map(len, texts)])
    words = np.fromiter(map((hashes if hashes is not None else WordHashes()).__getitem__, chain.from_iterable(texts)), np.uint64, int(per[-1]))
    del texts
    h = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        h = mix64((h ^ words[k : k + len(h)]) + _ODD[k % 6])
    out = []
    for i, j in zip(per[:-1].tolist(), per[1:].tolist(), strict=True):
        if j - i >= size:
            out.append(np.unique(h[i : j - size + 1]))
        elif j > i:
            one = np.array([j - i], np.uint64)
            for k in range(i, j):
                one = mix64((one ^ words[k]) + _ODD[(k - i) % 6])
            out.append(mix64(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_BITS = np.uint64(BUCKETS.bit_length() - 1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 if empty, else leading zeros + 1 and the mantissa."""
    starts = np.searchsorted(hashes, np.arange(BUCKETS, dtype=np.uint64) << (np.uint64(64) - _BITS))
    ends = np.concatenate([starts[1:], [len(hashes)]])
    rest = (hashes[np.minimum(starts, len(hashes) - 1)] << _BITS) >> np.uint64(11)  # 53 bits
    zeros = (53 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint64)
    mantissa = ((rest << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)) >> np.uint64(53 - MANTISSA)
    register = ((np.minimum(zeros, np.uint64(62)) + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    return np.where(ends > starts, register, 0).astype(np.uint16)


def prefix(n: int) -> int:
    """Smallest hashes of which a set of n shares one with every similar set."""
    return n - -(-PERCENT * n // 100) + 1


def _collision_table() -> np.ndarray:
    """Chance that the smallest of two disjoint draws share a register, for 2**(k/2) hashes a bucket on average (at least one in each)."""
    zeros = np.repeat(np.arange(54), 64)
    low = 2.0 ** -(zeros + 1.0) * (1 + np.tile(np.arange(64), 54) / 64)
    high = low + 2.0 ** -(zeros + 1.0) / 64
    load = 2.0 ** (np.arange(-2, 60) / 2)[:, None]
    cell = (np.exp(-load * low) - np.exp(-load * high)) / -np.expm1(-load)
    return (cell * cell).sum(1) * 64 / 2**MANTISSA  # 64 cells of the mantissa stand for all


_COLLISIONS = _collision_table()


def collisions(n: np.ndarray) -> np.ndarray:
    """Chance of a register collision between different sets of about n hashes."""
    return np.interp(2 * np.log2(np.maximum(n, 1) / BUCKETS), np.arange(-2, 60), _COLLISIONS)


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of registers of sets of about n hashes, and the number of buckets that it rests on.

    Of ``used`` buckets, those of different smallest hashes collide by chance p: same = true + (used - true) p.
    """
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    p = collisions(n)
    return np.maximum(same - used * p, 0) / (1 - p) / np.maximum(used, 1), used


def _summaries(batches, shingle: int, key: bytes):
    hashes = WordHashes(key)
    for b in tidily(batches):
        rid, doc_id = b.column(0), b.column(1)
        data, offsets = text_bytes(b.column(2))
        for i, j in chunks(offsets, 1 << 20):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, hashes)
            n = np.array([len(s) for s in sets])
            one = np.array([(s * _ODD[0]).sum() if len(s) else 0 for s in sets], np.uint64)
            two = np.array([mix64(s ^ _ODD[1]).sum() if len(s) else 0 for s in sets], np.uint64)
            small = [s[: prefix(len(s))].view(np.int64) if 0 < len(s) <= SMALL * 100 // PERCENT else None for s in sets]
            large = [sketch(s).tobytes() if len(s) >= SMALL else None for s in sets]
            yield pa.RecordBatch.from_arrays([rid[i:j], doc_id[i:j], pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(small, pa.list_(pa.int64())), pa.array(large, pa.binary())], names=["rid", "doc_id", "n", "f1", "f2", "low", "regs"])


_DONORS = np.stack([np.random.default_rng(41 + k).permutation(BUCKETS) for k in range(64)])


def dense(registers: np.ndarray) -> np.ndarray:
    """Rows of registers whose empty ones take the value of the first filled one in an order of their own, the same for all sets."""
    out = registers.copy()
    for donors in _DONORS:
        if out.all():
            break
        out = np.where(out == 0, registers[:, donors], out)
    return out


def _keys(batches):
    """Bucket keys of each class."""
    for b in batches:
        cid = np.asarray(b.column(0))
        low, regs = b.column(1), b.column(2)
        keys, ids = [], []
        some = np.flatnonzero(~np.asarray(regs.is_null()))
        if len(some):
            r = np.frombuffer(b"".join(regs.take(pa.array(some)).to_pylist()), np.uint16).reshape(len(some), BUCKETS)
            r = dense(r).reshape(len(some), -1, BAND).astype(np.uint64)
            h = np.full(r.shape[:2], 3, np.uint64) + np.arange(r.shape[1], dtype=np.uint64) * _ODD[4]
            for k in range(BAND):
                h = mix64(h ^ (r[:, :, k] * _ODD[k]))
            keys.append(h.ravel())
            ids.append(np.repeat(cid[some], h.shape[1]))
        flat, ends = np.asarray(low.flatten()), np.asarray(low.offsets)
        lengths = np.where(np.asarray(low.is_null()), 0, np.diff(ends))
        keys.append(mix64(flat.view(np.uint64) ^ _ODD[5]) if len(flat) else np.zeros(0, np.uint64))
        ids.append(np.repeat(cid, lengths))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "cid"])


def _likely(batches):
    """Pairs whose estimate doesn't rule them out; pairs without two sketches stay."""
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        ra, rb, n = b.column(2), b.column(3), np.asarray(b.column(4))
        some = np.flatnonzero(~(np.asarray(ra.is_null()) | np.asarray(rb.is_null())))
        for i in range(0, len(some), 4096):
            at = pa.array(some[i : i + 4096])
            x, y = (np.frombuffer(b"".join(c.take(at).to_pylist()), np.uint16).reshape(len(at), -1) for c in (ra, rb))
            got, used = similarity(x, y, n[some[i : i + 4096]])
            keep[some[i : i + 4096]] = got >= PERCENT / 100 - 6 * np.sqrt(0.16 / np.maximum(used, 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _sets(batches, shingle: int, key: bytes):
    hashes = WordHashes(key)
    for b in tidily(batches):
        data, offsets = text_bytes(b.column(1))
        for i, j in chunks(offsets, 1 << 20):
            sets = [s.view(np.int64) for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, hashes)]
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(sets, pa.list_(pa.int64()))], names=["cid", "hashes"])


class _Links:
    """Verified links between classes, and the components they make."""

    def __init__(self, classes: DataFrame, sets: DataFrame):
        self.sketches, self.sets, self.links = classes.select("cid", "n", "regs"), sets, None
        self.labels = None

    def verify(self, pairs: DataFrame) -> bool:
        """Compare pairs (a, b); True if new links were found."""
        side = lambda k: self.sketches.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))
        pairs = stage_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
        likely = stage_table(both.select("a", "b", "ra", "rb", ((F.col("na") + F.col("nb")) / 2).alias("n")).mapInArrow(_likely, "a long, b long"), "likely")
        of = lambda k: self.sets.select(F.col("cid").alias(k), F.col("hashes").alias(f"h{k}"))
        full = likely.join(of("b"), "b").join(of("a"), "a").select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("i"))
        new = stage_table(full.where(100 * F.col("i") >= PERCENT * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), "found")
        drop_stage(pairs)
        drop_stage(likely)
        if not new.limit(1).count():
            return False
        self._take(new)
        return True

    def add(self, found: DataFrame) -> None:
        """Links (a, b) that are verified already."""
        new = stage_table(found, "found")
        if new.limit(1).count():
            self._take(new)

    def _take(self, new: DataFrame) -> None:
        self.links = new if self.links is None else self.links.unionByName(new)
        self.labels = components(self.links)

    def label(self, df: DataFrame, by: str = "cid", into: str = "comp") -> DataFrame:
        """``df`` with the component of a column."""
        if self.labels is None:
            return df.withColumn(into, F.col(by))
        return df.join(self.labels.select(F.col("v").alias(by), F.col("label").alias(into)), by, "left").withColumn(into, F.coalesce(into, by))


def _open(members: DataFrame, links: _Links) -> DataFrame:
    """``members`` (key, cid, more) with comp, those of buckets that lie in more than one component."""
    now = stage_table(links.label(members), "now")
    split = stage_table(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "split")
    return now.join(split, "key", "left_semi")


def _spanning(batches):
    """Links (a, b) that join the members of each part, of those that are in different components and similar and of which one asks; parts lie together."""
    held = None

    def settle(group):
        cid, comp, ask, sets = (np.concatenate(g) if k < 3 else sum(g, []) for k, g in enumerate(group))
        n, size = np.array([len(x) for x in sets]), len(sets)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(size), n)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        token = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
        count = np.bincount(token)
        # shingles of most members count by those that lack them, so what a family has in common costs nothing
        usual = 2 * count > size
        has = np.zeros((int(usual.sum()), size), bool)
        has[(np.cumsum(usual) - 1)[token[usual[token]]], owner[usual[token]]] = True
        lacked, lacks = np.nonzero(~has)
        shared = ((count > 1) & ~usual)[token]
        place = np.concatenate([token[shared], len(count) + lacked])
        holder = np.concatenate([owner[shared], lacks])
        more, base, lack = np.bincount(place), len(has), np.bincount(lacks, minlength=size)
        starts = np.cumsum(more) - more
        order = np.argsort(holder, kind="stable")
        own, ends = place[order], np.searchsorted(holder[order], np.arange(size + 1))
        of = np.unique(comp, return_inverse=True)[1]
        out = []
        for x in np.flatnonzero(ask).tolist():
            mine = own[ends[x] : ends[x + 1]]
            length = more[mine]
            at = np.repeat(starts[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            both = np.bincount(holder[at], minlength=size) + base - lack[x] - lack
            for y in np.flatnonzero((100 * both >= PERCENT * (n[x] + n - both)) & (of != of[x])).tolist():
                if of[x] != of[y]:
                    out.append((cid[x], cid[y]))
                    of[of == of[y]] = of[x]
        return out

    def emit(rows):
        a, b = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for b in batches:
        part = np.asarray(b.column(0))
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        rows = []
        for i, j in zip(cut, [*cut[1:], len(part)], strict=True):
            if held is not None and held[0] != part[i]:
                rows += settle(held[1:])
                held = None
            held = held or (part[i], [], [], [], [])
            for k in (1, 2, 3):
                held[k].append(np.asarray(b.column(k)[i:j]))
            flat, ends = np.asarray(b.column(4)[i:j].flatten()), np.asarray(b.column(4)[i:j].offsets)
            ends = ends - ends[0]
            held[4].append([flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
        yield emit(rows)
    if held is not None:
        yield emit(settle(held[1:]))


def _rest(members: DataFrame, classes: DataFrame, links: _Links) -> None:
    """Compare what comparisons with the first members have left open."""
    left = stage_table(_open(members.select("key", "cid"), links), "open")
    if not left.limit(1).count():
        drop_stage(left)
        return
    ids = left.select("cid").distinct()
    tokens = links.sets.join(ids, "cid", "left_semi").select("cid", F.explode("hashes").alias("h"))
    counts = tokens.groupBy("h").agg(F.count("*").alias("c"), F.min("cid").alias("cid"))
    private = counts.where("c = 1").groupBy("cid").agg(F.count("*").alias("p"))
    facts = ids.join(classes.select("cid", "n"), "cid").join(private, "cid", "left").select("cid", F.col("n").cast("long").alias("n"), F.coalesce("p", F.lit(0)).alias("p"))
    known = stage_table(left.join(facts, "cid"), "known")
    drop_stage(left)
    best = stage_table(known.groupBy("key").agg(F.max(F.col("n") - F.col("p")).alias("most"), F.min("n").alias("least"), F.min("p").alias("fewest")), "best")
    # no partner shares more than ``shared`` with a member, and together they have at least ``union``
    shared = F.least(F.col("n") - F.col("p"), F.col("most"))
    union = F.greatest(F.col("n") + F.col("fewest"), F.col("n") + F.col("least") - shared)
    alive = stage_table(known.join(best, "key").where(100 * shared >= PERCENT * union).select("key", "cid", "comp", "n", "p"), "alive")
    drop_stage(known)
    drop_stage(best)
    heart = alive.groupBy("key").agg(F.min(F.struct("p", "cid", "comp")).alias("c")).select("key", F.col("c.cid").alias("a"), F.col("c.comp").alias("other"))
    heart = stage_table(heart, "hearts")
    links.verify(alive.join(heart, "key").where("comp <> other").select("a", F.col("cid").alias("b")))
    last = _open(alive.select("key", "cid", "n"), links).join(heart.select("key", F.col("a").alias("heart")), "key").where("cid <> heart").groupBy("heart", "cid").agg(F.min("comp").alias("comp"), F.min("n").alias("n"))
    last = stage_table(last, "last")
    drop_stage(alive)
    drop_stage(heart)
    comps = last.groupBy("heart", "comp").agg(F.count("*").alias("c"))
    largest = comps.groupBy("heart").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    asked = last.join(largest.select("heart", F.col("m.comp").alias("most")), "heart").withColumn("ask", F.col("comp") != F.col("most"))
    # in tasks: a group, and its members that ask
    fill = lambda x: F.greatest(F.count(x) / GROUP, F.sum(x) / WEIGHT)
    sizes = stage_table(asked.groupBy("heart").agg(fill(F.col("n")).alias("full"), fill(F.when(F.col("ask"), F.col("n"))).alias("asking")), "sizes")
    parts = asked.join(sizes.where("full <= 1").select("heart"), "heart", "left_semi").select(F.col("heart").alias("part"), "cid", "comp", "ask")
    if sizes.where("full > 1").limit(1).count():
        parts = parts.unionByName(_split(asked.join(sizes.where("full > 1"), "heart")))
    tasks = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = parts.join(links.sets, "cid").select("part", "cid", "comp", "ask", "hashes")
    links.add(whole.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_spanning, "a long, b long"))
    drop_stage(last)
    drop_stage(sizes)


def _split(members: DataFrame) -> DataFrame:
    """part, cid, comp, ask: the members of groups (heart, cid, comp, ask, full, asking) that are too large for one task, by task.

    A group is dealt to blocks, and its members that ask once more to blocks of their own. A part has one block of each
    kind, and there is a part for every two, so whoever asks meets all others of the group.
    """
    count = lambda tasks, share: F.ceil(F.col(tasks) / share).cast("int")
    dealt = members.withColumn("blocks", count("full", 1 - ASKING)).withColumn("askers", count("asking", ASKING)).withColumn("at", F.xxhash64("cid"))
    own = lambda n: F.expr(f"cast(pmod(at, {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hold = dealt.withColumn("i", every("askers")).withColumn("j", own("blocks")).withColumn("ask", F.lit(False))
    seek = dealt.where("ask").withColumn("i", own("askers")).withColumn("j", every("blocks"))
    return hold.unionByName(seek).select(F.xxhash64("heart", "i", "j").alias("part"), "cid", "comp", "ask")


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, keep_rid (the row of that id) of every row."""
    spark, mark = docs.sparkSession, staged()
    key = secrets.token_bytes(16)  # travels with the tasks, so a task that runs again hashes alike
    small_batches(spark)
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage_table(numbered.mapInArrow(lambda b: _summaries(b, shingle, key), "rid long, doc_id long, n long, f1 long, f2 long, low array<long>, regs binary"), "rows")
    best = F.min(F.struct("doc_id", "rid")).alias("best")
    classes = rows.where("n > 0").groupBy("f1", "f2").agg(best, F.max("n").alias("n"), F.max("low").alias("low"), F.max("regs").alias("regs"))
    classes = stage_table(classes.select("f1", "f2", "best", F.col("best.rid").alias("cid"), "n", "low", "regs"), "classes")
    keys = classes.select("cid", "low", "regs").mapInArrow(_keys, "key long, cid long")
    buckets = stage_table(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stage_table(keys.join(buckets, "key"), "members")
    # the member that shares buckets with most others is likely to be a bucket's heart, and the same one in many buckets
    shared = stage_table(members.groupBy("cid").agg(F.sum("size").alias("fame")), "fame")
    hearts = members.join(shared, "cid").groupBy("key").agg(F.max(F.struct("fame", (-F.col("cid")).alias("m"))).alias("best"))
    hearts = stage_table(hearts.select("key", (-F.col("best.m")).alias("first")), "hearts")
    release(spark)
    texts = numbered.select(F.col("rid").alias("cid"), "text").join(members.select("cid").distinct(), "cid", "left_semi")
    sets = stage_table(texts.mapInArrow(lambda b: _sets(b, shingle, key), "cid long, hashes array<long>"), "sets")
    release(spark)
    links = _Links(classes, sets)
    links.verify(members.join(hearts, "key").where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")))
    _rest(members.where("size > 2"), classes, links)
    drop_stage(members)
    drop_stage(sets)
    release(spark)
    if links.labels is None:
        of_class = classes.select("f1", "f2", "best")
    else:
        ends = stage_table(links.labels.join(classes.select(F.col("cid").alias("v"), "best"), "v"), "ends")
        names = stage_table(ends.groupBy("label").agg(F.min("best").alias("whole")), "names")
        whole = ends.join(names, "label").select(F.col("v").alias("cid"), "whole")
        of_class = classes.select("f1", "f2", "cid", "best").join(whole, "cid", "left").select("f1", "f2", F.coalesce("whole", "best").alias("best"))
    of_class = stage_table(of_class, "of_class")
    sweep(spark, mark, rows, of_class)
    out = rows.select("rid", "doc_id", "n", "f1", "f2").join(of_class, ["f1", "f2"], "left")
    alone = F.col("n") == 0
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), F.when(alone, F.col("rid")).otherwise(F.col("best.rid")).alias("keep_rid"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return groups(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, all columns as they are."""
    rid, mark = fresh(docs, "rid"), staged()
    gone = stage_table(groups(docs.select("doc_id", "text"), shingle).where("rid <> keep_rid").select(F.col("rid").alias(rid)), "gone")
    sweep(docs.sparkSession, mark, gone)
    release(docs.sparkSession)
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(gone, rid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
