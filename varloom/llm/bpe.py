"""BPE encoding and decoding with one distinct-word table for the corpus.

1. Texts are split into the words of the byte-level pattern; each chunk of texts gives its distinct words with counts,
   and one aggregation by word makes the table of the corpus' distinct words.
2. Each distinct word is encoded once by the tokenizers library; the table keeps its ids, three bytes each.
3. Ids come back to their positions in the texts. The most frequent words, as many as fit in ``TABLE_BYTES``, are
   broadcast; the positions of all other words travel in a shuffle that joins them with the table by word, and return
   to their document as one sorted list. They meet it as packed ranks of its words, a fourth of the text's size. Most
   positions hold frequent words, so little is shuffled at any size.
4. Ids are decoded by a join with the id-to-piece table of the vocabulary: frequent words once each, before they are
   broadcast; ids at the positions of other words by a look-up in the same table, which is broadcast with them.

The splitter works on whole chunks of texts at once, by the classes of their characters. Texts that hold a special
token, or a character whose class (letter, number, space, other) has changed since Unicode 3.2 or is open, are split by the
library's own pre-tokenizer, as Unicode versions differ there; their words go through the same table. Broadcast words
are found by a 64-bit hash that no other distinct word of the corpus has; words of equal hashes are joined by their bytes.

Defined results: null and empty texts give no ids, the hash of the empty string and an empty decoded text. Repeated
rows give repeated rows. Columns of the input of any name pass ``encode`` and ``decode``; the new column must have a
name of its own (ValueError otherwise). The input must give the same rows in the same order when it is read again, as
files do. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string as parse

from ._common import chunks, drop_stage, fresh, mix64, release, small_batches, stage_table, staged, sweep, text_bytes, tidily, tidy

#: Bytes of the broadcast part of the table.
TABLE_BYTES = 32 << 20
#: Bytes of texts that are split at once; a task holds several arrays of up to eight bytes a character of them.
SLICE = 2 << 20
LETTER, NUMBER, SPACE, OTHER, ODD = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, by the public byte-level rule: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in visible}
    for n, b in enumerate(b for b in range(256) if b not in set(visible)):
        out[chr(256 + n)] = b
    return out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point; ``ODD`` where Unicode 3.2 and the present version differ, where nothing is assigned yet, and beyond the first two planes."""

    def of(version, c: str) -> int:
        kind = version.category(c)
        if c in "\t\n\x0b\x0c\r\x85" or kind[0] == "Z":
            return SPACE
        return {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)

    out = np.full(0x110000, ODD, np.uint8)
    for k in range(0x20000):
        c = chr(k)
        now = of(unicodedata, c)
        if now == of(unicodedata.ucd_3_2_0, c) and unicodedata.category(c) != "Cn":
            out[k] = now
    return out


class Splitter:
    """Words of texts as byte ranges; a special token is a word of its own."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [a["content"] for a in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.special = set(special)
        self.pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = [s.encode() for s in special]

    def by_library(self, text: str) -> list[int]:
        """Where words begin, in characters."""
        out, at = [], 0
        for part in self.pattern.split(text) if self.pattern else [text]:
            if part in self.special:
                out.append(at)
            elif part:
                out += [at + lo for _, (lo, hi) in self.tok.pre_tokenizer.pre_tokenize_str(part) if hi > lo]
            at += len(part)
        return sorted(set(out))

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end (bytes) of all words of some texts, and the number of each text's first word (and the total)."""
        raw = data.tobytes()
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # the byte that each character begins at
        code = data if len(first) == len(data) else np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[code]
        text_at = np.searchsorted(first, offsets)  # in characters
        edge = np.zeros(len(code) + 1, bool)
        edge[text_at] = True
        runs = edge[:-1].copy()
        runs[1:] |= kind[1:] != kind[:-1]
        start = runs.copy()
        # the last space of a run goes with what follows, or stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1])
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        # contractions
        quote = np.flatnonzero((code == 39) & start & (kind == OTHER))
        room = text_at[np.searchsorted(text_at, quote, side="right")] - quote
        ahead = np.concatenate([code, np.zeros(2, code.dtype)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        short = (room > 1) & np.isin(one, [115, 116, 109, 100])  # s t m d
        long = (room > 2) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))  # re ve ll
        for found, n in ((quote[short], 2), (quote[long], 3)):
            start[found + 1] = False
            after = found + n
            after = after[after < len(code)]
            start[after] = True
        odd = set((np.searchsorted(text_at, np.flatnonzero(kind == ODD), side="right") - 1).tolist())
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = raw.find(mark, at + 1)
        for t in odd:
            start[text_at[t] : text_at[t + 1]] = False
            start[text_at[t] + np.array(self.by_library(raw[offsets[t] : offsets[t + 1]].decode("utf-8", "surrogatepass")), int)] = True
        begin = first[start]
        end = np.append(begin[1:], len(data))
        return begin, end, np.searchsorted(begin, offsets)


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


_ODD = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
#: Bytes of a word that are hashed in steps of eight; longer words go to another hash as a whole.
STEPPED = 64


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word.

    Words of equal hashes can be built, so none is told from another by it: the table has every distinct word, and
    words that share a hash there are left out of what is looked up by hash (``_frequent``).
    """
    length = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.uint64, padded.tobytes(), 0, (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = mix64(length.astype(np.uint64) ^ _ODD[0])
    at = np.flatnonzero(length <= STEPPED)
    done = 0
    while len(at):
        chunk = eight[begin[at] + done] & masks[np.minimum(length[at] - done, 8)]
        h[at] = mix64((h[at] ^ chunk) + _ODD[1])
        done += 8
        at = at[length[at] > done]
    for k in np.flatnonzero(length > STEPPED).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def _gather(blob: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of ``blob``, one after another."""
    ends = np.cumsum(size)
    return blob[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def _slices(batches, path: str, text: int):
    """Slices of texts: batch, rows, bytes, offsets, and the words in them."""
    cut = splitter(path)
    for b in tidily(batches):
        data, offsets = text_bytes(b.column(text))
        for i, j in chunks(offsets, SLICE):
            own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            yield b, i, j, own, off, cut.split(own, off)


def _distinct(batches, path: str):
    """Distinct words of each slice, with counts; words are compared byte by byte."""
    for _, _, _, data, _, (begin, end, _) in _slices(batches, path, 0):
        raw = data.tobytes()
        found = Counter()
        for k in range(0, len(begin), 1 << 15):  # few words as objects at a time
            found.update([raw[i:j] for i, j in zip(begin[k : k + (1 << 15)].tolist(), end[k : k + (1 << 15)].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(found.values(), pa.int32())], names=["word", "n"])


def _packed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter((i for own in ids for i in own), ">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    return np.ascontiguousarray(flat).reshape(-1), 3 * np.fromiter(map(len, ids), np.int64)


def _encoded(batches, path: str):
    """Hash and ids (three bytes each, the highest first) of each word."""
    tok = splitter(path).tok
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)  # the same ids, without offsets
    for b in tidily(batches):
        ids = [e.ids for e in encode([w.decode("utf-8", "surrogatepass") for w in b.column(0).to_pylist()], add_special_tokens=False)]
        words = b.column(0).cast(pa.large_binary())
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        h = word_hashes(np.frombuffer(words.buffers()[2] or b"", np.uint8), off[:-1], off[1:])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), b.column(1), _strings(*_packed(ids))], names=["word", "h", "n", "code"])


def _vocabulary(path: str | None) -> dict[int, bytes]:
    """The piece of every id, special tokens included."""
    spec = json.load(open(path or default_path(), encoding="utf-8"))
    alphabet = byte_alphabet()
    table = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return table | {a["id"]: a["content"].encode() for a in spec["added_tokens"]}


def pieces(spark, path: str | None = None) -> DataFrame:
    """id, piece (bytes) of the vocabulary, special tokens included."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in sorted(_vocabulary(path).items())], "id int, piece binary")


def word_table(docs: DataFrame, text: str, path: str) -> DataFrame:
    """word, h, n, code (ids) of every distinct word of a column: a staged table."""
    words = docs.select(text).mapInArrow(lambda b: _distinct(b, path), "word binary, n int").groupBy("word").agg(F.sum("n").alias("n"))
    coded = stage_table(words.mapInArrow(lambda b: _encoded(b, path), "word binary, h long, n long, code binary"), "words")
    release(docs.sparkSession)
    return coded


class Frequent:
    """The broadcast part of the table: entries by rank (most frequent first), as flat arrays, and the ranks by hash."""

    def __init__(self, rows: pa.Table, vocabulary: dict[int, bytes]):
        """``rows``: h, seen (occurrences), n (ids), ids_text (each id with a comma), decoded. ``vocabulary``: the piece of every id."""
        top = max(vocabulary, default=-1) + 1
        self.of_id = [self._list([f"{i},".encode() for i in range(top)]), self._list([vocabulary.get(i, b"") for i in range(top)])]
        h = rows.column("h").to_numpy().view(np.uint64)
        by = np.lexsort((h, -rows.column("seen").to_numpy()))
        self.n = rows.column("n").to_numpy().astype(np.int64)[by]
        self.rank = np.argsort(h[by], kind="stable")
        self.h = h[by][self.rank]
        (self.ids, self.ids_at, self.ids_size), (self.decoded, self.decoded_at, self.decoded_size) = (self._flat(rows.column(c), by) for c in ("ids_text", "decoded"))

    @staticmethod
    def _flat(column: pa.ChunkedArray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        return np.frombuffer(column.buffers()[2] or b"", np.uint8), off[:-1][by], np.diff(off)[by]

    @staticmethod
    def _list(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def read(self, codes: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Number of ids of each packed word; decimal ids and decoded bytes of all, with each word's length."""
        planes = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 3).astype(np.int64)
        ids = (planes[:, 0] << 16) | (planes[:, 1] << 8) | planes[:, 2]
        n = np.array([len(c) for c in codes], np.int64) // 3
        out = []
        for blob, at, size in self.of_id:
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            out.append((_gather(blob, at[ids], size[ids]), np.diff(ends[np.concatenate([[0], np.cumsum(n)])])))
        return n, out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The rank of each hash; the number of entries where there is none."""
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.rank[at], len(self.h))


def _ids(code: str):
    """The ids of a packed word that has some, as an array."""
    return F.expr(f"transform(sequence(0, length({code}) div 3 - 1), i -> cast(conv(hex(substring({code}, 3 * i + 1, 3)), 16, 10) as int))")


def _frequent(table: DataFrame, path: str) -> tuple[Frequent, int]:
    """The most frequent words that fit in ``TABLE_BYTES`` together, those of a hash of their own, and the number of all others."""
    size = F.lit(56) + 2 * F.length("code") + F.length("word")
    alone = table.groupBy("h").agg(F.count("*").alias("same")).where("same > 1").select("h")
    usable = table.where(F.length("code") > 0).join(stage_table(alone, "hashes"), "h", "left_anti")
    level = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(usable.groupBy(level.alias("level")).agg(F.sum(size).alias("bytes"), F.count("*").alias("words")).collect(), key=lambda r: -r.level)
    least, taken, words = 1 << 30, 0, 0
    for r in bins:
        if taken + r.bytes > TABLE_BYTES:
            break
        least, taken, words = r.level, taken + r.bytes, words + r.words
    each = usable.where(level >= least).select("h", "n", F.posexplode(_ids("code")).alias("k", "id")).join(F.broadcast(pieces(table.sparkSession, path)), "id")  # as large as the vocabulary
    lists = each.groupBy("h").agg(F.max("n").alias("seen"), F.sort_array(F.collect_list(F.struct("k", "id", F.hex("piece").alias("p")))).alias("all"))
    ids_text = F.concat(F.concat_ws(",", F.transform("all", lambda x: x["id"].cast("string"))), F.lit(","))
    rows = lists.select("h", "seen", F.size("all").alias("n"), ids_text.alias("ids_text"), F.unhex(F.concat_ws("", F.transform("all", lambda x: x["p"]))).alias("decoded")).toArrow()
    return Frequent(rows, _vocabulary(path)), table.count() - words


def _rare(batches, path: str, shared):
    """Document, place and word of every position whose word isn't broadcast."""
    frequent: Frequent = shared.value
    for b, i, _, data, _, (begin, end, first) in _slices(batches, path, 1):
        rid = np.asarray(b.column(0))
        at = np.flatnonzero(frequent.find(word_hashes(data, begin, end)) == len(frequent.h))
        size = (end - begin)[at]
        text = np.searchsorted(first, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(rid[i + text]), pa.array((at - first[text]).astype(np.int64)), _strings(_gather(data, begin[at], size), size)], names=["rid", "place", "word"])


def _coded(batches, path: str, shared):
    """Ranks of the words of every row, as packed planes of three bytes: frequent words have empty high planes."""
    frequent: Frequent = shared.value
    pack = zstandard.ZstdCompressor(level=3).compress
    for b, i, j, data, _, (begin, end, first) in _slices(batches, path, 1):
        planes = frequent.find(word_hashes(data, begin, end)).astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]
        yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([pack(planes[x:y].T.tobytes()) for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["rid", "codes"])


def _assembled(batches, shared, make, schema: pa.Schema):
    """What ``make`` makes of the ids (decimal text, each with a comma), the decoded bytes and the number of ids of every row."""
    frequent: Frequent = shared.value
    unpack = zstandard.ZstdDecompressor().decompress
    for b in tidily(batches):
        size = np.array([zstandard.frame_content_size(c) for c in b.column(1).to_pylist()], np.int64) // 3
        for i, j in chunks(np.concatenate([[0], np.cumsum(size)]), SLICE // 2):
            planes = [np.frombuffer(unpack(c), np.uint8).reshape(3, -1).astype(np.int64) for c in b.column(1)[i:j].to_pylist()]
            at = np.concatenate([p[0] | (p[1] << 8) | (p[2] << 16) for p in planes])
            first = np.concatenate([[0], np.cumsum(size[i:j])])
            many, own = frequent.read(b.column(2)[i:j].flatten().field(1).to_pylist())
            miss = np.flatnonzero(at == len(frequent.h))
            known = np.where(at == len(frequent.h), 0, at)
            blobs, ends = [], []
            for (rest, length), blob, begins, sizes in ((own[0], frequent.ids, frequent.ids_at, frequent.ids_size), (own[1], frequent.decoded, frequent.decoded_at, frequent.decoded_size)):
                where, much = (begins[known], sizes[known]) if len(sizes) else (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))
                where[miss], much[miss] = len(blob) + np.cumsum(length) - length, length
                blobs.append(_gather(np.concatenate([blob, rest]), where, much).tobytes())
                ends.append(np.concatenate([[0], np.cumsum(much)])[first])
            n = frequent.n[known] if len(frequent.n) else np.zeros(len(at), np.int64)
            n[miss] = many
            total = np.concatenate([[0], np.cumsum(n)])[first]
            out = [make(blobs[0][ends[0][k] : ends[0][k + 1]], blobs[1][ends[1][k] : ends[1][k + 1]], int(total[k + 1] - total[k])) for k in range(j - i)]
            cells = [pa.array([row[c] for row in out], field.type) for c, field in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *cells], names=["rid", *schema.names])


def _digest(ids: bytes, decoded: bytes, n: int) -> tuple[int, str, str]:
    text = decoded.decode("utf-8", "replace").encode()
    return n, hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()


def _id_list(ids: bytes, decoded: bytes, n: int) -> tuple[list[int]]:
    return ([int(x) for x in ids[:-1].split(b",")] if n else [],)


def _through_table(docs: DataFrame, text: str, path: str, make, schema: str) -> DataFrame:
    """rid (place of the row) and what ``make`` gives."""
    spark, mark = docs.sparkSession, staged()
    small_batches(spark)
    table = word_table(docs, text, path)
    found, others = _frequent(table, path)
    shared = spark.sparkContext.broadcast(found)
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(text).cast("string").alias("text"))
    none = F.array().cast("array<struct<place:bigint,code:binary>>")
    coded = numbered.mapInArrow(lambda b: _coded(b, path, shared), "rid long, codes binary")
    arrow = to_arrow_schema(parse(schema))
    if others:
        rare = numbered.mapInArrow(lambda b: _rare(b, path, shared), "rid long, place long, word binary")
        # dealt by document as flat rows and gathered there
        placed = rare.join(table.select("word", "code"), "word").select("rid", "place", "code").repartition("rid")
        lists = placed.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rest"))
        lists = stage_table(lists, "rest")
        drop_stage(table)
        release(spark)
        coded = coded.join(lists, "rid", "left").withColumn("rest", F.coalesce("rest", none))
    else:
        coded = coded.withColumn("rest", none)
    out = stage_table(coded.mapInArrow(lambda b: _assembled(b, shared, make, arrow), f"rid long, {schema}"), "assembled")
    shared.destroy()
    del shared, found
    sweep(spark, mark, out)
    release(spark)
    tidy()
    return out


def _own_name(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already")


def _with(df: DataFrame, found: DataFrame, column: str, into: str) -> DataFrame:
    rid = fresh(df, "rid")
    return df.withColumn(rid, F.monotonically_increasing_id()).join(found.select(F.col("rid").alias(rid), F.col(column).alias(into)), rid).select(*(F.col(f"`{c}`") for c in df.columns), into)


def encode(df: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with an array of token ids."""
    _own_name(df, into)
    return _with(df, _through_table(df, text, path or default_path(), _id_list, "found array<int>"), "found", into)


def _texts(batches):
    for b in tidily(batches):
        parts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(p or ()).decode("utf-8", "replace") for p in parts], pa.string())], names=["rid", "found"])


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of its token ids, by a join with the id-to-piece table; a null array gives an empty text, an unknown id nothing."""
    _own_name(df, into)
    numbered = df.select(F.monotonically_increasing_id().alias("rid"), F.col(ids).alias("all"))
    each = numbered.select("rid", F.posexplode("all").alias("k", "id")).join(F.broadcast(pieces(df.sparkSession, path)), "id")  # as large as the vocabulary
    lists = each.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]).alias("parts"))
    found = numbered.select("rid").join(lists, "rid", "left").mapInArrow(_texts, "rid long, found string")
    return _with(df, found, "found", into)


def corpus_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, of its whole text."""
    found = _through_table(docs.select("doc_id", "text"), "text", path or default_path(), _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    names = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"))
    return names.join(found, "rid").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
