import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varloom.llm import bpe
from varloom.llm._common import text_bytes

TEXTS = [None, "", " ", "Hello world, it's 2024!\n\n  done ", "<|endoftext|>a<|endoftext|>", "naïve café — ßü€", "日本語 🤦🏼‍♂️ x՘", "a" * 5000, "word " * 3000, "՘ᵺ0 new letters", "tab\tand\r\nline\x0b\x0c\x85　end"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_digests_equal_the_library(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[3]), (1, TEXTS[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.corpus_digests(spark.read.parquet(str(tmp_path / "t"))).collect()]
    assert sorted(got) == sorted((i, *expected(library, t)) for i, t in rows)


def test_round_trip_and_other_columns(spark, tmp_path):
    spark.createDataFrame([(1, t, 7) for t in TEXTS], "rid long, text string, d long").write.parquet(str(tmp_path / "t"))
    coded = bpe.encode(spark.read.parquet(str(tmp_path / "t")))
    coded.write.parquet(str(tmp_path / "u"))
    out = bpe.decode(spark.read.parquet(str(tmp_path / "u")))
    assert out.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert out.columns == ["rid", "text", "d", "ids", "decoded"] and out.where("d = 7").count() == len(TEXTS)
    with pytest.raises(ValueError):
        bpe.encode(coded)


@pytest.mark.parametrize("bound", [0, 4000])
def test_words_beyond_the_broadcast_part(spark, tmp_path, library, monkeypatch, bound):
    """Positions join the table in a shuffle where the broadcast part is full; every script goes through the same table."""
    monkeypatch.setattr(bpe, "TABLE_BYTES", bound)
    monkeypatch.setattr(bpe, "SLICE", 300)
    r = random.Random(2)
    words = ["слово", "λόγος", "日本語", "한국어", "كلمة", "🤦🏼‍♂️", "word", "naïve", "it's", "<|endoftext|>", "12", "\u0558", "x"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", ""]) for _ in range(r.randrange(60)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.corpus_digests(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got == {i: expected(library, t) for i, t in rows}


def test_splitter_equals_the_library():
    cut, r = bpe.Splitter(bpe.default_path()), random.Random(1)
    alphabet = [*"ab'sstrevldm  \n\t\r 12!?é日", "'s", "'re", "'ll", "<|endoftext|>", "\u0558", "\x85", "\u3000", "\x1c", "\u200b", "\u1c89"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(25))) for _ in range(4000)]
    data, offsets = text_bytes(pa.array(texts))
    begin, end, first = cut.split(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        at = cut.by_library(t)
        assert [raw[x:y].decode() for x, y in zip(begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)] == [t[x:y] for x, y in zip(at, [*at[1:], len(t)], strict=False)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.corpus_digests(df).count() == 0


def test_words_built_to_collide_keep_their_ids(spark, tmp_path, library):
    """Two words of one hash, side by side, apart, and as parts of texts that also hold neither."""
    one, other = "gtbtjwyaaaadaaa", "rybentokyxxzkvp"
    h = bpe.word_hashes(np.frombuffer(f" {one} {other}".encode(), np.uint8), np.array([0, 16]), np.array([16, 32]))
    assert h[0] == h[1]
    texts = [f"z {one} {other}", f"z {other}", f"z {one}", "z", f"{other} {one} {other} {one}"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.corpus_digests(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got == {i: expected(library, t) for i, t in rows}
