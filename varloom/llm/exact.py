"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text without its white space is cut into blocks of ``BLOCK`` characters. Equal
blocks get the same integer name: the smallest number among their occurrences.
Then adjacent pairs of names are named the same way, level by level, until every
document has one name. Names are handed out by comparing the blocks and pairs
themselves, never hashes, so equal identities mean equal texts without exception.
Documents of n blocks end at level ceil(log2 n), and an identity is (level, name).

Skew: a block that makes up more than 1 / ``HOT`` of all blocks is named through a
broadcast of at most ``HOT`` such blocks; all others are joined by content. Pairs
and identities join tables that lie in the shared folder, so that adaptive
execution splits their hot keys. Counts and minima combine before the shuffle.

Defined results: null counts as the empty text; texts of white space only are equal to
it. Of equal texts the one with the most characters (code points) in the original
stays, then the smallest doc_id (null first), then the first row: of repeated rows,
one stays. No rows give no rows. The input must give the same rows in the same
order when it is read again, as files do; write other inputs with ``stage_table`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import drop_stage, fresh, release, stage_table

BLOCK = 16384
HOT = 256
#: Fixed value: the characters that don't count.
SPACES = "\t\n\x0b\x0c\r "


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def blocks_of(text: Column, size: int) -> Column:
    """The text in blocks of ``size`` characters; the empty text is one empty block."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _named_blocks(docs: DataFrame, size: int) -> DataFrame:
    """rid, idx, nb, name; and doc_id, n_chars, sha with the first block of each document."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("norm", without_spaces(F.col("text")))
    blocks = base.select("rid", "doc_id", F.length("text").alias("n_chars"), "norm", blocks_of(F.col("norm"), size).alias("all"))
    blocks = blocks.select("rid", "doc_id", "n_chars", F.sha2("norm", 256).alias("sha"), F.size("all").alias("nb"), F.posexplode("all").alias("idx", "block"))
    names = blocks.select("block", F.monotonically_increasing_id().alias("m")).groupBy("block").agg(F.min("m").alias("name"), F.count("*").alias("n"))
    total = base.agg(F.sum(F.greatest(F.ceil(F.length("norm") / F.lit(size)), F.lit(1)))).first()[0] or 0
    hot = names.where(F.col("n") > max(total / HOT, 1)).select(F.col("block").alias("hot_block"), F.col("name").alias("hot_name"))
    first = lambda c: F.when(F.col("idx") == 0, F.col(c)).alias(c)
    rows = blocks.select("rid", "idx", "nb", "block", first("doc_id"), first("n_chars"), first("sha"))
    rows = rows.join(F.broadcast(hot), F.col("block") == F.col("hot_block"), "left")
    # a row that has its name already gets a key of its own: it meets no block, and if it does, its name is kept
    key = F.when(F.col("hot_name").isNull(), F.col("block")).otherwise(F.concat(F.lit("\x01"), F.col("rid").cast("string"), F.lit("."), F.col("idx").cast("string")))
    rows = rows.select("rid", "idx", "nb", "doc_id", "n_chars", "sha", "hot_name", key.alias("key"))
    cold = names.where(F.col("n") >= 1).select(F.col("block").alias("key"), F.col("name").alias("cold_name"))
    return rows.join(cold, "key", "left").select("rid", "idx", "nb", F.coalesce("hot_name", "cold_name").alias("name"), "doc_id", "n_chars", "sha")


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """rid (the row's number), doc_id, n_chars, sha, and the identity (level, name) of every document."""
    first = stage_table(_named_blocks(docs, size), "blocks")
    release(docs.sparkSession)
    done = first.where("nb = 1").select("rid", "doc_id", "n_chars", "sha", F.lit(0).alias("level"), "name")
    most = first.agg(F.max("nb")).first()[0] or 1
    heads = first.where("nb > 1 and idx = 0").select("rid", "doc_id", "n_chars", "sha")
    now = first.where("nb > 1").select("rid", "idx", "nb", "name")
    level, ends = 0, None
    while most > 1:
        most, level = (most + 1) // 2, level + 1
        even = F.col("idx") % 2 == 0
        pairs = now.groupBy("rid", F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.max("nb").alias("nb"))
        pairs = stage_table(pairs.select("rid", "idx", "a", "b", F.ceil(F.col("nb") / 2).cast("int").alias("nb"), F.monotonically_increasing_id().alias("m")), "pairs")
        names = stage_table(pairs.groupBy("a", "b").agg(F.min("m").alias("name")), "names")
        named = stage_table(pairs.join(names, ["a", "b"]).select("rid", "idx", "nb", "name"), "named")
        drop_stage(pairs)
        drop_stage(names)
        end = named.where("nb = 1").select("rid", F.lit(level).alias("level"), "name")
        ends = end if ends is None else ends.unionByName(end)
        now = named.where("nb > 1")
    if ends is not None:
        done = done.unionByName(heads.join(ends, "rid").select("rid", "doc_id", "n_chars", "sha", "level", "name"))
    return stage_table(done, "identities")


def copies(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    docs_named = identities(docs, size)
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "rid")).alias("best")
    groups = stage_table(docs_named.groupBy("level", "name").agg(F.count("*").alias("group_size"), best).select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "groups")
    return docs_named.join(groups, ["level", "name"]).select("rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def report(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per document, dropped ones too."""
    return copies(docs.select("doc_id", "text"), size).drop("rid")


def drop_copies(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``docs`` without its copies, all columns as they are."""
    rid = fresh(docs, "rid")
    gone = stage_table(copies(docs.select("doc_id", "text"), size).where(~F.col("kept")).select(F.col("rid").alias(rid)), "gone")
    release(docs.sparkSession)
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(gone, rid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
