"""Language identification by hierarchical discrimination.

A text is first given to a language family, by one linear support vector machine
for each family; within the family, one-versus-one linear support vector machines
vote between its languages. Languages that ``FAMILIES`` doesn't list are each a
family of their own.

Features are counts of letter n-grams (1 to ``ORDERS``) of the whole text in lower case,
hashed into ``WIDTH`` buckets for each order, as square roots and scaled to length 1. A
text is read in pieces of bounded size whose counts are added up, so very long texts need
no more memory. Models are trained here by averaged stochastic gradient descent on the
hinge loss, from at most ``SAMPLE`` rows of each language, those of smallest hash, cut to
``LEARNT`` characters, six pieces from all over the text where it is longer (only for learning).

Defined results: null texts and texts without a letter are ``und`` with score 0. Without any row to
learn from every text is ``und`` with score 0; with one language every other text is that language with
score 1. Equal votes go to the larger sum of margins, then to the first language by name. Equal
texts get equal results. Rows of null doc_id don't teach. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import small_batches, tidy

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
}
ORDERS = 3
WIDTH = 4096
SAMPLE = 600
LEARNT = 6000
EPOCHS = 6
PIECE = 1 << 20
RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs.split()), lang)


def _counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams (text x feature). Whatever is no letter counts as a blank, runs of blanks as one."""
    out = np.zeros(len(texts) * ORDERS * WIDTH, np.int64)
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    codes = np.where(_letters(codes), codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, row = codes[keep].astype(np.uint32), row[keep]
    h = np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        m = len(codes) - n
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (codes[n:] * np.uint32(0x9E3779B1))
        cell = (h ^ (h >> np.uint32(15))) % np.uint32(WIDTH)
        inside = row[:m] == row[n:]
        cell = cell.astype(np.int64) + row[:m] * (ORDERS * WIDTH) + n * WIDTH
        out += np.bincount(cell[inside], minlength=len(out))
    return out.reshape(len(texts), -1)


_LETTER = np.zeros(0, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x10000)])
    low = codes < 0x10000
    found = _LETTER[np.where(low, codes, 0)] & low
    if not low.all():
        far = np.unique(codes[~low])
        found |= np.isin(codes, far[[chr(c).isalpha() for c in far]])
    return found


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors (text x feature), zero for texts without a letter. A text over ``PIECE`` characters is counted in pieces."""
    x = np.empty((len(texts), ORDERS * WIDTH), np.float32)
    short = [t if len(t) <= PIECE else "" for t in texts]
    for i in range(0, len(texts), 100):
        x[i : i + 100] = _counts(short[i : i + 100])
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            x[i] = sum(_counts([t[j : j + PIECE]])[0] for j in range(0, len(t), PIECE))
    blank = 32 * 0x9E3779B1 & 0xFFFFFFFF
    x[:, (blank ^ (blank >> 15)) % WIDTH] = 0
    np.sqrt(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("nd,nd->n", x, x)), 1e-12)[:, None]
    return x


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Averaged weights of a linear SVM (last entry: bias) on some rows of x with labels -1 and 1, both labels weighing the same."""
    rng = np.random.default_rng(seed)
    weight = y * np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)).astype(np.float32)
    w, mean, steps, lam = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32), 0, 1e-4
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            steps += 1
            rate = 2.0 / (1 + 0.01 * steps)
            batch = x[rows[part]]
            bad = y[part] * (batch @ w[:-1] + w[-1]) < 1
            w *= 1 - rate * lam
            pull = weight[part][bad] * np.float32(rate / len(part))
            w[:-1] += pull @ batch[bad]
            w[-1] += pull.sum()
            mean += (w - mean) / steps
    return mean


class Discriminator:
    """Family machines, then one-versus-one machines within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array(langs)
        of = {c: family_of(c) for c in self.langs}
        self.families = sorted(set(of.values()))
        self.members = {f: [c for c in self.langs if of[c] == f] for f in self.families}
        fam = np.array([of[c] for c in langs])
        everyone = np.arange(len(y))
        self.family_w = np.stack([_svm(x, everyone, np.where(fam == f, 1.0, -1.0).astype(np.float32), k) for k, f in enumerate(self.families)]) if len(self.families) > 1 else None
        self.pair_w = {}
        for f, own in self.members.items():
            for k, (a, b) in enumerate(combinations(own, 2)):
                both = np.flatnonzero((y == a) | (y == b))
                self.pair_w[a, b] = _svm(x, both, np.where(y[both] == a, 1.0, -1.0).astype(np.float32), 100 + k)

    @staticmethod
    def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score: how sure the family is, times how sure its closest pair is."""
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -10, 10)))
        if self.family_w is None:
            fam, score = np.zeros(len(x), int), np.ones(len(x))
        else:
            m = np.stack([self._margin(x, w) for w in self.family_w], 1)
            fam = m.argmax(1)
            two = np.sort(m, 1)
            score = sure((two[:, -1] - two[:, -2]) / 2)
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            at, own = np.flatnonzero(fam == k), self.members[f]
            if not len(at):
                continue
            votes, sums, least = np.zeros((len(at), len(own))), np.zeros((len(at), len(own))), np.full((len(at), len(own)), np.inf)
            for i, j in combinations(range(len(own)), 2):
                m = self._margin(x[at], self.pair_w[own[i], own[j]])
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                for c, s in ((i, m), (j, -m)):
                    sums[:, c] += s
                    least[:, c] = np.minimum(least[:, c], s)
            best = np.lexsort((-np.arange(len(own))[None].repeat(len(at), 0), sums, votes), axis=1)[:, -1] if len(own) > 1 else np.zeros(len(at), int)
            out[at] = np.array(own, object)[best]
            if len(own) > 1:
                score[at] *= sure(least[np.arange(len(at)), best])
        return out, score


def train(labelled: DataFrame, sample: int = SAMPLE) -> Discriminator | None:
    """A discriminator of a table (doc_id, text, lang), from ``sample`` rows of each language at most."""
    from pyspark.sql import Window

    rows = labelled.where("doc_id is not null and lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", F.lit("language")))
    # twice the sample by a hash limit for each language, so that the window sees few rows of a hot one
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n")
    few = rows.join(F.broadcast(counts), "lang").where(share <= 2 * sample + 20)  # one row for each language
    order = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"), "text")
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{LEARNT // 6}}}"), F.lit(0))
    spread = F.slice(F.array_sort(F.transform(parts, lambda t, i: F.struct(F.xxhash64(t, i).alias("h"), t.alias("t")))), 1, 6)
    learnt = F.when(F.length("text") <= LEARNT, F.col("text")).otherwise(F.array_join(F.transform(spread, lambda x: x["t"]), " "))
    picked = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
    got = picked.select("doc_id", "lang", learnt.alias("text")).toPandas().sort_values(["doc_id", "text"])
    got = got[[any(c.isalpha() for c in t) for t in got.text]]
    return Discriminator(features(got.text.str.lower().tolist()), got.lang.tolist()) if len(got) else None


def identify(text: Column, shared) -> Column:
    """A struct column lang_pred, score; ``shared``: the broadcast discriminator."""

    @F.pandas_udf(RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        model: Discriminator | None = shared.value
        texts = [(t or "").lower() for t in texts]
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        i = 0
        while model is not None and i < len(texts):
            j, size = i, 0
            while j < len(texts) and j - i < 200 and (j == i or size + len(texts[j]) < 1_000_000):
                size += len(texts[j])
                j += 1
            x = features(texts[i:j])
            some = np.flatnonzero(x.any(1))
            if len(some):
                lang[i + some], score[i + some] = model.predict(x[some])
            i = j
        tidy()
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return of(text)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from those that aren't held out."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    apart = held_out(F.col("doc_id"), 3, 1)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~apart)))
    out = docs.select("doc_id", apart.alias("held_out"), identify(F.col("text"), shared).alias("r"))
    return out.select("doc_id", "held_out", "r.lang_pred", "r.score")
