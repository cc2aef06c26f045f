"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word enters the network by its characters (the mean of the embeddings of its hashed character
n-grams and beginnings) and as a word (an embedding of the learnt vocabulary, one entry for the rest).
Windows of ``WINDOW`` words, each overlapping half of the next, cover the whole text; every window is
scored. A small logistic model reads a document's score off its highest window, mean window and number
of windows.

Only documents are labelled, so training alternates between choosing windows (of toxic documents the
likeliest toxic ones, of others the likeliest and some others) and fitting the network to them. The
first choice follows log-odds of the inputs. It learns from at most ``SAMPLE`` rows of each label, drawn
by hash, and from the whole of their texts; scoring works through a long text in slabs of ``SLAB`` words.

Defined results: null and empty texts have no window and get the score of the lowest window. Without
training rows of both labels every score is 0. Of several labels of an id the largest counts; labels of
null ids don't. Equal texts get equal scores up to rounding. Other columns pass ``drop_toxic`` as they are.
"""

from __future__ import annotations

from collections import Counter
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ._common import drop_stage, fresh, small_batches, stage_table, tidy
from .language import held_out

WINDOW, STRIDE = 32, 16
HIDDEN, CHAR_DIM, WORD_DIM = 8, 12, 6
CHAR_CELLS, VOCABULARY = 1 << 14, 2048
SAMPLE = 1_000
ROUNDS, EPOCHS = 3, 2
SLAB = 100_000
EDGE = " \t\n.,;:!?\"'()[]{}<>*#&$%|-_/\\«»„“”…"
LOWEST = -8.0


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word, and cell, of each character n-gram (3 and 5) and beginning (4 to 7) of the words."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    row = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    rows, cells, h = [], [], np.full(len(codes), 7, np.uint32)
    for n in range(1, 9):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(13)
        if n in (3, 5):
            at = np.flatnonzero(row[:m] == row[n - 1 :])
            rows.append(row[at])
            cells.append((h[at] + np.uint32(n)) % np.uint32(CHAR_CELLS))
        if n >= 5:
            at = starts[lengths > n]
            rows.append(row[at])
            cells.append((h[at] ^ np.uint32(0x5BD1E995)) % np.uint32(CHAR_CELLS))
    rows, cells = np.concatenate(rows), np.concatenate(cells).astype(np.int64)
    order = np.argsort(rows, kind="stable")
    return rows[order], cells[order]


def normal(word: str) -> str:
    return word.strip(EDGE).lower()


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    return np.arange(0, max(n - STRIDE, 1), STRIDE) if n else np.zeros(0, int)


class Words:
    """Distinct words of some texts with their inputs."""

    def __init__(self, tokens: list[str], vocabulary: dict[str, int]):
        self.ids, distinct = pd.factorize(np.array(tokens, object))
        norm = [normal(w) for w in distinct]
        back, self.distinct = pd.factorize(np.array(norm, object)) if len(norm) else (np.zeros(0, int), [])
        self.ids = back[self.ids] if len(norm) else self.ids
        self.word = np.array([vocabulary.get(w, 0) for w in self.distinct], int)
        self.row, self.cell = _grams(list(self.distinct)) if len(self.distinct) else (np.zeros(0, int), np.zeros(0, int))
        self.count = np.bincount(self.row, minlength=len(self.distinct)).astype(np.float32)
        self.start = np.cumsum(self.count).astype(int) - self.count.astype(int)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole numbers from each start on, as many as its count."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Bidirectional GRU with attention pooling; forward and backward passes in numpy."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 5):
        rng, h, d = np.random.default_rng(seed), HIDDEN, CHAR_DIM + WORD_DIM
        self.vocabulary = vocabulary
        draw = lambda *shape, by=0.1: (rng.normal(size=shape) * by).astype(np.float32)
        self.p = {"chars": draw(CHAR_CELLS, CHAR_DIM, by=0.5), "words": draw(len(vocabulary) + 1, WORD_DIM, by=0.3), "look": draw(2 * h), "out": draw(2 * h, by=0.5), "bias": np.full(1, -1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": draw(d, 3 * h, by=0.4), f"u{side}": draw(h, 3 * h, by=0.3), f"b{side}": np.zeros(3 * h, np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.step = 0
        self.head = np.array([1.0, 0.0, 0.0, 0.0])

    def inputs(self, w: Words) -> np.ndarray:
        chars = np.zeros((len(w.count), CHAR_DIM), np.float32)
        some = np.flatnonzero(w.count)
        if len(some):
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                lo, hi = w.start[part[0]], w.start[part[-1]] + int(w.count[part[-1]])
                chars[part] = np.add.reduceat(self.p["chars"][w.cell[lo:hi]], w.start[part] - lo) / np.sqrt(w.count[part])[:, None]
        return np.hstack([chars, self.p["words"][w.word]])

    def run(self, ids: np.ndarray, mask: np.ndarray, projected: dict, keep: bool = False):
        """Logits of windows (ids of words, mask of those that are there)."""
        n, steps, h = len(ids), ids.shape[1], HIDDEN
        states = np.empty((n, steps, 2 * h), np.float32)
        saved = {"f": [], "b": []}
        for side, at in (("f", 0), ("b", h)):
            u, x = self.p[f"u{side}"], projected[side]
            now = np.zeros((n, h), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                g, r = x[ids[:, t]], now @ u
                gate = g[:, : 2 * h] + r[:, : 2 * h]
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                z, reset = gate[:, :h], gate[:, h:]
                new = np.tanh(g[:, 2 * h :] + reset * r[:, 2 * h :])
                before = now
                now = (new + z * (now - new)) * mask[:, t, None]
                states[:, t, at : at + h] = now
                if keep:
                    saved[side].append((t, z, reset, new, before, r[:, 2 * h :]))
        look = states @ self.p["look"]
        look = np.where(mask > 0, look, -1e9)
        weight = np.exp(look - look.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, states, weight, pooled, saved) if keep else logits

    def project(self, x: np.ndarray) -> dict:
        return {s: x @ self.p[f"w{s}"] + self.p[f"b{s}"] for s in "fb"}

    def learn(self, w: Words, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step of Adam on the mean log loss of some windows."""
        used, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(mask.shape)
        own = _ranges(w.start[used], w.count[used].astype(int))
        part = Words.__new__(Words)
        part.cell, part.count, part.word = w.cell[own], w.count[used], w.word[used]
        part.start = np.cumsum(part.count).astype(int) - part.count.astype(int)
        x = self.inputs(part)
        projected = self.project(x)
        logits, states, weight, pooled, saved = self.run(ids, mask, projected, True)
        prob = _sigmoid(logits)
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": d @ pooled, "bias": np.array([d.sum()])}
        dpool = d[:, None] * self.p["out"]
        dweight = np.einsum("nh,nth->nt", dpool, states)
        dlook = weight * (dweight - (weight * dweight).sum(1, keepdims=True))
        g["look"] = np.einsum("nt,nth->h", dlook, states)
        dstates = weight[:, :, None] * dpool[:, None] + dlook[:, :, None] * self.p["look"]
        dx, h = np.zeros_like(x), HIDDEN
        for side, at in (("f", 0), ("b", h)):
            u, du = self.p[f"u{side}"], np.zeros_like(self.p[f"u{side}"])
            dproj = np.zeros_like(projected[side])
            carry = np.zeros((len(y), h), np.float32)
            for t, z, reset, new, before, rec in reversed(saved[side]):
                dh = (dstates[:, t, at : at + h] + carry) * mask[:, t, None]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * rec * reset * (1 - reset)
                by_state = np.hstack([dz, dr, dn * reset])
                du += before.T @ by_state
                carry = dh * z + by_state @ u.T
                np.add.at(dproj, ids[:, t], np.hstack([dz, dr, dn]))
            g[f"u{side}"], g[f"w{side}"], g[f"b{side}"] = du, x.T @ dproj, dproj.sum(0)
            dx += dproj @ self.p[f"w{side}"].T
        g["chars"] = np.zeros_like(self.p["chars"])
        each = np.repeat(np.arange(len(used)), part.count.astype(int))
        np.add.at(g["chars"], part.cell, (dx[:, :CHAR_DIM] / np.sqrt(np.maximum(part.count, 1))[:, None])[each])
        g["words"] = np.zeros_like(self.p["words"])
        np.add.at(g["words"], part.word, dx[:, CHAR_DIM:])
        self.step += 1
        for k, v in g.items():
            m, s = self.moments[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.p[k] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-6) + (1e-4 * rate) * self.p[k]
        return float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)))

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every window."""
        texts_of, logits = [], []
        for own, tokens, cuts in _slabs(texts):
            w = Words(tokens, self.vocabulary)
            ids, mask, text = _layout(w.ids, cuts)
            projected = self.project(self.inputs(w))
            for i in range(0, len(ids), 2048):
                logits.append(self.run(ids[i : i + 2048], mask[i : i + 2048], projected))
            texts_of.append(np.array(own, int)[text])
        return (np.concatenate(texts_of), np.concatenate(logits)) if texts_of else (np.zeros(0, int), np.zeros(0))

    def summaries(self, texts: list[str]) -> np.ndarray:
        """Highest logit, mean probability and log number of the windows of each text."""
        text, logit = self.windows(texts)
        most, n = np.full(len(texts), LOWEST), np.bincount(text, minlength=len(texts))
        np.maximum.at(most, text, np.clip(logit, LOWEST, -LOWEST))
        mean = np.bincount(text, _sigmoid(logit), len(texts)) / np.maximum(n, 1)
        return np.stack([most, mean, np.log1p(n)], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.summaries(texts) @ self.head[:3] + self.head[3])


def _slabs(texts: list[str]):
    """Slabs of words: (text of each part, tokens, ends of the parts). A long text is split so that its windows stay the same."""
    own, tokens, cuts = [], [], []
    for i, t in enumerate(texts):
        words = t.split()
        at, n = 0, len(words)
        while at < n:
            # parts overlap by WINDOW - STRIDE words, and all but the last hold whole windows only
            end = n if n - at <= SLAB else at + SLAB // STRIDE * STRIDE
            own.append(i)
            tokens += words[at:end]
            cuts.append(len(tokens))
            if len(tokens) >= SLAB:
                yield own, tokens, np.array(cuts)
                own, tokens, cuts = [], [], []
            at = n if end == n else end - (WINDOW - STRIDE)
    if tokens:
        yield own, tokens, np.array(cuts)


def _layout(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids and mask of every window, and its part."""
    begins = np.concatenate([[0], cuts[:-1]])
    starts = [windows_of(e - b) + b for b, e in zip(begins, cuts, strict=True)]
    part = np.repeat(np.arange(len(cuts)), [len(s) for s in starts])
    place = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    mask = (place < cuts[part][:, None]).astype(np.float32)
    return ids.astype(np.int32)[np.minimum(place, len(ids) - 1)], mask, part


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, the bias last; the mean of both labels' weights is the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.array([0.05] * (x.shape[1] - 1) + [1e-4])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step * min(1, 2 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Network | None:
    """A network of labelled texts; None unless both labels occur among texts with words."""
    rows = [(t, y) for t, y in zip(texts, labels, strict=True) if t.split()]
    y_doc = np.array([y for _, y in rows], np.float32)
    if not len(rows) or y_doc.min() == y_doc.max():
        return None
    rng = np.random.default_rng(seed)
    tokens, cuts, seen = [], [], [Counter(), Counter()]
    for t, y in rows:
        own = [intern(w) for w in t.split()]  # one object for each distinct word of the sample
        tokens += own
        cuts.append(len(tokens))
        seen[int(y)].update({normal(w) for w in own})
    both = seen[0] + seen[1]
    common = sorted((w for w, n in both.items() if n >= 3 and w), key=lambda w: (-both[w], w))[:VOCABULARY]
    vocabulary = {w: k + 1 for k, w in enumerate(common)}
    net, w = Network(vocabulary, seed), Words(tokens, vocabulary)
    ids, mask, doc = _layout(w.ids, np.array(cuts))
    # log-odds of a document being toxic for having a cell, smoothed; a word's highest cell counts
    token_doc = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], cuts])))
    pairs = np.unique(token_doc * len(w.count) + w.ids)
    cells = [np.zeros(CHAR_CELLS), np.zeros(CHAR_CELLS)]
    for d in range(len(rows)):
        lo, hi = np.searchsorted(pairs, [d * len(w.count), (d + 1) * len(w.count)])
        own = pairs[lo:hi] - d * len(w.count)
        cells[int(y_doc[d])][np.unique(w.cell[_ranges(w.start[own], w.count[own].astype(int))])] += 1
    n1 = max(y_doc.sum(), 1)
    odds = np.log((cells[1] + 0.5) / (n1 + 1)) - np.log((cells[0] + 0.5) / (len(rows) - n1 + 1))
    del pairs, token_doc, tokens
    word_odds = np.full(len(w.count), -9.0)
    some = np.flatnonzero(w.count)
    word_odds[some] = np.maximum.reduceat(odds[w.cell], w.start[some])
    score = np.where(mask > 0, word_odds[ids], -9).max(1)
    for turn in range(ROUNDS):
        order = np.lexsort((-score, doc))
        first = np.concatenate([[True], doc[order][1:] != doc[order][:-1]])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        toxic = y_doc[doc[order]] > 0
        chosen = order[(toxic & (rank < 1 + turn)) | (~toxic & ((rank < 1) | (rng.random(len(order)) < 0.15)))]
        y = y_doc[doc[chosen]]
        reps = int(np.clip((1 - y.mean()) / max(y.mean(), 1e-9) / 2, 1, 4))
        chosen = np.concatenate([chosen, *[chosen[y > 0]] * (reps - 1)])
        epochs = int(np.clip(40_000 // max(len(chosen), 1), EPOCHS, 80)) if turn == 0 else EPOCHS
        for e in range(epochs):
            for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 64)):
                net.learn(w, ids[part], mask[part], y_doc[doc[part]], 0.01 if turn == 0 else 0.004)
        projected = net.project(net.inputs(w))
        score = np.concatenate([net.run(ids[i : i + 2048], mask[i : i + 2048], projected) for i in range(0, len(ids), 2048)])
    net.head = _logistic(net.summaries([t for t, _ in rows]), y_doc)
    net.moments = {}
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network of the labelled rows of ``labels`` (doc_id, toxic)."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    written = docs.where("text is not null").select("doc_id", "text")
    marks = stage_table(marks.join(written.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    order = [F.xxhash64("doc_id", F.lit("toxicity")), "doc_id"]
    ids = marks.where("toxic = 0").orderBy(*order).limit(sample).unionByName(marks.where("toxic = 1").orderBy(*order).limit(sample))
    rows = written.join(F.broadcast(ids), "doc_id")
    # an id may have many rows: one text of each bounds the sample
    got = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "text"])
    drop_stage(marks)
    texts, toxic = got.text.tolist(), got.toxic.tolist()
    del got
    tidy()
    net = fit(texts, toxic)
    tidy()
    return net


def toxicity(text: Column, shared) -> Column:
    """The score of a text column; ``shared``: the broadcast network."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        net: Network | None = shared.value
        texts = [t or "" for t in texts]
        out, i = np.zeros(len(texts)), 0
        while net is not None and i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < 600_000):
                size += len(texts[j])
                j += 1
            out[i:j] = net.scores(texts[i:j])
            i = j
        tidy()
        return pd.Series(out)

    return of(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels that aren't held out."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")))
    out = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), toxicity(F.col("text"), shared).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.5 or more, all columns as they are; learns from labels that aren't held out."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")))
    score = fresh(docs, "score")
    return docs.withColumn(score, toxicity(F.col("text"), shared)).where(F.col(score) < 0.5).drop(score)
