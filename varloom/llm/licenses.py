"""License notices in texts, also with misspellings: exact seeds find candidates, bounded-error matching verifies them.

A text is read as its words (small ASCII letters, digits, everything beyond ASCII) with one blank between them. A notice of
n characters may be matched with k edits (insertions, deletions, substitutions). It is cut into k + 1 pieces: a match
with at most k edits holds one of them unchanged, so searching all pieces of all notices at once (Aho-Corasick) meets
every match. Each hit gives a window of n + 2k characters. An exact notice there needs no more; in any other window
the regex library looks for the match of fewest edits that begins and ends with whole words. What names the license
(``needs``: "mit", "2", ...) must be there as it is, or one edit would make another license.

The base phrases are notices like all others; ``scan`` tells which matches are exact, and their places are the base
places of ``report``. Whole texts are searched; there is no cap on hits. Texts are searched alone where they lie:
nothing is shuffled.

Defined results: null, empty and wordless texts have no words and no matches. Of matches of one notice that overlap, the
one of fewest edits stays, then the first; exact ones all stay. Repeated rows give repeated rows, empty tables none. Only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._common import small_batches, text_bytes, tidily
from .lexical import PIECE, _TABLE


@dataclass(frozen=True)
class Notice:
    """``text`` in small letters, with one blank between words; ``edits`` that a match may have; words that it must hold."""

    label: str
    text: str
    edits: int = 0
    needs: tuple[str, ...] = ()
    base: bool = False


#: The base phrases and labels, then usual sentences of licenses. Names and versions must be exact.
NOTICES = (
    Notice("mit", "under the mit license", 2, ("mit",), True),
    Notice("apache-2", "apache license version 2", 2, ("apache", "2"), True),
    Notice("cc-by-nc", "cc by nc", 0, (), True),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-nd", "cc by nd"),
    Notice("gpl", "gnu general public license", 2, ("gnu", "general")),
    Notice("gpl-2", "gnu general public license version 2", 3, ("gnu", "general", "2")),
    Notice("gpl-3", "gnu general public license version 3", 3, ("gnu", "general", "3")),
    Notice("lgpl", "gnu lesser general public license", 2, ("gnu", "lesser")),
    Notice("agpl", "gnu affero general public license", 2, ("gnu", "affero")),
    Notice("mpl-2", "mozilla public license v 2 0", 2, ("mozilla", "2")),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 7),
    Notice("apache-2", "you may not use this file except in compliance with the license", 5),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 9),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("cc0", "cc0 1 0 universal", 1, ("cc0",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3, ("noncommercial",)),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3, ("sharealike",)),
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """Offsets and texts of the k + 1 pieces, as even as they can be."""
    cuts = [len(notice.text) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def words_of(raw: bytes) -> tuple[str, int]:
    """A text's words with one blank between them, and their number."""
    parts, n, at = [], 0, 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and _TABLE[raw[end]] != 32:  # a word is not cut
            end += 1
        if own := raw[at:end].translate(_TABLE).split():
            parts.append(b" ".join(own))
            n += len(own)
        at = end
    return b" ".join(parts).decode("utf-8", "surrogateescape"), n


class Scanner:
    """Searches all notices at once."""

    #: Verified windows that are remembered, as copies of a text ask for them again.
    KEPT = 50_000

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for offset, piece in pieces(n):
                seeds.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in seeds.items():
            self.automaton.add_word(piece, (len(piece), own))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?<![^ ])(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}(?![^ ])", regex.BESTMATCH) if n.edits else None for n in notices]
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def _verified(self, k: int, window: str) -> tuple[int, int, int] | None:
        """Begin, end and edits of the best match in a window that begins and ends between words, or with its neighbour's character."""
        if (k, window) not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            m = self.patterns[k].search(window)
            self.known[k, window] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m and set(self.notices[k].needs) <= set(m.group().split(" ")) else None
        return self.known[k, window]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, begin, end, edits) of all matches in words with one blank between them; begin and end count characters."""
        exact, loose = set(), set()
        for last, (size, own) in self.automaton.iter(text):
            for k, offset in own:
                (exact if text.startswith(self.notices[k].text, max(at := last - size + 1 - offset, 0)) and at >= 0 and self._whole(text, at, at + len(self.notices[k].text)) else loose).add((k, at))
        found = [(k, at, at + len(self.notices[k].text), 0) for k, at in exact]
        best: dict[int, list[tuple[int, int, int]]] = {}
        for k, at in loose:
            n = self.notices[k]
            if not n.edits or (k, at) in exact:
                continue
            # a character more on both sides shows whether a match there begins or ends a word
            lo, hi = max(at - n.edits - 1, 0), min(at + len(n.text) + n.edits + 1, len(text))
            window = text[lo:hi]
            if all(w in window for w in n.needs) and (m := self._verified(k, window)):
                i, j = lo + m[0], lo + m[1]
                if self._whole(text, i, j):
                    best.setdefault(k, []).append((m[2], i, j))
        for k, matches in best.items():
            taken = [(i, j) for kk, i, j, _ in found if kk == k]
            for edits, i, j in sorted(set(matches)):
                if all(j <= a or i >= b for a, b in taken):
                    taken.append((i, j))
                    found.append((k, i, j, edits))
        return sorted(found, key=lambda m: (m[1], m[0]))

    @staticmethod
    def _whole(text: str, i: int, j: int) -> bool:
        return (i == 0 or text[i - 1] == " ") and (j == len(text) or text[j] == " ")


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


MATCH = "label string, notice int, base boolean, edits int, similarity double, word_from long, word_to long, begin long, end long"


def _matches(raw: bytes, text: str, found, notices) -> list[tuple]:
    """Rows of ``MATCH``: words are counted from 0, begin and end are bytes of the original text."""
    edge = np.flatnonzero(np.diff(np.frombuffer(b" " + raw.translate(_TABLE) + b" ", np.uint8) != 32))
    out, word, at = [], 0, 0
    for k, i, j, edits in found:
        word, at = word + text.count(" ", at, i), i
        last = word + text.count(" ", i, j)
        n = notices[k]
        out.append((n.label, k, n.base and edits == 0, edits, 1 - edits / len(n.text), word, last, int(edge[2 * word]), int(edge[2 * last + 1])))
    return out


def _scanned(batches, notices: tuple[Notice, ...]):
    search = scanner(notices)
    names = [f.split(" ")[0] for f in MATCH.split(", ")]
    kind = pa.list_(pa.struct([pa.field(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64()}[f.split(" ")[1]]) for n, f in zip(names, MATCH.split(", "), strict=True)]))
    for b in tidily(batches):
        data, off = text_bytes(b.column(1))
        raw = data.tobytes()
        count, rows = [], []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            own = raw[i:j]
            text, n = words_of(own)
            found = search.find(text)
            count.append(n)
            rows.append([dict(zip(names, m, strict=True)) for m in _matches(own, text, found, notices)] if found else [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_words", "matches"])


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, matches (array of ``MATCH``) of every row."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = ",".join(f.replace(" ", ":") for f in MATCH.split(", "))
    return own.mapInArrow(lambda b: _scanned(b, notices), f"doc_id long, n_words long, matches array<struct<{fields}>>")


def spans(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id and the columns of ``MATCH``: one row for each match."""
    return scan(docs, notices).select("doc_id", F.inline("matches"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches of every row."""
    found = scan(docs)
    places = F.transform(F.filter("matches", lambda m: m["base"]), lambda m: m["word_from"])
    names = lambda own: F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names(F.filter("matches", lambda m: m["base"])).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )
