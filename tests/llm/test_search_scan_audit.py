"""Ranked search, license scan and filter audit against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from varloom.llm import audit, lexical, licenses

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_ranking(docs, items, top=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b, n in bags:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(found[:top])]
    return out


def corpus(n=300, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Éa", "日本", "the", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + i, t) for i, t in enumerate([None, "", " \n--", "w1", "W1", "w1"])]
    docs += [docs[7], docs[7], (None, "w3 w5 w9"), (n + 50, "w2 " * 300_000 + "tail")]
    return docs


ITEMS = [(1, "w3 w5 w5 w100, the TAIL"), (2, ""), (3, None), (4, "nowhere"), (5, "w1"), (None, "w2-w7"), (5, "w1"), (6, " ".join(f"w{i}" for i in range(200)))]


@pytest.mark.parametrize("shard", [1, 300, 1 << 20])
def test_search_equals_brute_force(spark, monkeypatch, shard):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rank string, item int").repartition(5)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, score int")
    if shard == 300:  # in several blocks of items, with shards of one batch
        monkeypatch.setattr(lexical, "VOCABULARY", 2000)
    monkeypatch.setattr(lexical, "SHARD", shard)
    got = [tuple(r) for r in lexical.search(df, items).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute_ranking(docs, ITEMS), key=key)


def test_search_skips_postings_that_cannot_matter():
    r = np.random.default_rng(1)
    n, common, rare = 20_000, 3, 40
    place = np.concatenate([np.arange(n)] * common + [np.sort(r.choice(n, 20, False)) for _ in range(rare)])
    term = np.concatenate([np.repeat(np.arange(common), n), np.repeat(np.arange(common, common + rare), 20)])
    impact = r.integers(1000, 500_000, len(place))
    weights = np.where(np.arange(common + rare) < common, 3, 9000)
    shard = lexical.Shard(np.arange(n) * 7, place, term, impact, common + rare)
    q = lexical.Query(1, np.arange(common + rare), weights)
    shard.search(q, 20)
    dense = np.zeros(n, np.int64)
    np.add.at(dense, place, weights[term] * impact)
    by = np.lexsort((np.arange(n), -dense))[:20]
    assert q.docs.tolist() == (by * 7).tolist() and q.scores.tolist() == dense[by].tolist()
    assert shard.search(q, 20) < len(place) / 10  # with a threshold, common terms are only probed


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some_docs, some_items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [lexical.search(d, i).count() for d, i in ((docs, items), (docs, some_items), (some_docs, items), (spark.createDataFrame([(1, None)], "doc_id long, text string"), some_items))] == [0, 0, 0, 0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_labels(text, notices):
    """Labels of every run of whole words within the notice's edits that holds what the notice needs."""
    words, out = text.split(" ") if text else [], set()
    for n in notices:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                own = " ".join(words[i:j])
                if len(own) > len(n.text) + n.edits:
                    break
                if len(own) >= len(n.text) - n.edits and set(n.needs) <= set(words[i:j]) and distance(own, n.text) <= n.edits:
                    out.add(n.label)
    return out


def damaged(text, edits, r):
    for _ in range(edits):
        k = r.randrange(len(text) + 1)
        kind = r.randrange(3)
        text = text[:k] + (r.choice("xyz ") if kind < 2 else "") + text[k + (kind > 0) :]
    return text


def test_license_labels_equal_brute_force():
    r = random.Random(5)
    scan = licenses.scanner(licenses.NOTICES)
    hits = 0
    for _ in range(250):
        n = r.choice(licenses.NOTICES)
        text = f"{r.choice(['', 'some words ', 'license '])}{damaged(n.text, r.randrange(n.edits + 3), r)}{r.choice(['', ' and more', ' s'])}"
        text = " ".join(licenses.words_of(text.encode())[0].split())
        found = scan.find(text)
        for k, i, j, edits in found:
            assert distance(text[i:j], licenses.NOTICES[k].text) == edits <= licenses.NOTICES[k].edits
        got = {licenses.NOTICES[k].label for k, *_ in found}
        assert got == brute_labels(text, licenses.NOTICES), text
        hits += bool(got)
    assert hits > 100


@pytest.mark.parametrize("notice", licenses.NOTICES, ids=lambda n: n.text[:30])
def test_pieces_cover_a_notice(notice):
    cut = licenses.pieces(notice)
    assert "".join(p for _, p in cut) == notice.text and len(cut) == notice.edits + 1 and all(notice.text[o : o + len(p)] == p for o, p in cut)
    assert min(len(p) for _, p in cut) >= 5


def brute_base(text):
    words = terms(text)
    places, labels = [], set()
    for n in licenses.NOTICES:
        own = n.text.split(" ")
        for i in range(len(words) if n.base else 0):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(n.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_report(spark):
    texts = [
        None, "", "--- \n", "Released under the MIT License.", "under the MIT licence", "under the MPL license", "Apache License, Version 2.0; Apache License, Version 2",
        "Apache License, Version 1", "CC BY-NC 4.0 and CC BY-ND", "cc by ncx", "xunder the mit license", "É under the mit license É 日本 under the mit license",
        "word " * 400_000 + "under the MIT license" + " cc" * 1000, "under the mit licnse " * 50, "cc by nc cc by nc", "Licensed under the GNU General Public License, version 3",
        "license " * 3000, "\x00under\x01the mit license",
    ]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[3], 0)]
    got = licenses.report(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()
    assert len(got) == len(rows)
    for r, (doc_id, text, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (doc_id, *brute_base(text)), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1) == (r.n_base > 0 or "gpl" in r.labels or "nd" in r.labels)
    by = {r.doc_id: r for r in got}
    assert by[4].labels == "mit" and by[4].n_base == 0 and 0.9 < by[4].score < 1
    assert by[5].labels == by[7].labels == by[9].labels == by[16].labels == "" and by[5].score == 0
    assert by[8].labels == "cc-by-nc,cc-by-nd" and by[15].labels == "gpl,gpl-3" and by[13].n_matches == 50
    spans = licenses.spans(spark.createDataFrame([(1, "É: under\nthe MIT License!")], "doc_id long, text string")).collect()
    assert [(s.label, s.word_from, s.word_to, s.begin, s.end, s.edits) for s in spans] == [("mit", 1, 4, 4, 25, 0)]
    assert licenses.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_audit(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = Counter()
    marks = {}
    for d, q, x in labels:
        a, b = marks.get(d, (False, False))
        marks[d] = (a or q == 1, b or x == 1)
    for order in map("".join, itertools.permutations("ABCDE")):
        for d, t, lang in docs:
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            fail = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
            good, toxic = marks.get(d, (False, False)) if d is not None else (False, False)
            gone = False
            for step, f in enumerate(order, 1):
                row = (lang or "", order, step)
                here = fail[f] and not gone
                for name, yes in (("kept", not gone and not here), ("removed", here), ("redundant", fail[f] and gone), ("unique_fails", fail[f] and sum(fail.values()) == 1), ("good_lost", here and good), ("toxic_lost", here and toxic)):
                    out[row, name] += yes
                out[lang or "", f] += here
                gone = gone or fail[f]
    rows = {r for r, *_ in out if isinstance(r, tuple)}
    return {(*r, *(out[r, n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), out[r[0], r[1][r[2] - 1]]) for r in rows}


DOCS = [(1, "a b c", "en"), (2, "a b c", "en"), (3, "a b c", "de"), (4, None, None), (5, "", ""), (6, " ".join(f"w{i}" for i in range(150)), "en"), (7, "AB " * 120, "en"), (7, "AB " * 120, "en"), (8, "100% " + " ".join(map(str, range(99))), "en"), (None, "a b c", "en"), (None, "new", "fr"), (9, "x\x0by\x85z", "fr"), (6, "two texts of one id", "en"), (10, "word " * 50_000, "en")]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 0), (7, None, 1), (99, 1, 1), (None, 1, 1)]


def test_audit_equals_brute_force_and_sql(spark):
    df = spark.createDataFrame([(d, t, x, "n", 0) for d, t, x in DOCS], "doc_id long, text string, lang string, part string, n int")
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:10] for r in audit.report(df, labels).collect()}
    assert got == brute_audit(DOCS, MARKS) and len(got) == 4 * 600
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype("Int64"))
    assert {tuple(r)[:10] for r in con.sql(audit.SQL).fetchall()} == got


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.report(docs, labels).count() == 0
    assert audit.report(spark.createDataFrame([(1, None, None)], docs.schema), labels).count() == 600
