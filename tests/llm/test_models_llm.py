"""Trained operators: accuracy on held-out rows of small made-up corpora, and their edge cases."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.llm import ann, language, mixing, toxicity, urls

VOICES = {"en": "the of and that with this from which ing tion", "de": "der die und nicht ein schen keit ver lich", "fr": "le la des une que aux eau tion dans", "es": "el los que una para ción ado esto ñas"}


def corpus(seed=0, n=240):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(VOICES)[i % 4]
        parts = VOICES[lang].split()
        words = ["".join(r.choice(parts) for _ in range(r.choice([1, 2]))) for _ in range(r.randrange(20, 90))]
        toxic = i % 5 == 1 or i % 7 == 3
        for _ in range(3 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["grumpf", "Blarg!", "snork"])
        rows.append((i, " ".join(words), lang, "s", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (1002, "12 34 !!", None, "s", 0), (1003, "der keit " * 40_000, None, "s", 0), (1004, "x", "en", "s", 0)]
    return spark.createDataFrame(corpus() + extra, "doc_id long, text string, lang string, source string, toxic int").cache()


def test_language(spark, docs):
    got = {r.doc_id: r for r in language.report(docs.withColumn("score", F.lit("clash"))).collect()}
    assert len(got) == 245
    apart = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in apart) and np.mean([got[r[0]].lang_pred == r[2] for r in apart]) >= 0.95
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"] and got[1004].lang_pred in VOICES
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_rows_to_learn_from(spark, docs):
    assert {r.lang_pred for r in language.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.report(docs.where("false")).count() == 0


def test_language_ignores_lang_of_held_out_rows(spark, docs):
    odd = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, language.report(odd).collect())) == sorted(map(tuple, language.report(docs).collect()))


def test_toxicity(spark, docs):
    labels = docs.where("doc_id < 1000").select("doc_id", "toxic", F.lit(1).alias("quality"))
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    true = {r[0]: r[4] for r in corpus()}
    apart = [d for d in true if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(got) == 245 and all(got[d].held_out for d in apart)
    assert np.mean([got[d].predicted == true[d] for d in apart]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and got[1000].score == got[1001].score
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark, docs):
    none = docs.where("false").select("doc_id", "toxic")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.0}


def test_every_word_of_a_long_text_is_in_a_window():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 31, 32, 33, 47, 500)]
    seen, toxicity_slab = [], toxicity.SLAB
    for slab in (toxicity_slab, 64):
        toxicity.SLAB = slab
        words = [set() for _ in texts]
        spans = [set() for _ in texts]
        for own, tokens, cuts in toxicity._slabs(texts):
            ids, mask, part = toxicity._layout(np.arange(len(tokens)), cuts)
            for w, m, p in zip(ids, mask, part, strict=True):
                t = tuple(tokens[k] for k, x in zip(w, m, strict=True) if x)
                words[own[p]].update(t)
                spans[own[p]].add(t)
        assert [len(w) for w in words] == [1, 31, 32, 33, 47, 500]
        seen.append(spans)
    toxicity.SLAB = toxicity_slab
    assert seen[0] == seen[1]


def test_gradients():
    vocabulary = {"a": 1, "bb": 2}
    w = toxicity.Words("a bb ccc dddd".split(), vocabulary)
    ids, mask, y = np.array([[0, 1, 2, 3], [2, 2, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32), np.array([1.0, 0.0])
    net = toxicity.Network(vocabulary)

    def loss():
        logits = net.run(ids, mask, net.project(net.inputs(w)))
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * logits))))

    before = {k: v.copy() for k, v in net.p.items()}
    at = loss()
    net.learn(w, ids, mask, y, 0.0)
    slopes = {k: m / 0.1 for k, (m, _) in net.moments.items()}
    for k, v in before.items():
        i = np.unravel_index(np.argmax(np.abs(slopes[k])), v.shape)
        net.p[k][i] += 1e-2
        up = loss()
        net.p[k][i] -= 2e-2
        down = loss()
        net.p[k][i] = v[i]
        assert (up - down) / 2e-2 == pytest.approx(slopes[k][i], rel=0.05, abs=1e-4), k
    assert loss() == pytest.approx(at)


def test_url_rules(spark):
    rows = ["http://a.com/x", "https://www.example.com/en/1", "http://example.com/en/1", "http://EXAMPLE.com/de/?q=/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "http://example.com", "http://notcom/", None, "no scheme", "http://x.org/a?b://c", "s://h#f"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[:6] == [("a.com", "/x", "com/", "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("example.com", "/de/", "com/", "allow"), ("x.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block")]
    assert [g[:3] for g in got[6:]] == [("x.net", "/fr", None), ("example.com", "", None), ("notcom", "/", None), ("", "", None), ("", "", None), ("x.org", "/a", None), ("h", "", None)]
    assert {g[3] for g in got} == {"allow", "block"}


def test_url_models_tell_kinds_apart(spark):
    r = random.Random(1)
    good = [f"http://{r.choice('abc')}{i}.org/news/{r.randrange(999)}" for i in range(150)]
    bad = [f"http://{r.choice('abc')}{i}.org/cheap-pills/{r.randrange(999)}" for i in range(150)]
    df = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad], "url string, label int")
    m = urls.fit(df)
    assert min(m.ratio(["http://zz.org/news/5"])) > 0 > max(m.ratio(["http://zz.org/cheap-pills/5"])) and m.ratio([""]).shape == (1,)
    assert urls.fit(df.where("label = 1")) is None and urls.calibrate(df.where("false").withColumn("ratio", F.lit(0.0))) == 0.0
    assert urls.calibrate(spark.createDataFrame([(1, 1.0), (0, -1.0)], "label int, ratio double")) == pytest.approx(0, abs=1.0)


def brute(vectors, k):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, x in ok:
        if q % 50 == 0:
            near = sorted((-(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = near[:k]
    return out


def test_ann(spark):
    rng = np.random.default_rng(0)
    v = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(400)]
    same = v[3][1]
    v += [(i, same) for i in range(400, 700)]
    v += [(800, None), (850, [0.0] * 16), (900, [float("nan")] + same[1:]), (950, [None] + same[1:]), (1000, [2.0, 1.0]), (1001, [1.0, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.nearest(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    want = brute(v, 5)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        assert [g[2] for g in got[q]] == list(range(1, len(got[q]) + 1)) and len(got[q]) == len(near)
        hits += len({i for _, i in near} & {g[1] for g in got[q]}) / len(near)
        if q >= 400 and q < 700:
            assert [g[1] for g in got[q]] == [i for i in [3, *range(400, 410)] if i != q][:5]
    assert hits / len(want) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 4, 6, 12])
def test_ann_of_small_tables_is_complete(spark, n):
    """Three vectors close together and others opposite: every query gets all others, or the five nearest."""
    rng = np.random.default_rng(n)
    x = np.array([1.0] * 16) * np.where(np.arange(n) < 3, 1, -1)[:, None] + rng.normal(0, 1e-3, (n, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, "vec_id % 1 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(n):
        near = y @ y[q]
        want = [i for i in np.lexsort((np.arange(n), -near)).tolist() if i != q][:5]
        assert got.get(q, []) == want


def test_ann_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").count() == 0


def labelled(docs):
    return docs.where("doc_id < 1000").select("doc_id", F.when(F.col("toxic") == 1, "odd").otherwise(F.col("lang")).alias("domain"))


def test_mixing_reaches_its_targets(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d")).where("doc_id <> 1003")
    target = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    lab = docs.where("doc_id < 1000").select("doc_id", F.col("lang").alias("domain"))
    out = mixing.rates(d, lab, target)
    rows = out.collect()
    assert len(rows) == 244 and all(r.rate >= 0 for r in rows)
    names = sorted(target)
    total = np.sum([np.array(r.p) * r.rate * r.n_tokens for r in rows if r.p], axis=0)
    assert total / sum(r.n_tokens for r in rows) == pytest.approx([target[c] for c in names], abs=1e-3)
    own = {r.doc_id: r for r in rows}
    assert own[1000].rate == own[1001].rate == 1 and own[1000].n_tokens == 0
    truth = {r[0]: r[2] for r in corpus()}
    assert np.mean([own[k].domain == c for k, c in truth.items()]) > 0.9
    mixed = mixing.mix(d, lab, target)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in rows)


def test_mixing_without_labels(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    assert {r.rate for r in mixing.rates(d, labelled(docs).where("false")).collect()} == {1.0}
    assert mixing.rates(d.where("false"), labelled(docs)).count() == 0


def test_mixing_plan_has_no_python(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    plan = mixing.mix(spark.read.parquet(str(tmp_path / "d")), labelled(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_toxicity_learns_from_long_texts(spark):
    """All labelled texts are long ones."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        words = ["".join(r.choice(VOICES["en"].split()) for _ in range(2)) for _ in range(1400)]
        toxic = i % 3 == 0
        for at in r.sample(range(1400), 12 if toxic else 0):
            words[at] = r.choice(["grumpf", "Blarg!", "snork"])
        rows.append((i, " ".join(words), int(toxic)))
    assert min(len(t) for _, t, _ in rows) > 6000
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {x.doc_id: x for x in toxicity.report(df, df.select("doc_id", "toxic")).collect()}
    apart = [k for k, _, _ in rows if got[k].held_out]
    assert len({x.score for x in got.values()}) > 1 and np.mean([got[k].predicted == rows[k][2] for k in apart]) >= 0.85


def test_ann_recall_in_a_hot_cluster():
    """A third of the vectors lie in one noisy cluster; brute force over all of them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:20_000] = x[0] + 0.5 / 8 * rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = ann.strings(x, ann.TREES)
    forest = ann.Forest(np.stack([np.bincount(s[:, t], minlength=128**ann.SYMBOLS) for t in range(ann.TREES)]), 64, ann.SLOT)
    hits = []
    for q in range(0, 20_000, 400):
        tree, string = forest.ascend(x[q])
        assert set(tree.tolist()) == set(range(ann.TREES))
        found = np.zeros(len(x), bool)
        for t in range(ann.TREES):
            found |= np.isin(s[:, t], string[tree == t])
        best = np.argsort(-(x @ x[q]))[1:6]
        hits.append(found[best].mean())
    assert np.mean(hits) >= 0.9


def test_samples_are_drawn_from_labels_that_have_texts(spark, monkeypatch):
    """Labels of absent documents take no place in a sample, and repeated ids don't make it larger."""
    monkeypatch.setattr(mixing, "SAMPLE", 20)
    docs = spark.createDataFrame([(i, ("bad words " if i % 10 == 0 else "good words ") * 5) for i in range(60)] * 3, "doc_id long, text string")
    labels = spark.range(40, 3000).selectExpr("id + 100 as doc_id", "'none' as domain").unionByName(spark.range(60).selectExpr("id as doc_id", "if(id % 10 = 0, 'toxic', 'good') as domain"))
    assert mixing._fit(docs, labels)[0] == ["good", "toxic"]
    marks = spark.range(100, 3000).selectExpr("id as doc_id", "0 as toxic").unionByName(spark.range(60).selectExpr("id as doc_id", "if(id % 10 = 0, 1, 0) as toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(labels))
    toxicity.train(docs, marks, 7)
    assert sorted(seen[0]) == [0] * 7 + [1] * 6


def test_long_urls_are_scored_whole_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("abc/-.é"), n)) for n in (0, 1, 5, 6, 7, 40, 900, 30_000)]
    made = ["http://x.com/" + u for u in made] + ["", "http://x.com/" + "a" * 70_000, "b"]
    df = spark.createDataFrame([(u, i % 2) for i, u in enumerate(made)], "url string, label int")
    whole = urls.fit(df)
    want = whole.ratio(made)
    one = urls.Models(whole.counts)
    i = 5
    row, context, seen = urls._grams([(0, made[i] + "\x03", 0)])
    assert len(row) == len(made[i]) + 1
    for size in (7, 64, 1 << 22):
        monkeypatch.setattr(urls, "SLICE", size)
        assert np.allclose(one.ratio(made), want, rtol=0, atol=1e-9)
        again = [urls._grams(p) for p in urls._slices([made[i]])]
        assert np.array_equal(np.concatenate([g[1] for g in again]), context) and np.array_equal(np.concatenate([g[2] for g in again]), seen)
        total = np.zeros_like(whole.counts).ravel()
        for f in urls._count([pd.DataFrame({"url": made, "label": [k % 2 for k in range(len(made))]})]):
            np.add.at(total, f.cell.to_numpy(), f.n.to_numpy())
        assert np.array_equal(total.reshape(whole.counts.shape), whole.counts)
