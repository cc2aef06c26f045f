import random

import corpus_pipeline


def test_stages_on_small_tables(spark, tmp_path):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join([word() for _ in range(40)] + (["snork"] * 4 if i % 4 == 0 else [])), "en", "s", 9) for i in range(80)]
    rows += [(100, rows[1][1] + " ", "en", "s", 9), (101, rows[1][1] + " more", "en", "s", 9), (102, None, None, None, None), (103, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = lambda n: [x.doc_id for x in spark.read.parquet(str(tmp_path / n)).collect()]
    toxic = {i for i in range(80) if i % 4 == 0}
    assert len(toxic - set(ids("toxicity"))) >= 16 and len(ids("toxicity")) >= 60
    assert 100 in ids("exact_dedup") and 1 not in ids("exact_dedup")
    assert sum(i in ids("near_dedup") for i in (1, 100, 101)) == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids("bpe"))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_stage_takes_five_words(spark, tmp_path):
    """Pairs that are near copies at four words only stay both; five-word brute force says which."""
    r = random.Random(3)
    rows = []
    for k in range(0, 60, 2):
        words = [f"w{k}x{i}" for i in range(r.randrange(40, 90))]
        other = list(words)
        for at in r.sample(range(6, len(words) - 6), r.choice([1, 2])):
            other[at] = f"y{k}x{at}"
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]

    def near(a, b, size):
        x, y = ({tuple(t.split()[i : i + size]) for i in range(len(t.split()) - size + 1)} for t in (a, b))
        return 100 * len(x & y) >= 80 * len(x | y)

    gone = {size: {k + 1 for k in range(0, 60, 2) if near(rows[k][1], rows[k + 1][1], size)} for size in (4, 5)}
    assert gone[5] < gone[4]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.drop_near(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == set(range(60)) - gone[5]


def test_near_stage_settles_groups_of_hundreds_at_once(spark, tmp_path, monkeypatch):
    """With the pipeline's shingles, a family of hundreds with many members outside its largest component is not dealt to smaller buckets."""

    def never(*_):
        raise AssertionError("dealt to smaller buckets")

    monkeypatch.setattr(corpus_pipeline.near, "_split", never)
    r = random.Random(9)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(400):
        own = list(words)
        for _ in range(r.choice([0, 2, 4, 6])):
            own[r.randrange(100)] = f"x{r.randrange(3)}"
        texts.append(own)
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    out = corpus_pipeline.drop_near(spark, spark.read.parquet(str(tmp_path / "t")), "")
    sets = [{tuple(t[i : i + corpus_pipeline.SHINGLE]) for i in range(len(t) - corpus_pipeline.SHINGLE + 1)} for t in texts]
    low = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b) and low[i] != low[j]:
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    assert sorted(x.doc_id for x in out.collect()) == sorted(set(low))


def test_near_stage_goes_once_through_groups_too_large_for_a_task(spark, tmp_path, monkeypatch):
    """Blocks of such a group meet in one step: its members are not dealt to buckets by shingle, to be gone through again."""
    near, rounds, dealt = corpus_pipeline.near, [], []
    opened, split = near._open, near._split
    monkeypatch.setattr(near, "GROUP", 50)
    monkeypatch.setattr(near, "_open", lambda *a: rounds.append(1) or opened(*a))

    def counted(members, *more):
        out = split(members, *more)
        dealt.append((members.count(), out.count(), max(x["count"] for x in out.groupBy(out.columns[0]).count().collect())))
        return out

    monkeypatch.setattr(near, "_split", counted)
    r = random.Random(12)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(400):
        own = list(words)
        for _ in range(r.choice([0, 2, 4, 6])):
            own[r.randrange(100)] = f"x{r.randrange(3)}"
        texts.append(own)
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    out = corpus_pipeline.drop_near(spark, spark.read.parquet(str(tmp_path / "t")), "")
    sets = [{tuple(t[i : i + corpus_pipeline.SHINGLE]) for i in range(len(t) - corpus_pipeline.SHINGLE + 1)} for t in texts]
    low = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b) and low[i] != low[j]:
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    assert sorted(x.doc_id for x in out.collect()) == sorted(set(low))
    assert len(rounds) == 2 and len(dealt) == 1
    members, rows, most = dealt[0]
    assert members > 0 and rows < 40 * members and most <= 2 * 50


def test_threads_keep_their_own_stage_tables(spark):
    """A query that cleans up leaves the tables of one in another thread alone."""
    import threading

    from varloom.llm import _common

    made, other, go = {}, {}, threading.Event()

    def query():
        other["mark"] = _common.staged()
        other["table"] = _common.stage_table(spark.range(5), "other")
        go.wait(60)
        other["rows"] = other["table"].count()
        _common.sweep(spark, other["mark"])

    t = threading.Thread(target=query)
    mark = _common.staged()
    made["table"] = _common.stage_table(spark.range(3), "own")
    t.start()
    while "table" not in other and t.is_alive():
        t.join(0.1)
    _common.sweep(spark, mark)
    go.set()
    t.join(60)
    assert other["rows"] == 5 and _common.staged() == mark
