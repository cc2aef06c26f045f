"""Exact, near and repeated-string dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from varloom.llm import _common, bpe, exact, near, repeats, suffix
from varloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, rid string")


def stored(spark, rows, path):
    frame(spark, rows).write.parquet(str(path))
    return spark.read.parquet(str(path))


def family(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        words = [r.choice(vocabulary) for _ in range(r.choice([6, 30, 90, 200]))]
        for _ in range(n // 6):
            own = [r.choice(vocabulary) if r.random() < 0.03 else w for w in words]
            rows.append((len(rows), " ".join(own)))
    extra = [None, "", " \t\n", "one", "ONE", "one two", "One  two", "Éa éa x y z", "a b c d", "A B C D"]
    return rows + [(1000 + i, t) for i, t in enumerate(extra)] + [rows[3], rows[3]]


def test_exact_against_brute_force(spark, tmp_path):
    long = "abé\U0001f600 " * 20_000
    rows = [(5, "a b"), (3, " ab"), (4, "a b  "), (9, None), (8, ""), (7, " \n"), (1, "A b"), (2, long), (6, long + " "), (10, long[:-2]), (11, "a\x85b"), (5, "a b")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.report(stored(spark, rows, tmp_path / "t"), ).collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), d, k))
    want = [(d, min(groups[norm(t)])[1], len(groups[norm(t)]), min(groups[norm(t)])[2] == k, hashlib.sha256(norm(t).encode()).hexdigest()) for k, (d, t) in enumerate(rows)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_block_size_changes_nothing(spark, tmp_path, size):
    rows = [(i, t) for i, t in enumerate(["", "a", "ab", "abab", "ababab", "aba b ab", "abababa", "bababab", "a" * 50, "a" * 49, "a" * 50])]
    got = {r.doc_id: r.keep_id for r in exact.report(stored(spark, rows, tmp_path / "t"), size).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 8}


def test_drop_copies_keeps_columns(spark, tmp_path):
    out = exact.drop_copies(stored(spark, [(1, "x y"), (2, "xy"), (None, "z"), (3, "z")], tmp_path / "t"))
    assert out.columns == ["doc_id", "text", "rid"] and sorted((r.doc_id, r.text, r.rid) for r in out.collect() if r.doc_id) == [(1, "x y", "keep")] and out.count() == 2


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    name = {k: k for k in range(len(sets))}

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                name[max(x, y)] = min(x, y)
    low = defaultdict(list)
    for k in range(len(sets)):
        low[find(k)].append(sets[k][0])
    return [(d, len(s), min(low[find(k)]), d == min(low[find(k)])) for k, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_brute_force(spark, tmp_path, seed):
    rows = family(seed)
    got = [tuple(r) for r in near.report(stored(spark, rows, tmp_path / "t")).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_near_families_are_split(spark, tmp_path, monkeypatch):
    """A family of which many members differ too much from any heart, and parts of it; groups of more than 60 are split."""
    monkeypatch.setattr(near, "GROUP", 60)
    r = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        own = list(words)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            own[r.randrange(150)] = f"x{r.randrange(4)}"
        if k % 5 == 0:
            own = own[r.choice([0, 10, 20, 25, 30]) : r.choice([115, 125, 135, 150])]
        rows.append((k, " ".join(own)))
    got = [tuple(x) for x in near.report(stored(spark, rows, tmp_path / "t")).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_near_large_family(spark, tmp_path):
    """3,000 near copies with private and shared edits; components from exact sets by an index of shingles."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(110)]
    rows = []
    for k in range(3000):
        own = list(words)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            own[r.randrange(110)] = r.choice([f"p{k}", f"x{r.randrange(30)}"])
        rows.append((k, " ".join(own)))
    got = {x.doc_id: x.component_id for x in near.report(stored(spark, rows, tmp_path / "t")).collect()}
    sets = [shingles(t) for _, t in rows]
    place = {s: i for i, s in enumerate(set().union(*sets))}
    m = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 80 * (n[:, None] + n[None] - both)
    low = np.arange(len(rows))
    while (new := np.where(linked, low[None], len(rows)).min(1)).tolist() != low.tolist():
        low = new
    assert len(set(low.tolist())) > 5 and [got[k] for k in range(len(rows))] == low.tolist()


def test_near_groups_of_hundreds_are_settled_at_once(spark, tmp_path, monkeypatch):
    """A family with many members outside its largest component, and short texts around one line: no dealing to smaller buckets."""

    def never(*_):
        raise AssertionError("dealt to smaller buckets")

    monkeypatch.setattr(near, "_split", never)
    r = random.Random(4)
    words, line = [f"w{i}" for i in range(100)], [f"l{i}" for i in range(12)]
    rows = []
    for k in range(500):
        own = list(words)
        for _ in range(r.choice([0, 2, 4, 6, 8])):
            own[r.randrange(100)] = f"x{r.randrange(3)}"
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join([*(f"a{r.randrange(6)}" for _ in range(r.randrange(12))), *line, *(f"b{r.randrange(6)}" for _ in range(r.randrange(6)))])) for k in range(500, 900)]
    got = [tuple(x) for x in near.report(stored(spark, rows, tmp_path / "t")).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_words_of_one_polynomial_hash_stay_apart(spark, tmp_path):
    """Thue-Morse words and their complements agree under every polynomial hash modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(40)]
    rows = [(1, one), (2, other), (3, one[:1024]), (4, other[:1024]), (5, " ".join([one, *rest])), (6, " ".join([*rest, other])), (7, "c d e f"), (8, "f e d c"), (9, "c d e f")]
    got = [tuple(x) for x in near.report(stored(spark, rows, tmp_path / "t")).collect()]
    assert sorted(got) == sorted(brute_components(rows))
    h = bpe.word_hashes(np.frombuffer(f"{one} {other}".encode(), np.uint8), np.array([0, 4097, 0, 4097]), np.array([4096, 8193, 60, 4157]))
    assert len(set(h.tolist())) == 4


#: Words that one chain of unkeyed bijective mixes can't tell apart (built: the second half cancels what the first halves differ by).
BUILT = ("xxytvhcnaaadaaaa", "anuvfvoijfkxqvnh")


def test_words_built_to_collide_stay_apart(spark, tmp_path):
    rows = [(1, " ".join(f"{BUILT[0]} w{i}" for i in range(30))), (2, " ".join(f"{BUILT[1]} w{i}" for i in range(30))), (3, f"{BUILT[0]} a b"), (4, f"{BUILT[1]} a b")]
    got = [tuple(x) for x in near.report(stored(spark, rows, tmp_path / "t")).collect()]
    assert sorted(got) == sorted(brute_components(rows)) and all(kept for *_, kept in got)
    same = [bpe.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([16]))[0] for w in BUILT]
    keyed = [near.WordHashes(b"other")[w.encode()] for w in BUILT]
    assert same[0] == same[1] and keyed[0] != keyed[1]


def test_every_run_has_its_own_key():
    assert near.WordHashes(b"a")[b"word"] != near.WordHashes(b"b")[b"word"]


def test_components_survive_collisions_of_registers():
    """Registers of 16 bits collide; the estimate takes that off."""
    rng = np.random.default_rng(5)
    for n in (300, 3000):
        a, b = (np.stack([near.sketch(np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))) for _ in range(3000)]) for _ in range(2))
        seen = ((a == b) & (a > 0)).mean() / ((a > 0) & (b > 0)).mean()
        assert abs(seen / near.collisions(np.array([n]))[0] - 1) < 0.35
        assert abs(near.similarity(a, b, np.full(3000, n))[0].mean()) < 0.003


def test_drop_near_keeps_one_of_each_group(spark, tmp_path):
    rows, before = family(3), _common.staged()
    out = [r.doc_id for r in near.drop_near(stored(spark, rows, tmp_path / "t")).collect()]
    assert len(out) == len(set(out)) and set(out) == {c for _, n, c, _ in brute_components(rows)}
    assert _common.staged() - before == 1  # what the result reads


def test_sketch_estimates(spark):
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8, 0.95):
        h = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
        k = int(2000 * share)
        a, b = np.sort(h[:2000]), np.sort(np.concatenate([h[:k], h[2000 : 4000 - k]]))
        got, used = near.similarity(near.sketch(a)[None], near.sketch(b)[None], np.array([2000]))
        true = k / (4000 - k)
        assert used[0] > 100 and abs(got[0] - true) < 0.2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def brute_repeats(rows, n=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((d, len(b), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 260, 700)]
    rows = [(i, text(r.randrange(400)) + r.choice(shared) + text(r.randrange(300)) + r.choice(shared)) for i in range(25)]
    rows += [(30, None), (31, ""), (32, "x" * 1000), (33, "ab" * 300), (34, "x" * 199), (3, rows[3][1]), (3, rows[3][1]), (35, text(200) * 3)]
    return rows


@pytest.mark.parametrize("hot,piece", [(512, 1 << 21), (1, 300)])
def test_repeats_against_brute_force(spark, tmp_path, monkeypatch, hot, piece):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = passages(hot)
    got = [tuple(r) for r in repeats.report(stored(spark, rows, tmp_path / "t")).collect()]
    assert sorted(got) == sorted(brute_repeats(rows))


def test_runs_of_windows_are_made_once_and_in_proportion(spark):
    """Spans of one gram: rows of runs grow with the spans, and the result does not make them again."""
    r = random.Random(2)
    spans = [(1, k, (100 << 8) | 250, 1, bytearray(r.choice(b"abcd") for _ in range(350))) for k in range(80)]
    contexts = spark.createDataFrame(spans, "key long, span long, shape long, n long, bytes binary")
    count = lambda c: c.mapInArrow(repeats._chunk_rows, "key long, span long, n long, lo int, hi int, core long, whole long, one binary, two binary").count()
    assert count(contexts) == 2 * count(contexts.where("span < 40")) <= 26 * 80
    assert "_chunk_rows" not in repeats._hot_hits(contexts)._jdf.queryExecution().optimizedPlan().toString()


def test_levels_find_what_one_array_finds():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 500, 900).astype(np.uint64)
    two = one * np.uint64(7)
    levels = suffix.Levels()
    for i in range(0, 900, 90):
        levels.add(one[i : i + 90], two[i : i + 90], np.zeros(90, bool))
    n = Counter(one.tolist())
    assert levels.matched.tolist() == [n[x] > 1 for x in one.tolist()] and len(levels.levels) <= 5


@pytest.mark.parametrize("f", [exact.report, near.report, repeats.report])
def test_empty_tables(spark, tmp_path, f):
    assert f(stored(spark, [], tmp_path / "t")).count() == 0
