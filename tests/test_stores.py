"""Stores on disk: aggregate scores, genotypes by range, sets by unit; permutations from tables and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import aggstore as A
from varloom.operators import assoc
from varloom.operators import geno as G
from varloom.operators import resample
from varloom.operators import score as S
from varloom.operators import store as St
from varloom.sources import files, setstore

R = np.random.default_rng(3)
N = 45


@pytest.fixture(scope="module")
def study(spark):
    samples = spark.createDataFrame([(i, i % 3, float(R.normal()), float(i % 5)) for i in range(N)], "IID long, sex int, q double, age double")
    variants = spark.createDataFrame([(v, "XnonPAR" if v % 4 == 3 else "diploid", 2 if v == 5 else 0) for v in range(12)], "VAR_id long, ploidy string, g0 int")
    cells = [(v, int(i), None if R.random() < 0.1 else int(R.integers(0, 3))) for v in range(12) for i in R.choice(N, 15, False)]
    members = spark.createDataFrame([(f"u{v % 3}", v, 1.0 + v % 2) for v in range(12)], "unit string, VAR_id long, w double")
    return G.Geno(variants, samples, spark.createDataFrame(cells, "VAR_id long, IID long, gt int")), members


def scores(df):
    return {(r.unit, r.IID): r.score for r in df.collect()}


def test_aggregate_store_round_trip(study, spark, tmp_path):
    g, m = study
    one = A.AggStore.create(g, m.where("unit = 'u0'"), {"id": "a", "genomeBuild": "b"}, impute="meanImpute", MAF=(0.0, 1.0))
    two = A.AggStore.create(g, m.where("unit <> 'u0'"), {"id": "a", "genomeBuild": "b"}, impute="meanImpute", MAF=(0.0, 1.0))
    both = A.merge([one, two])
    both.save(str(tmp_path / "s"), buckets=8)
    back = A.AggStore.open(spark, str(tmp_path / "s"))
    assert back.params == both.params == {"impute": "meanImpute", "MAF": [0.0, 1.0]} and back.meta == both.meta and back.buckets == 8
    assert [r.IID for r in back.list_samples().collect()] == list(range(N)) and sorted(r.unit for r in back.list_units().collect()) == ["u0", "u1", "u2"]
    dense = scores(G.scores(g, *G.burden(g, m)))
    with pytest.warns(UserWarning, match="1 of 3"):
        got = scores(back.get_unit(["u0", "u2", "gone"]))
    assert got.keys() == {k for k in dense if k[0] != "u1"} and all(v == pytest.approx(dense[k], rel=1e-5, abs=1e-9) for k, v in got.items())
    assert all(v == float(f"{v:.6g}") for v in got.values())
    plan = back._some(["u0"]).dev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.warns(UserWarning):
        assert back.get_unit(["gone"]) is None
    with pytest.raises(A.AggError):
        back.get_unit([])
    total = {r.IID: r.aggregate for r in A.collapse([back, one]).collect()}
    assert total == pytest.approx({i: sum(v for (u, j), v in dense.items() if j == i) + dense["u0", i] for i in range(N)})


def test_stores_that_differ_are_refused(study):
    g, m = study
    make = lambda unit, meta, geno=g, **o: A.AggStore.create(geno, m.where(f"unit = '{unit}'"), {"id": "a", "genomeBuild": "b"} | meta, **o)
    fewer = G.Geno(g.variants, g.samples.where("IID > 3"), g.stored.where("IID > 3"))
    for other in (make("u0", {}), make("u1", {}, model="dominant"), make("u1", {"id": "z"}), make("u1", {"genomeBuild": "z"}), make("u1", {}, fewer)):
        with pytest.raises(A.AggError):
            A.merge([make("u0", {}), other])
    with pytest.raises(A.AggError):
        A.merge([make("u0", {})])


def test_permutations_of_tables_and_files_agree(study, spark, tmp_path):
    g, m = study
    per, dev = G.burden(g, m)
    model = S.fit_null(g.samples, "q", ["age"])
    perms = assoc.resampling_table(spark, N, 70, seed=5)
    files.write_permutations(perms, str(tmp_path / "p"), N, 70)
    got = {r.unit: r for r in resample.permutation_tests(per, dev, model, perms).collect()}
    again = {r.unit: r for r in resample.permutation_tests(per, dev, model, resample.from_file(spark, str(tmp_path / "p"))).collect()}
    assert got.keys() == again.keys() == {"u0", "u1", "u2"} and all(got[u].P == again[u].P for u in got)
    dense = scores(G.scores(g, per, dev))
    res = np.array([r.r for r in model.samples.orderBy("IID").collect()])
    orders = {}
    for r in perms.collect():
        orders.setdefault(r.perm_id, np.zeros(N, int))[r.position - 1] = r.sample - 1
    each = {(r.unit, r.perm_id): r.U for r in resample.permutation_results(per, dev, model, perms).collect()}
    for u, row in got.items():
        s = np.array([dense[u, i] for i in range(N)])
        want = {b: s @ res[o] for b, o in orders.items()}
        assert {b: each[u, b] for b in want} == pytest.approx(want, abs=1e-9)
        assert row.U == pytest.approx(s @ res) and row.nResampling == 70
        assert row.P == pytest.approx((sum(abs(x) > abs(row.U) * (1 + 1e-9) for x in want.values()) + 1) / 71)
    assert resample.top_permutations(resample.permutation_results(per, dev, model, perms), 3).count() == 9
    with pytest.raises(ValueError):
        resample.permutation_tests(per, dev, model, perms.where("position <> 4"))
    with pytest.raises(ValueError):
        resample.permutation_tests(per, dev, model, perms.where("false"))


def test_a_grid_of_tasks_reads_genotypes_once(study):
    g, _ = study
    g = G.Geno(g.variants, g.samples.withColumn("case", F.when(F.col("IID") % 7 > 0, (F.col("q") > 0).cast("int"))).withColumn("late", F.when(F.col("IID") > 9, F.col("age"))), g.stored)
    tasks = [("q", ["late"], "linear"), ("case", [], "logistic"), ("case", ["age"], "logistic")]
    grid = S.score_grid(g, tasks, ["dominant"])
    key = lambda r: (r.VAR_id, r.pheno, r.covar, r.geneticModel)
    got = {key(r): r for r in grid.collect()}
    assert grid._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") >= 3
    n = 0
    for pheno, covar, kind in tasks:
        for r in S.score_variants(g, S.fit_null(g.samples, pheno, covar, kind), "dominant").collect():
            for c, want in r.asDict().items():
                assert got[key(r)][c] == (pytest.approx(want, abs=1e-12) if isinstance(want, float) else want), (key(r), c)
            n += 1
    assert n == len(got)


def test_genotypes_on_disk_by_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(St, "SPAN", 4)
    var = spark.createDataFrame([(v, "1" if v < 10 else "2", 10 * v, "A", "C", 0) for v in range(20)], "VAR_id long, CHROM string, POS int, REF string, ALT string, g0 int")
    samples = spark.createDataFrame([(f"s{i}", i % 3, i) for i in range(6)], "IID string, sex int, sample_idx int")
    stored = spark.createDataFrame([(v, f"s{i}", 1) for v in range(20) for i in range(6) if (v + i) % 2], "VAR_id long, IID string, gt int")
    St.Store.create(var, samples, stored).save(str(tmp_path / "s"))
    s = St.Store.open(spark, str(tmp_path / "s"))
    ids = spark.createDataFrame([(5,), (6,), (17,)], "VAR_id long")
    some = s.get_gt(var_ids=ids)
    assert {(r.VAR_id, r.IID) for r in some.stored.collect()} == {(r.VAR_id, r.IID) for r in stored.collect() if r.VAR_id in (5, 6, 17)}
    read = s._stored(s.var.join(ids, "VAR_id", "left_semi"), True)
    assert read.where("VAR_id not between 4 and 7 and VAR_id not between 16 and 19").count() == 0 and read.count() < s.stored.count()
    assert "part" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert s.get_gt(ranges=spark.createDataFrame([("1", 15, 31)], "CHROM string, start int, end int")).variants.count() == 2
    weighted = s.get_gt(var_set=spark.createDataFrame([("u", "n", 3, 0.5), ("v", "n", 3, 0.5)], "unit string, varSetName string, VAR_id long, w double"))
    assert [r.w for r in weighted.variants.collect()] == [0.5]
    with pytest.warns(UserWarning, match="1 variants"):
        s.get_gt(var_ids=spark.createDataFrame([(1,), (99,)], "VAR_id long"))
    with pytest.raises(St.StoreError):
        s.get_gt()
    with pytest.raises(St.StoreError):
        s.get_gt(var_ids=ids, ranges=ids)
    with pytest.raises(St.StoreError):
        s.get_gt(var_set=spark.createDataFrame([(3, 0.5), (3, 0.7)], "VAR_id long, w double"))
    assert St.subset(s, ids).geno(ids).stored.count() == some.stored.count()


def test_sets_by_unit(spark, tmp_path):
    sets = spark.createDataFrame([(f"u{k % 9}", f"n{k % 2}", k, None if k == 7 else k / 2) for k in range(60)], "unit string, varSetName string, VAR_id long, w double")
    setstore.save_sets(sets, str(tmp_path / "s"), buckets=8)
    s = setstore.SetStore.open(spark, str(tmp_path / "s"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = s.get(units=["u1", "u4"])
    assert rows(got) == rows(sets.where("unit in ('u1', 'u4')"))
    assert "bucket" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert rows(s.get(names=["n0"])) == rows(sets.where("varSetName = 'n0'"))
    with pytest.warns(UserWarning, match="1 of 2 values of unit"):
        assert rows(s.get(units=["u1", "gone"], names=["n1"])) == rows(sets.where("unit = 'u1' and varSetName = 'n1'"))
    with pytest.raises(ValueError):
        s.get()
    assert s.list_units().count() == 9 and s.list_names().count() == 2 and s.sizes().agg(F.sum("n")).first()[0] == 60


def test_small_operators(study, spark, tmp_path):
    from varloom.operators import sets as Se

    g, m = study
    var = spark.createDataFrame([(1, "1", 5), (2, "1", 9), (3, "2", 4)], "VAR_id long, CHROM string, POS int")
    own = spark.createDataFrame([("a", "n", 1), ("a", "n", 2), ("b", "n", 3), ("c", "n", 77)], "unit string, varSetName string, VAR_id long")
    assert {(r.unit, r.CHROM, r.start, r.end) for r in Se.set_ranges(own, var, keep_missing=True).collect()} == {("a", "1", 5, 9), ("b", "2", 4, 4), ("c", None, None, None)}
    with pytest.raises(ValueError):
        Se.set_ranges(own, var.union(var), keep_missing=True)
    made = Se.build_gene_set({"s": ["x", "y", "x"], "t": []}, spark)
    assert sorted(map(tuple, made.collect())) == [("s", "x", 1.0, ""), ("s", "y", 1.0, "")]
    assert [tuple(r) for r in Se.build_gene_set(spark.createDataFrame([("s", "u", 2)], "a string, b string, c int")).collect()] == [("s", "u", 2.0, "")]
    with pytest.raises(ValueError):
        Se.build_gene_set(var.select("VAR_id"))
    (tmp_path / "r.tsv").write_text("CHROM\tstart\tend\tgene\n1\t5\t9\tG\n")
    assert tuple(files.read_ranges(spark, str(tmp_path / "r.tsv")).first()) == ("1", 5, 9, "G")
    left, counted = G.filtered(g, complete=["q"], MAF=(0.05, 0.5))
    assert {r.VAR_id for r in counted.collect()} == {r.VAR_id for r in left.variants.collect()} and left.stored.count() <= g.stored.count()
    grouped = G.Geno(g.variants, g.samples.withColumn("pop", F.when(F.col("IID") % 4 > 0, F.col("IID") % 4)), g.stored)
    per, dev = G.burden(grouped, m)
    dense = scores(G.scores(grouped, per, dev))
    for r in G.mean_burden(grouped, per, dev, "pop").collect():
        assert r.meanBurden == pytest.approx(np.mean([v for (u, i), v in dense.items() if u == r.unit and i % 4 == r.pop]))
    apart = {(r.VAR_id, r.pop): r for r in G.summarise_by(grouped, "pop").collect()}
    flags = {r.VAR_id: r.flipped for r in G.flip(G.counts(grouped)).collect()}
    for pop in (1, 2, 3):
        one = G.Geno(grouped.variants, grouped.samples.where(f"pop = {pop}"), grouped.stored)
        for r in G.summarise(G.flip(G.counts(one), F.col("VAR_id").isin([v for v, f in flags.items() if f]))).collect():
            assert tuple(apart[r.VAR_id, pop])[2:] == pytest.approx(tuple(r)[1:], nan_ok=True)
    assert G.summarise_by(grouped, "pop", MAF=(0.2, 0.5)).count() < len(apart)
