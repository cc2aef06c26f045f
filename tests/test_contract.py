"""The driver's entry points, the tools around them, and the command line."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from varloom import cli
from varloom.functions import expr as E
from varloom.operators import ranges as R
from varloom.operators import results
from varloom.operators import store as S

REPO = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) >= 60


def test_imports_without_the_text_operators(tmp_path):
    code = "import sys; sys.modules['varloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'summarise_geno' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_overlap_does_not_depend_on_bins(spark):
    a = spark.createDataFrame([(i, "1", i * 7 % 90, i * 7 % 90 + i % 13) for i in range(60)], "a long, CHROM string, start int, end int")
    b = spark.createDataFrame([(i, "1", i * 11 % 80, i * 11 % 80 + i % 29) for i in range(50)] + [(99, "2", 1, 90)], "b long, CHROM string, start int, end int")
    want = {(x.a, y.b) for x in a.collect() for y in b.collect() if x.CHROM == y.CHROM and x.start <= y.end and x.end >= y.start}
    for width in (1, 5, 1000):
        rows = R.overlap(a, b, width).select("a", "r_b").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_touching_intervals_and_deletions(spark):
    var = spark.createDataFrame([(1, "chr1", 10, "A"), (2, "1", 6, "ACGTA"), (3, "1", 21, "A")], "VAR_id long, CHROM string, POS int, REF string")
    r = spark.createDataFrame([("1", 10, 20), ("chr1", 10, 10)], "CHROM string, start int, end int")
    assert sorted(x.VAR_id for x in R.extract_ranges(var, r).collect()) == [1, 1, 2, 2]


@pytest.mark.parametrize("strand,want", [("+", {1: 1, 2: 10, 3: 11, 4: 10}), ("-", {1: 20, 2: 11, 3: 10, 4: 11})])
def test_coding_positions(spark, strand, want):
    exons = spark.createDataFrame([("T", "1", 100, 109, strand), ("T", "1", 200, 209, strand)], "transcript_id string, CHROM string, start int, end int, strand string")
    var = spark.createDataFrame([(1, "1", 100), (2, "1", 109), (3, "1", 200), (4, "1", 112), (5, "1", 150)], "VAR_id long, CHROM string, POS int")
    assert {r.VAR_id: r.cdsPOS for r in R.map_to_cds(var, exons).collect()} == want


def test_blocks_split_only_beyond_the_distance(spark):
    u = spark.createDataFrame([("a", "1", 1, 10), ("b", "1", 16, 20), ("c", "1", 27, 30), ("d", "2", 1, 2)], "unit string, CHROM string, start int, end int")
    assert {r.unit: r.block for r in R.add_blocks(u, 5).collect()} == {"a": 1, "b": 1, "c": 2, "d": 3}


def test_numbering(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(7)
    assert [(r.k, r.n) for r in S.number_rows(df, ["k"], "n").orderBy("k").collect()] == [(i, i + 1) for i in range(500)]


def test_expressions(spark):
    import math

    x = spark.createDataFrame([(v,) for v in (-2.0, -0.5, 0.0, 0.3, 2.5, 6.0)], "x double")
    for r in x.select("x", F.expr(E.erfc_sql("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=2e-7)
    p = spark.createDataFrame([(v,) for v in (1e-6, 0.01, 0.5, 0.975, 0.9999)], "p double")
    for r in p.select("p", F.expr(E.qnorm_sql("p")).alias("q")).collect():
        assert 0.5 * math.erfc(-r.q / math.sqrt(2)) == pytest.approx(r.p, rel=1e-6)
    s = spark.createDataFrame([(123456.789,), (0.000123456789,), (0.0,), (None,)], "s double").select(E.signif(F.col("s")).alias("v")).collect()
    assert [r.v for r in s] == [pytest.approx(123457), pytest.approx(0.000123457), 0.0, None]


def test_acat_of_one_p_is_that_p(spark):
    df = spark.createDataFrame([("u", "t", 0.03), ("v", "t", 1e-18), ("w", "t", None)], "unit string, test string, P double")
    assert {r.unit: r.P for r in results.acat(df, ["test"], ["unit", "test"], fix=None).collect()} == {"u": pytest.approx(0.03), "v": pytest.approx(1e-18, rel=1e-6)}


def test_cli_builds_and_summarises(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tG\t.\t.\t.\tGT\t0/1\t0/0\n")
    cli.run(["build-gdb", "--vcf", str(tmp_path / "a.vcf"), "--output", str(tmp_path / "store")])
    cli.run(["summarise-geno", "--gdb", str(tmp_path / "store"), "--output", str(tmp_path / "out")])
    r = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).first()
    assert float(r.AF) == 0.25 and r.geno1 == "1"
    cli.run(["write-vcf", "--gdb", str(tmp_path / "store"), "--output", str(tmp_path / "vcf")])
    assert spark.read.text(str(tmp_path / "vcf/records")).first().value.endswith("0/1\t0/0")
    with pytest.raises(SystemExit):
        cli.run(["no-such-command"])


def test_cli_tests_burdens_natively(spark, tmp_path, monkeypatch):
    """Aggregate, merge, gene sets, units, single variants and a resampling file through the command line."""
    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda n: str(tmp_path / n)
    gt = lambda v, i: ("0/1", "1/1", "0/0", "0/0", "./.")[(v * 7 + i * i + i * v) % 5]
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i:02d}" for i in range(30))
    rows = [f"1\t{5 + v}\t.\tA\tG\t.\t.\t.\tGT\t" + "\t".join(gt(v, i) for i in range(30)) for v in range(6)]
    (tmp_path / "a.vcf").write_text("\n".join([head, *rows]) + "\n")
    (tmp_path / "c.tsv").write_text("IID\tsex\tq\tage\n" + "".join(f"s{i:02d}\t{1 + i % 2}\t{(i * 37 % 11) / 3}\t{i % 7}\n" for i in range(30)))
    (tmp_path / "v.txt").write_text("u1|1,2,3|1,1,1|all\nu2|4,5,6|1,2,1|all\n")
    (tmp_path / "w.txt").write_text("u3|2,5|1,1|all\n")
    (tmp_path / "g.txt").write_text("set|u1,u3|1,1|\n")
    cli.run(["build-gdb", "--vcf", at("a.vcf"), "--output", at("s0")])
    cli.run(["upload-cohort", "--gdb", at("s0"), "--name", "pheno", "--value", at("c.tsv"), "--output", at("s")])
    gdb = ["--gdb", at("s"), "--cohort", "pheno"]
    for sets, out in (("v.txt", "a1"), ("w.txt", "a2")):
        cli.run(["aggregate", *gdb, "--varset", at(sets), "--output", at(out)])
    cli.run(["merge-aggs", "--targets", at("a1"), at("a2"), "--output", at("agg")])
    test = ["--pheno", "q", "--test", "lm", "--continuous", "--covar", "age"]
    cli.run(["assoc-aggs", *gdb, "--aggdb", at("agg"), "--geneset", at("g.txt"), "--output", at("o1"), *test])
    cli.run(["assoc", *gdb, "--varset", at("v.txt"), "--output", at("o2"), *test, "--offset", "age"])
    cli.run(["assoc", *gdb, "--singlevar", "--output", at("o3"), *test])
    cli.run(["build-resampling", "--n", "30", "--resampling", "20", "--output", at("perm")])
    cli.run(["assoc", *gdb, "--varset", at("v.txt"), "--output", at("o4"), *test, "--resampling-file", at("perm")])
    read = lambda n: spark.read.option("sep", "\t").option("header", True).csv(at(n))
    assert [(r.geneSetName, r.genesObs) for r in read("o1").collect()] == [("set", "2")]
    assert sorted(r.unit for r in read("o2").where("P is not null").collect()) == ["u1", "u2"] and read("o3").count() == 6
    assert all(0 < float(r.P) <= 1 and r.test == "lm_resampled" for r in read("o4").collect()) and read("o4").count() == 2
