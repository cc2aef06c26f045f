import pytest
from pyspark.sql import functions as F

from varloom.operators import geno as G
from varloom.operators import store as S
from varloom.sources import files, vcf

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=1>
##INFO=<ID=DB,Number=0>
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s1	s2	s3
1	100	.	A	G	.	PASS	AC=1;DB	GT:DP	0/0:1	0|1:2	1/1:3
1	200	rs1	C	T,A	.	PASS	AC=2	GT:DP	0/1:1	1/2:2	./.:3
X	300	.	TCA	T	.	PASS	ZZ=9	GT	1	0	./.
"""


@pytest.fixture()
def path(tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text(VCF)
    return str(p)


def test_build_and_write(spark, path, tmp_path):
    s = vcf.build(spark, path)
    var = [tuple(r) for r in s.var.orderBy("VAR_id").select("VAR_id", "CHROM", "POS", "ALT").collect()]
    assert var == [(1, "1", 100, "G"), (2, "1", 200, "T"), (3, "1", 200, "A"), (4, "X", 300, "T")]
    got = {(r.VAR_id, r.IID): r.gt for r in s.stored.collect()}
    assert got == {(1, "s2"): 1, (1, "s3"): 2, (2, "s1"): 1, (2, "s2"): 1, (2, "s3"): None, (3, "s2"): 1, (3, "s3"): None, (4, "s1"): 1, (4, "s3"): None}
    lines = {r.VAR_id: r.value.split("\t")[9:] for r in vcf.lines_of(G.Geno(s.var, s.samples, s.stored)).collect()}
    assert lines[2] == ["0/1", "0/1", "./."] and lines[1] == ["0/0", "0/1", "1/1"]
    vcf.write(G.Geno(s.var, s.samples, s.stored), str(tmp_path / "out"))
    again = vcf.build(spark, [str(tmp_path / "out/header"), str(tmp_path / "out/records")])
    assert again.var.count() == 4 and again.stored.count() == s.stored.count()


def test_unknown_genotype_is_an_error(spark, path):
    df = spark.createDataFrame([("0/.",)], "t string").select(vcf.dosage(F.col("t")))
    with pytest.raises(Exception, match="unknown genotype"):
        df.collect()


@pytest.mark.parametrize("code,value", [("0/0", 0), ("0|0", 0), ("0/1:3", 1), ("1|0", 1), ("1/1", 2), ("./.", None), ("./0", 0), ("./1", 1), (".|1", 1), (".:0", None), ("0", 0), ("1", 1), ("2", 2)])
def test_codes(spark, code, value):
    assert spark.createDataFrame([(code,)], "t string").select(vcf.dosage(F.col("t"))).first()[0] == value


def test_info(spark, path):
    lines = vcf.read_lines(spark, path)
    assert [(r.ALT, r.AC, r.DB) for r in vcf.info_table(lines).orderBy("POS", F.desc("ALT")).collect()] == [("G", "1", "DB"), ("T", "2", "NA"), ("A", "2", "NA"), ("T", "NA", "NA")]
    assert vcf.undeclared(lines) == ["ZZ"]


def test_store_round_trip(spark, path, tmp_path):
    s = vcf.build(spark, path)
    anno = spark.createDataFrame([("chr1", 100, "A", "G", "g1"), ("1", 200, "C", "A", "g2"), ("1", 5, "C", "A", "g3")], "CHROM string, POS int, REF string, ALT string, gene string")
    s = s.upload_anno("genes", anno)
    assert sorted((r.VAR_id, r.gene) for r in s.annos["genes"].collect()) == [(1, "g1"), (3, "g2")]
    cohort = spark.createDataFrame([("s1", "1", 1), ("s3", "9", 0)], "IID string, sex string, pheno int")
    s = s.upload_cohort("c", cohort)
    s.save(str(tmp_path / "store"))
    t = S.Store.open(spark, str(tmp_path / "store"))
    assert t.var.count() == 4 and t.stored.count() == 9 and set(t.annos) == {"genes"}
    assert sorted((r.IID, r.sex) for r in t.geno(cohort="c").samples.collect()) == [("s1", 1), ("s3", 0)]
    assert t.drop_table("genes").annos == {}
    with pytest.raises(S.StoreError):
        s.upload_anno("var", anno)
    with pytest.raises(S.StoreError):
        s.upload_cohort("d", cohort.union(cohort))


def test_set_files(spark, tmp_path):
    sets = spark.createDataFrame([("u", "n", 1, 1.0), ("u", "n", 2, None), ("v", "n", 3, 0.5)], "unit string, varSetName string, VAR_id long, w double")
    files.write_varsets(sets, str(tmp_path / "v"))
    assert sorted(map(tuple, files.read_varsets(spark, str(tmp_path / "v")).collect()), key=str) == sorted(map(tuple, sets.collect()), key=str)
    gs = spark.createDataFrame([("a", "g1", 1.0), ("a", "g2", 2.0)], "geneSetName string, unit string, w double")
    files.write_genesets(gs, str(tmp_path / "g"))
    assert files.read_genesets(spark, str(tmp_path / "g")).count() == 2
    (tmp_path / "x.gmt").write_text("s1\tdesc\tg1\tg2\ns2\tdesc\tg3\n")
    assert files.read_gmt(spark, str(tmp_path / "x.gmt")).count() == 3


def test_bed_and_gtf(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t0\t10\tx\n")
    assert tuple(files.read_bed(spark, str(tmp_path / "a.bed"), ["name"]).first()) == ("chr1", 1, 10, "x")
    (tmp_path / "a.gtf").write_text('1\thavana\tCDS\t5\t9\t.\t+\t0\tgene_id "G1"; transcript_id "T1"; gene_name "N";\n')
    r = files.read_gtf(spark, str(tmp_path / "a.gtf")).first()
    assert (r.start, r.end, r.strand, r.gene_id, r.transcript_id, r.gene_biotype) == (5, 9, "+", "G1", "T1", None)


def test_result_files(spark, tmp_path):
    from varloom.operators.results import GSA

    df = spark.createDataFrame([("s", "lm", "", None, 3, 2, 0.1, 0.2, 0.0, 1.0, 0.5)], ", ".join(f"{c} {'string' if c in ('geneSetName', 'test', 'covar') else 'double' if c not in ('geneSetSize', 'genesObs') else 'int'}" for c in GSA))
    files.write_result(df, str(tmp_path / "r"), {"id": "x"})
    got, kind, meta = files.read_result(spark, str(tmp_path / "r"))
    assert kind == "gsaResult" and meta == {"id": "x"} and got.first().P == 0.5
