import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia.operators import aggregates, joins, qc
from allelia.plans import sinks
from allelia.sources import genotypes as GS
from allelia.sources import text as T
from allelia.streaming.ingest import ingest_new


def test_bed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    block = rng.integers(-1, 3, (37, 23)).astype(np.int8)
    (tmp_path / "a.bed").write_bytes(GS.packed_bed(block))
    rows = GS.read_bed(spark, str(tmp_path / "a.bed"), 23, block=10).collect()
    got = np.zeros_like(block)
    for r in rows:
        got[r.marker_index, r.idx], got[r.marker_index, r.missing] = np.array(r.dos), -1
    assert (got == block).all()
    with pytest.raises(ValueError):
        GS.unpacked_bed(b"xyz", 3)


@pytest.mark.parametrize("compression", [0, 1, 2])
def test_bgen_round_trip(spark, tmp_path, compression):
    rng = np.random.default_rng(2)
    markers, dosage = [], []
    for k in range(5):
        p = rng.dirichlet([1, 1, 1], 11)[:, :2]
        p = np.floor(p * 255).astype(np.uint8)
        missing = rng.uniform(size=11) < 0.2
        markers.append((f"v{k}", f"rs{k}", "1", 100 + k, "A", "G", p, missing))
        dosage.append(np.where(missing, -1, 2 - (2.0 * p[:, 0] + p[:, 1]) / 255.0))
    data = GS.write_bgen(markers, [f"s{i}" for i in range(11)], compression)
    (tmp_path / "a.bgen").write_bytes(data)
    assert GS.bgen_header(data)["ids"] == [f"s{i}" for i in range(11)]
    for r in GS.read_bgen(spark, str(tmp_path / "a.bgen")).collect():
        want = dosage[r.marker_index]
        assert r.rsid == f"rs{r.marker_index}" and r.missing == np.flatnonzero(want < 0).tolist()
        assert np.allclose(r.dos, want[r.idx]) and r.info <= 1


def test_vcf_fields_and_missing_calls(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td\n"
    (tmp_path / "x.vcf").write_text(head + "1\t5\trs\ta\tg,t\t.\t.\tR2=0.5;X\tGT:DS\t0|1:0.9\t./.:.\t1/1:2\t0/0:0\n2\t7\t.\tC\tT\t.\t.\tX\tGT:HDS\t0|1:0,1\t1|1:0.9,0.8\t0|0:0,0\t0|0:0,0\n")
    markers, ds = T.read_vcf(spark, str(tmp_path / "x.vcf"), "DS")
    assert sorted((r.marker_id, r.ref, r.alt, r.info) for r in markers.collect()) == [("1:5:a:g", "A", "G", 0.5), ("2:7:C:T", "C", "T", 1.0)]
    got = {(r.marker_id, r["column"]): r.dosage for r in ds.collect()}
    assert got == {("1:5:a:g", 0): 0.9, ("1:5:a:g", 1): None, ("1:5:a:g", 2): 2.0, ("2:7:C:T", 0): 1.0, ("2:7:C:T", 1): pytest.approx(1.7)}
    _, gt = T.read_vcf(spark, str(tmp_path / "x.vcf"), "GT")
    assert {(r.marker_id, r["column"]): r.dosage for r in gt.collect()}[("2:7:C:T", 1)] == 2.0
    with pytest.raises(ValueError):
        T.read_vcf(spark, "x", "GP")


def test_group_file_errors(spark, tmp_path):
    (tmp_path / "g").write_text("G1 var a b\nG1 anno lof missense\nG1 weight 1 2\nG2 var c\nG2 anno lof\n")
    rows = sorted((r.region, r.snp, r.anno, r.weight) for r in T.read_groups(spark, str(tmp_path / "g")).collect())
    assert rows == [("G1", "a", "lof", 1.0), ("G1", "b", "missense", 2.0), ("G2", "c", "lof", None)]
    (tmp_path / "bad").write_text("G1 var a b\nG1 anno lof\n")
    with pytest.raises(Exception, match="do not match"):
        T.read_groups(spark, str(tmp_path / "bad")).collect()


def test_small_readers(spark, tmp_path):
    (tmp_path / "s.psam").write_text("#FID\tIID\tSEX\nf\ti1\t1\nf\ti2\t2\n")
    assert [r.iid for r in T.read_psam(spark, str(tmp_path / "s.psam")).collect()] == ["i1", "i2"]
    (tmp_path / "s.sample").write_text("ID_1 ID_2 missing sex\n0 0 0 D\na b 0 1\n")
    assert [r.iid for r in T.read_sample_ids(spark, str(tmp_path / "s.sample")).collect()] == ["b"]
    (tmp_path / "vr").write_text("1.5\n")
    assert T.read_variance_ratios(spark, str(tmp_path / "vr")).collect()[0].value == 1.5
    with pytest.raises(ValueError):
        T.read_variance_ratios(spark, str(tmp_path / "vr"), 2)
    assert T.sniff_separator("a\tb\tc") == "\t" and T.sniff_separator("a,b") == ","


def test_checks_raise(spark):
    t = spark.createDataFrame([("a", 1.0, None)], "id string, x double, y double")
    assert qc.complete_cases(t, "id", ["x"]).count() == 1 and qc.complete_cases(t, "id", ["x", "y"]).count() == 0
    with pytest.raises(ValueError):
        qc.complete_cases(t, "id", ["z"])
    with pytest.raises(ValueError):
        joins.required(t, t.limit(0), "id")
    with pytest.raises(ValueError):
        qc.sex_filter(t, True, True)
    with pytest.raises(ValueError):
        joins.ratio_by_mac(t, [1, 2], [1.0])
    p = spark.createDataFrame([("r", 1.5)], "region string, p double")
    with pytest.raises(Exception, match="p-values"):
        aggregates.cauchy(p, ["region"]).collect()
    s = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)], "y double, x double")
    assert qc.separated_covariates(s, "y", ["x"], 1) == ["x"] and qc.separated_covariates(s, "y", ["x"], -1) == []


def test_normal_chromosomes_and_cutoffs(spark):
    t = spark.createDataFrame([("chr01",), ("X",), ("22",), ("CHRx",)], "c string")
    assert [r[0] for r in t.select(qc.normal_chromosome(F.col("c"))).collect()] == ["1", "X", "22", "X"]


def test_running_sum_is_independent_of_partitions(spark):
    t = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    for n in (1, 7):
        got = aggregates.running_sum(t.repartition(n), "id", "v", "s").orderBy("id").collect()
        total = 0
        for r in got:
            total += r.v
            assert r.s == total


def test_model_round_trip(spark, tmp_path):
    from allelia.operators.nullmodel import NullModel

    x = np.ones((3, 1))
    m = NullModel("binary", (1.0, 0.2), np.array([0.1]), np.zeros(3), np.full(3, 0.5), np.zeros(3), np.full(3, 0.25), x, np.array([0, 1, 1.0]), np.zeros(3), True)
    sinks.write_model(m, str(tmp_path / "m"), spark, {2: m})
    back = sinks.read_model(spark, str(tmp_path / "m"), 2, [2, 0])
    assert back.tau == (1.0, 0.2) and back.y.tolist() == [1.0, 0.0]
    with pytest.raises(ValueError):
        sinks.read_model(spark, str(tmp_path / "m"), 2, [5])


def test_ingest_goes_on_where_it_was(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.range(5).write.parquet(src)
    assert ingest_new(spark, src, "id long", out, ck) == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    assert ingest_new(spark, src, "id long", out, ck) == 3
    assert spark.read.parquet(out).count() == 8
    assert ingest_new(spark, src, "id long", out, ck) == 0


def test_matrix_of_one_entry_and_an_entry_like_the_size_line(spark, tmp_path):
    (tmp_path / "ids").write_text("a\nb\nc\n")
    for body, want in (("3 3 1\n2 1 0.5\n", {("a", "b", 0.5), ("b", "a", 0.5)}), ("3 3 2\n1 1 1\n3 3 2\n", {("a", "a", 1.0), ("c", "c", 2.0)})):
        (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% x\n" + body)
        got = T.read_sparse_matrix(spark, str(tmp_path / "m.mtx"), str(tmp_path / "ids"))
        assert {(r.i, r.j, r.value) for r in got.collect()} == want


def test_minor_dosages_of_a_flipped_marker(spark):


    full = np.array([[2, 2, 2, 2, 2, 2, 2, 2, 1, 0], [0, 0, 1, 0, 0, 2, 0, 0, 0, 0]], float)
    calls = spark.createDataFrame([(int(s), int(m), float(full[m, s])) for m in range(2) for s in range(10) if full[m, s]], "sample_id long, marker_id long, dosage double")
    samples = spark.range(10).withColumnRenamed("id", "sample_id")
    counts = qc.allele_counts(calls, spark.createDataFrame([(10,)], "n long"))
    got = {(r.marker_id, r.sample_id): r.dosage for r in qc.minor_dosages(calls, counts, samples).collect()}
    assert got == {(0, 8): 1, (0, 9): 2, (1, 2): 1, (1, 5): 2}
