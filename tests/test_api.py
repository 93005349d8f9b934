"""Entry points end to end on simulated files and relations."""

import numpy as np
import pandas as pd
import pytest

from allelia.operators import nullmodel, relationship
from allelia.plans import api
from allelia.sources import genotypes as GS


@pytest.fixture(scope="module")
def simulated(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    n, m = 100, 150
    g = rng.binomial(2, rng.uniform(0.05, 0.5, m), (n, m)).astype(np.int8)
    y = g[:, 7] * 1.2 + rng.normal(size=n)
    g[rng.uniform(size=g.shape) < 0.02] = -1
    d = tmp_path_factory.mktemp("bed")
    (d / "a.bed").write_bytes(GS.packed_bed(g.T.copy()))
    (d / "a.fam").write_text("".join(f"f s{i} 0 0 1 -9\n" for i in range(n)))
    (d / "a.bim").write_text("".join(f"{1 + k % 3} m{k} 0 {k + 1} a c\n" for k in range(m)))
    source = api.GenotypeSource(bed=str(d / "a.bed"), bim=str(d / "a.bim"), fam=str(d / "a.fam"))
    samples, markers, calls = source.load(spark)
    pheno = spark.createDataFrame(pd.DataFrame({"sample_id": range(n), "y": y, "x1": rng.normal(size=n)}))
    return samples, markers, calls, pheno, g, y


def test_bed_to_associations(spark, simulated):
    samples, markers, calls, pheno, g, y = simulated
    assert samples.count() == 100 and markers.where("alt = 'A' and ref = 'C'").count() == 150
    s = api.NullSettings(covariates=("x1",), loco=True, ratio_min_mac=10, solver=nullmodel.Settings(n_vectors=10, cv_cutoff=9, max_iter=5))
    fit = api.fit_null(pheno, calls, markers, s)
    assert len(fit.loco) == 3 and len(fit.ratios) == 1 and len(fit.model.alpha) == 2
    out = {r.marker_id: r for r in api.assoc_single(fit, calls, markers).collect()}
    assert min(out, key=lambda k: out[k].p) == 7 and out[7].beta > 0.5
    given = {r.marker_id: r for r in api.assoc_single(fit, calls, markers, condition=[7]).collect()}
    assert given[7].p > 0.9 and len(given) == len(out)
    groups = markers.selectExpr("concat('g', cast(marker_id % 5 as string)) as region", "marker_id", "'lof' as anno")
    rows = api.assoc_region(fit, calls, groups, ["lof"], [0.5], 5.0).collect()
    assert len(rows) == 10 and {r["mask"] for r in rows} == {"lof", "Cauchy"}
    effect, h2 = api.gene_effects(fit, calls, groups)
    seen = (g >= 0).sum(axis=0)
    ac = np.where(g >= 0, g, 0).sum(axis=0)
    kept = int((np.minimum(ac, 2 * seen - ac) > 10).sum())
    assert h2.where("h2 between 0 and 1").count() == 5 and effect.where("marker_id >= 0").count() == kept
    assert 0 < effect.where("marker_id = -1").count() <= 5
    assert api.ld(calls, groups).where("value < 0").count() == 0


def test_sources_and_settings_are_checked():
    with pytest.raises(ValueError):
        api.GenotypeSource()
    with pytest.raises(ValueError):
        api.GenotypeSource(bed="x")
    with pytest.raises(ValueError):
        api.GenotypeSource(pgen="x")
    with pytest.raises(ValueError):
        api.NullSettings(trait="other")
    with pytest.raises(ValueError):
        api.NullSettings(min_maf=0.7)


def test_every_kind_of_source_gives_the_same_calls(spark, tmp_path):
    from allelia.sources import pgen

    rng = np.random.default_rng(8)
    g = rng.choice([0, 1, 2, -1], (30, 11), p=[0.6, 0.25, 0.1, 0.05]).astype(np.int8)
    want = {(s, m, None if g[m, s] < 0 else float(g[m, s])) for m, s in zip(*np.nonzero(g))}
    (tmp_path / "a.bed").write_bytes(GS.packed_bed(g))
    (tmp_path / "a.fam").write_text("".join(f"f s{i} 0 0 1 -9\n" for i in range(11)))
    (tmp_path / "a.bim").write_text("".join(f"1 m{k} 0 {k + 1} a c\n" for k in range(30)))
    (tmp_path / "a.pgen").write_bytes(pgen.file_of(np.where(g < 0, 3, g).astype(np.uint8)))
    (tmp_path / "a.psam").write_text("#IID\tSEX\n" + "".join(f"s{i}\t1\n" for i in range(11)))
    (tmp_path / "a.pvar").write_text("##x\n#CHROM\tID\tPOS\tALT\tREF\n" + "".join(f"1\tm{k}\t{k + 1}\ta\tc\n" for k in range(30)))
    p = np.stack([np.where(g == 0, 255, 0), np.where(g == 1, 255, 0)], axis=2)
    (tmp_path / "a.bgen").write_bytes(GS.write_bgen([(f"m{k}", f"m{k}", "1", k + 1, "c", "a", p[k], g[k] < 0) for k in range(30)], [f"s{i}" for i in range(11)]))
    at = lambda x: str(tmp_path / f"a.{x}")
    bed = api.GenotypeSource(bed=at("bed"), bim=at("bim"), fam=at("fam"))
    pg = api.GenotypeSource(pgen=at("pgen"), pvar=at("pvar"), psam=at("psam"))
    bgen = api.GenotypeSource(bgen=at("bgen"), bed=at("bed"))
    assert (bed.kind, pg.kind, bgen.kind) == ("bed", "pgen", "bgen")
    for source in (bed, pg, bgen):
        samples, markers, calls = source.load(spark)
        assert {tuple(r) for r in calls.select("sample_id", "marker_id", "dosage").collect()} == want
        assert [r.iid for r in samples.orderBy("sample_idx").collect()] == [f"s{i}" for i in range(11)]
        rows = markers.orderBy("marker_id").collect()
        assert [(r.id, r.pos, r.ref.upper(), r.alt.upper()) for r in rows] == [(f"m{k}", k + 1, "C", "A") for k in range(30)]


def test_family_solver_matches_a_dense_solve():
    rng = np.random.default_rng(2)
    n = 40
    k = np.eye(n)
    for a in range(0, 30, 3):
        k[a, a + 1] = k[a + 1, a] = 0.25
        k[a + 1, a + 2] = k[a + 2, a + 1] = 0.2
    i, j = np.nonzero(k)
    op = relationship.SparseOperator(i, j, k[i, j], n)
    w, b = rng.uniform(0.5, 2, n), rng.normal(size=(n, 3))
    want = np.linalg.solve(0.7 * k + np.diag(0.4 / w), b)
    assert np.allclose(relationship.FamilySolver(op)((0.4, 0.7), w, b), want)
    assert np.allclose(op(b), k @ b) and np.allclose(op.diagonal(), 1)
    assert np.allclose(nullmodel.conjugate_gradients(op, (0.4, 0.7), w, b, op.diagonal(), 1e-22, 500), want, atol=1e-8)


def test_local_and_distributed_products_agree(spark, simulated):
    _, _, calls, _, _, _ = simulated
    g = calls.where("dosage > 0")
    w = relationship.marker_weights(g, 100)
    idx = spark.createDataFrame([(i, i) for i in range(100)], "sample_id long, sample_idx int")
    b = np.random.default_rng(3).normal(size=(100, 2))
    assert np.allclose(relationship.kinship_operator(g, idx, 100, w)(b), relationship.kinship_operator(g, idx, 100, w, 0)(b), atol=1e-9)
