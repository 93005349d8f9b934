"""Block solvers: the Cox information without a matrix, and all left-out chromosomes in one solve."""

import numpy as np
import pandas as pd
import pytest

from allelia.operators import nullmodel, relationship


def genotypes(rng, n, m):
    g = rng.binomial(2, rng.uniform(0.1, 0.5, m), (n, m)).astype(float)
    return g[:, (g.sum(0) > 0) & (g.sum(0) < 2 * n)]


def standardised(g):
    f = g.mean(0) / 2
    return (g - 2 * f) / np.sqrt(2 * f * (1 - f))


def cox_matrix(time, event, eta):
    n, e = len(time), np.exp(eta)
    m = np.zeros((n, n))
    for t in np.unique(time[event > 0]):
        at = time >= t
        p = np.where(at, e, 0) / e[at].sum()
        m += event[time == t].sum() * (np.diag(p) - np.outer(p, p))
    return m


@pytest.fixture(scope="module")
def survival():
    rng = np.random.default_rng(12)
    n = 90
    g = genotypes(rng, n, 300)
    z = standardised(g)
    k = z @ z.T / z.shape[1]
    x = rng.normal(size=(n, 2))
    b = np.linalg.cholesky(k + 1e-6 * np.eye(n)) @ rng.normal(size=n) * 0.7
    time = np.ceil(10 * rng.exponential(np.exp(-(x @ [0.5, -0.4] + b)))) + 1  # with ties
    return {"n": n, "k": k, "x": x, "time": time, "event": (rng.random(n) < 0.7).astype(float), "eta": rng.normal(size=n) * 0.3}


def test_cox_information_is_that_of_the_definition(survival):
    s = survival
    want, m = cox_matrix(s["time"], s["event"], s["eta"]), nullmodel.CoxInformation(s["time"], s["event"], s["eta"])
    b = np.random.default_rng(1).normal(size=(s["n"], 4))
    assert np.allclose(m @ b, want @ b) and np.allclose(m.diagonal(), np.diag(want)) and np.allclose(m @ np.ones((s["n"], 1)), 0)
    everyone_dies_at_once = nullmodel.CoxInformation(np.ones(5), np.ones(5), np.zeros(5))
    assert np.allclose(everyone_dies_at_once @ np.eye(5), np.eye(5) - 0.2)
    assert np.allclose(nullmodel.CoxInformation(np.arange(5.0), np.zeros(5), np.zeros(5)) @ np.eye(5), 0)  # no event


def test_cox_solve_equals_a_dense_solve(survival):
    s = survival
    m, n = cox_matrix(s["time"], s["event"], s["eta"]), s["n"]
    info = nullmodel.CoxInformation(s["time"], s["event"], s["eta"])
    b = np.random.default_rng(2).normal(size=(n, 3))
    got = nullmodel.cox_solve(lambda v: s["k"] @ v, 0.8, info, info @ b, np.diag(s["k"]), 1e-22, 2000)
    assert np.allclose(got, m @ np.linalg.solve(np.eye(n) + 0.8 * s["k"] @ m, b), atol=1e-7)
    assert np.allclose(nullmodel.cox_solve(None, 0.0, info, info @ b, np.diag(s["k"])), m @ b)


def test_survival_fit_with_the_whole_information_solves_the_penalised_score(survival):
    s = survival
    settings = nullmodel.Settings(max_iter=40, tol=1e-6, tol_pcg=1e-18, max_iter_pcg=2000, information="cox")
    fit = nullmodel.fit(lambda v: s["k"] @ v, np.diag(s["k"]), s["x"], s["event"], list(range(s["n"])), "survival", settings, time=s["time"], tau_start=(1.0, 0.6), fixed_tau=True)
    residual = s["event"] - fit.mu
    assert np.abs(s["x"].T @ residual).max() < 1e-3  # covariates
    assert np.allclose(fit.eta, s["x"] @ fit.alpha + 0.6 * s["k"] @ residual, atol=1e-3)  # random effects
    free = nullmodel.fit(lambda v: s["k"] @ v, np.diag(s["k"]), s["x"], s["event"], list(range(s["n"])), "survival", nullmodel.Settings(information="cox", n_vectors=60), time=s["time"])

    def marginal(tau):  # Laplace's approximation at the fit of each tau, without what doesn't depend on it
        f = nullmodel.fit(lambda v: s["k"] @ v, np.diag(s["k"]), s["x"], s["event"], list(range(s["n"])), "survival", settings, time=s["time"], tau_start=(1.0, tau), fixed_tau=True)
        m = cox_matrix(s["time"], s["event"], f.eta)
        r = s["event"] - f.mu
        at = np.array([np.log(np.exp(f.eta)[s["time"] >= t].sum()) for t in s["time"]])
        partial = s["event"] @ (f.eta - at)
        sigma = m @ np.linalg.inv(np.eye(s["n"]) + tau * s["k"] @ m)
        return partial - 0.5 * tau * r @ s["k"] @ r - 0.5 * np.linalg.slogdet(np.eye(s["n"]) + tau * s["k"] @ m)[1] - 0.5 * np.linalg.slogdet(s["x"].T @ sigma @ s["x"])[1]

    grid = np.array([0.01, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.2, 3.0])
    best = max(map(marginal, grid))
    assert free.tau[1] >= 0 and marginal(max(free.tau[1], 0.01)) > best - 0.6


@pytest.mark.parametrize("trait", ["quantitative", "binary", "survival"])
def test_all_left_out_chromosomes_in_one_solve(trait, monkeypatch):
    rng = np.random.default_rng(3)
    n = 80
    g = genotypes(rng, n, 240)
    chrom = np.arange(g.shape[1]) % 4
    i, j = np.nonzero(g.T)
    f = g.mean(0) / 2
    op = relationship.LocalOperator(i, j, g.T[i, j], f, 1 / (2 * f * (1 - f)), n, chrom)
    z = standardised(g)
    rest = {c: z[:, chrom != c] @ z[:, chrom != c].T / (chrom != c).sum() for c in range(4)}
    b = rng.normal(size=(n, 5))
    left = np.array([2, 0, 3, 3, 1])
    assert np.allclose(op(b, left), np.column_stack([rest[c] @ b[:, k] for k, c in enumerate(left)]))
    assert np.allclose(op(b), z @ z.T / z.shape[1] @ b)
    diagonals = op.diagonals()
    assert all(np.allclose(diagonals[c], np.diag(rest[c])) for c in range(4))
    x = np.column_stack([np.ones(n), rng.normal(size=n)])[:, trait == "survival" :]
    y = rng.normal(size=n) + z[:, 0] if trait == "quantitative" else (rng.random(n) < 0.5).astype(float)
    time = rng.integers(1, 20, n).astype(float) if trait == "survival" else None
    settings = nullmodel.Settings(tol=1e-7, tol_pcg=1e-20, max_iter=60)
    model = nullmodel.fit(op, np.diag(z @ z.T / z.shape[1]), x, y, list(range(n)), trait, settings, time=time, tau_start=(1.0, 0.3), fixed_tau=True)
    calls = []

    def counted(block, left_out=None):
        calls.append(block.shape[1])
        return op(block, left_out)

    got = nullmodel.leave_one_chromosome(counted, diagonals, model, settings, time)
    apart = {c: nullmodel.fit(lambda v, c=c: rest[c] @ v, np.diag(rest[c]), x, y, list(range(n)), trait, settings, np.zeros(n), time, model.tau, fixed_tau=True) for c in range(4)}
    for c in range(4):
        assert np.allclose(got[c].alpha, apart[c].alpha, atol=1e-5) and np.allclose(got[c].mu, apart[c].mu, atol=1e-5)
    assert max(calls) == 4 * (x.shape[1] + 1)  # one product serves all chromosomes
    monkeypatch.setattr(nullmodel, "BLOCK_CELLS", n * (x.shape[1] + 1))
    turns = nullmodel.leave_one_chromosome(op, diagonals, model, settings, time)
    assert all(np.allclose(turns[c].eta, got[c].eta, atol=1e-5) for c in range(4))


def test_distributed_products_leave_chromosomes_out(spark):
    rng = np.random.default_rng(5)
    n = 40
    g = genotypes(rng, n, 90)
    i, j = np.nonzero(g)
    long = spark.createDataFrame(pd.DataFrame({"sample_id": i, "marker_id": j, "dosage": g[i, j]})).repartition(5)
    w = relationship.marker_weights(long, n).selectExpr("*", "cast(marker_id % 3 as int) as chrom")
    idx = spark.createDataFrame([(k, k) for k in range(n)], "sample_id long, sample_idx int")
    local, far = (relationship.kinship_operator(long, idx, n, w, cells) for cells in (10**9, 0))
    b = rng.normal(size=(n, 4))
    left = np.array([0, 1, 2, 1])
    assert isinstance(far, relationship.DenseOperator) and np.allclose(far(b, left), local(b, left)) and np.allclose(far(b), local(b))
    a, c = far.diagonals(), local.diagonals()
    assert a.keys() == c.keys() == {0, 1, 2} and all(np.allclose(a[k], c[k]) for k in a)


def test_local_products_hold_five_bytes_a_cell_and_take_bounded_pieces(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(6)
    n, m, per = 500, 3000, 100
    marker = np.repeat(np.arange(m), per)
    sample = np.concatenate([rng.choice(n, per, replace=False) for _ in range(m)])
    dosage = rng.integers(1, 3, m * per).astype(float)
    f = np.bincount(marker, dosage, m) / (2 * n)
    w, chrom = 1 / (2 * f * (1 - f)), np.arange(m) % 3
    monkeypatch.setattr(relationship.LocalOperator, "CELLS", 1 << 12, raising=False)
    op = relationship.LocalOperator(marker, sample, dosage, f, w, n, chrom)
    assert sum(x.nbytes for x in vars(op).values() if isinstance(x, np.ndarray) and len(x) == m * per) <= 5 * m * per
    g = np.zeros((n, m))
    g[sample, marker] = dosage
    z, b, left = standardised(g), rng.normal(size=(n, 3)), np.array([0, 2, 1])
    tracemalloc.start()
    got = op(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, z @ z.T / m @ b) and peak < 8 * m * per / 4  # not a number a cell
    assert np.allclose(op(b, left), np.column_stack([z[:, chrom != c] @ z[:, chrom != c].T / (chrom != c).sum() @ b[:, k] for k, c in enumerate(left)]))
    mixed = rng.permutation(m * per)  # any order of cells, and dosages that are not whole
    apart = relationship.LocalOperator(marker[mixed], sample[mixed], dosage[mixed] * 0.9, f * 0.9, w, n, chrom)
    whole = relationship.LocalOperator(marker, sample, dosage * 0.9, f * 0.9, w, n, chrom)
    assert np.allclose(apart(b), whole(b)) and np.allclose(apart.diagonals()[1], whole.diagonals()[1])


def test_carriers_reach_the_driver_as_bytes_in_any_partitioning(spark):
    rng = np.random.default_rng(8)
    n = 30
    g = genotypes(rng, n, 70) * 0.5  # not whole
    g[:, ::2] *= 2  # whole
    i, j = np.nonzero(g)
    long = spark.createDataFrame(pd.DataFrame({"sample_id": i, "marker_id": j, "dosage": g[i, j]}))
    idx = spark.createDataFrame([(k, k) for k in range(n)], "sample_id long, sample_idx int")
    w = relationship.marker_weights(long, n)
    one, many = (relationship.kinship_operator(long.repartition(k), idx, n, w) for k in (1, 7))
    z, b = standardised(g), rng.normal(size=(n, 2))
    assert np.allclose(one(b), z @ z.T / z.shape[1] @ b) and (one(b) == many(b)).all()
    nothing = relationship.kinship_operator(long.where("dosage > 9"), idx, n, w.where("f > 9"))
    assert (nothing(b) == 0).all()


def test_fits_by_columns_on_executors_equal_those_on_the_driver(spark, monkeypatch):
    """Solutions, traces and variance ratios come from tasks that hold the cells, in memory or in a file; several tasks at once."""
    rng = np.random.default_rng(9)
    n = 60
    g = genotypes(rng, n, 90)
    i, j = np.nonzero(g)
    long = spark.createDataFrame(pd.DataFrame({"sample_id": i, "marker_id": j, "dosage": g[i, j]})).repartition(5)
    placed = long.withColumn("sample_idx", long.sample_id)
    near, far = (relationship.operator_of(relationship.packed_placed(placed, n), n, cells) for cells in (10**9, 0))
    w = relationship.marker_weights(long, n)
    idx = spark.createDataFrame([(k, k) for k in range(n)], "sample_id long, sample_idx int")
    b = rng.normal(size=(n, 5))
    assert np.allclose(near(b), relationship.kinship_operator(long, idx, n, w, 10**9)(b)) and np.allclose(far(b), near(b))
    d = near.diagonal()
    assert np.allclose(d, np.diag(near(np.eye(n)))) and np.allclose(far.diagonal(), d)
    assert np.allclose(nullmodel.conjugate_gradients(far, (0.6, 0.9), d + 1, b, d, 1e-16), nullmodel.conjugate_gradients(near, (0.6, 0.9), d + 1, b, d, 1e-16))
    tasks = far.mapped(lambda op, payload, shared: __import__("pyspark").TaskContext.get().partitionId(), [None] * 4)
    assert len(set(tasks)) == 4  # side by side
    x, y = np.column_stack([np.ones(n), rng.normal(size=n)]), rng.normal(size=n)
    settings = nullmodel.Settings(tol_pcg=1e-16)
    for trait, outcome in (("quantitative", y), ("binary", (y > 0).astype(float))):
        a, c = (nullmodel.fit(op, d, x, outcome, list(range(n)), trait, settings) for op in (near, far))
        assert np.allclose(a.tau, c.tau, rtol=1e-6, atol=1e-9) and np.allclose(a.eta, c.eta, atol=1e-6) and a.converged == c.converged
        r, t = (nullmodel.variance_ratio(op, d, a, g[:, :3].astype(np.float32), settings) for op in (near, far))
        assert np.allclose(r, t)
    jobs, mapped = [], type(far).mapped
    monkeypatch.setattr(type(far), "mapped", lambda self, f, *more: jobs.append(f.__name__) or mapped(self, f, *more))
    spectra = nullmodel.Spectra(far, list(range(n)), n, settings)
    k = near(np.eye(n))
    for tau in ((1.0, 0.0), (0.9, 0.8), (1.0, 0.01)):  # one scan of the markers serves shifts that need no more steps
        for run, (t, t0, plus) in enumerate(spectra.sums(tau, [0, 1])):
            u = nullmodel.random_signs(list(range(n)), run, settings.seed)
            inverse = np.linalg.inv(tau[1] * k + tau[0] * np.eye(n))
            assert (plus * 2.0 - 1 == u).all() and t == pytest.approx(u @ k @ inverse @ u, rel=1e-6) and t0 == pytest.approx(u @ inverse @ u, rel=1e-6)
    assert jobs == ["_column_spectrum"] * len(jobs) and len(jobs) <= 2
    rows = [r.asDict() for r in far.rows.collect()]

    class Batch:
        to_pylist = staticmethod(lambda: rows)

    monkeypatch.setattr(relationship._ReadCells, "HELD", 50)
    spilled = relationship._ReadCells([Batch], n)
    assert spilled.file is not None and np.allclose(spilled(b), near(b))
