"""Numeric kernels and models against plain numpy on small inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia import views as V
from allelia.functions.special import chi2_1_sf, chi2_sf, liu, mixture_sf
from allelia.operators import association as A
from allelia.operators import logistic as B
from allelia.operators import mixed as M
from allelia.operators import setbased as T


@pytest.fixture(scope="module")
def cohort(spark, sf_dir):
    """(dense matrix n x m with nan for missing, samples as pandas, calls and samples as DataFrames)."""
    samples = V.samples(spark, sf_dir).withColumn("case", F.col("trait") - 1)
    people = samples.orderBy("sample_id").toPandas()
    calls = V.calls(spark, sf_dir)
    m = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    g = np.zeros((len(people), m))
    for r in calls.collect():
        g[r.sample_id, r.variant_id] = np.nan if r.g is None else r.g
    full = np.where(np.isnan(g), np.nanmean(g, axis=0), g)
    return full, people, calls, samples


def test_chi_squares():
    assert chi2_1_sf(3.841458820694124) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(30, 3) == pytest.approx(1.380057e-06, rel=1e-5)
    assert chi2_sf(50, 3) == pytest.approx(7.989179e-11, rel=1e-5)
    assert liu(30, np.ones(3)) == pytest.approx(1.380057e-06, rel=1e-4)
    assert mixture_sf(5.0, np.ones(3)) == pytest.approx(chi2_sf(5, 3), abs=1e-5)
    lam = np.array([3.0, 1.0, 0.5, 0.1])
    x = np.random.default_rng(1).chisquare(1, (400_000, 4)) @ lam
    for q in (2.0, 6.0, 14.0):
        assert mixture_sf(q, lam) == pytest.approx((x > q).mean(), abs=3e-3)


def test_score_with_covariates(cohort):
    g, people, calls, samples = cohort
    y = people["y"].to_numpy(float)
    z = np.column_stack([np.ones(len(y)), people["c1"], people["c2"]])
    r = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    s2 = r @ r / len(y)
    found = {x.variant_id: x for x in A.score_with_covariates(calls, samples, ["c1", "c2"]).collect()}
    for v in range(0, g.shape[1], 17):
        x = g[:, v]
        ss = x @ x - x @ z @ np.linalg.solve(z.T @ z, z.T @ x)
        assert found[v].stat == pytest.approx((x @ r) ** 2 / (s2 * ss), abs=1e-3)
        assert found[v].effect == pytest.approx((x @ r) / ss, abs=1e-2)


def test_logistic(cohort):
    g, people, calls, samples = cohort
    y = people["case"].to_numpy(float)
    z = np.column_stack([np.ones(len(y)), people["c2"]])
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve(z.T @ ((p * (1 - p))[:, None] * z), z.T @ (y - p))
    w = p * (1 - p)
    found = {x.variant_id: x for x in B.logistic_score(calls, samples, "case", ["c2"]).collect()}
    for v in range(0, g.shape[1], 23):
        x = g[:, v]
        u = x @ (y - p)
        wz = z.T @ (w * x)
        var = (w * x) @ x - wz @ np.linalg.solve(z.T @ (w[:, None] * z), wz)
        assert found[v].u_stat == pytest.approx(u, abs=1e-3)
        assert found[v].v_stat == pytest.approx(var, abs=1e-3)


@pytest.mark.parametrize("firth", [False, True])
def test_cell_regression(cohort, spark, sf_dir, firth):
    _, people, _, samples = cohort
    calls = V.calls(spark, sf_dir, complete=True)
    rows = {r.variant_id: r for r in B.regress(calls, samples, "case", ["sex"], firth=firth).collect()}
    g = np.zeros((len(people), max(rows) + 1))
    for r in calls.collect():
        g[r.sample_id, r.variant_id] = r.g
    y = people["case"].to_numpy(float)
    for v in list(rows)[::29]:
        if rows[v].beta is None:
            continue
        x = np.column_stack([np.ones(len(y)), g[:, v], people["sex"]])
        b = np.zeros(3)
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ b))
            h = np.linalg.inv(x.T @ ((p * (1 - p))[:, None] * x))
            lev = p * (1 - p) * np.einsum("ij,jk,ik->i", x, h, x)
            b = b + 0.5 * h @ x.T @ (y - p + (lev * (0.5 - p) if firth else 0))
        assert rows[v].beta == pytest.approx(b[1], abs=1e-4)
        assert rows[v].se == pytest.approx(math.sqrt(h[1, 1]), abs=1e-4)


def test_kernel_tests(spark, sf_dir, cohort):
    _, people, _, samples = cohort
    calls = V.calls(spark, sf_dir, complete=True)
    members = V.variants(spark, sf_dir).where("variant_id < 60").select((F.col("variant_id") % 6).cast("string").alias("group"), "variant_id")
    found = {r.group: r for r in T.kernel_tests(calls, samples, members).collect()}
    g = np.zeros((len(people), 60))
    for r in calls.where("variant_id < 60").collect():
        g[r.sample_id, r.variant_id] = r.g
    y = people["y"].to_numpy(float)
    r0 = y - y.mean()
    s2 = r0 @ r0 / len(y)
    rng = np.random.default_rng(3)
    for k in range(2):
        x = g[:, k::6]
        x = x[:, x.sum(0) > 0]
        w = 25 * (1 - x.sum(0) / 2 / len(y)) ** 24
        q = ((w * (x.T @ r0)) ** 2).sum()
        xc = (x - x.mean(0)) * w
        sims = ((rng.standard_normal((40_000, len(y))) @ xc * math.sqrt(s2)) ** 2).sum(1)
        assert found[str(k)].num_var == x.shape[1]
        assert found[str(k)].skat_log_q == pytest.approx(math.log(q), abs=1e-5)
        assert found[str(k)].skat_p == pytest.approx((sims > q).mean(), abs=0.01)
        assert 0 < found[str(k)].skato_p <= 1
        assert 0 < found[str(k)].vt_p <= 1


def test_skato_is_calibrated():
    rng = np.random.default_rng(5)
    x = rng.binomial(2, 0.2, (400, 6)).astype(float)
    s, xc = x.sum(0), x - x.mean(0)
    ps = []
    for _ in range(150):
        y = rng.standard_normal(400)
        y -= y.mean()
        ps.append(T._skato(s, xc.T @ y, xc.T @ xc, float(y @ y) / 400, 400.0)[2])
    assert 0.35 < np.mean(np.array(ps) < 0.5) < 0.65
    assert np.mean(np.array(ps) < 0.1) < 0.2


def test_permutations(spark, sf_dir, cohort):
    _, people, _, samples = cohort
    calls = V.calls(spark, sf_dir, complete=True).where("variant_id < 40")
    members = V.variants(spark, sf_dir).where("variant_id < 40").select(F.lit("all").alias("group"), "variant_id")
    y = people["case"].to_numpy(float)
    who = np.unique([r.sample_id for r in calls.collect()])
    seen = abs(y[who].sum() - len(who) * y.mean())
    a = T.permutation_test(calls, samples, members, "cmc", "case", 400, alpha=1.0).first()
    assert a.stat == pytest.approx(seen, abs=1e-6)
    rng = np.random.default_rng(9)
    draws = np.array([abs(rng.permutation(y)[who].sum() - len(who) * y.mean()) for _ in range(4000)])
    p = (draws > seen + 1e-9).mean() + 0.5 * (np.abs(draws - seen) <= 1e-9).mean()
    assert a.perm_pvalue == pytest.approx(p, abs=0.08)
    b = T.permutation_test(calls, samples, members, "cmc", "case", 400, alpha=1.0).first()
    assert a == b
    for name in T.STATISTICS:
        assert T.permutation_test(calls, samples, members, name, "case", 40).first().actual_perm > 0


def test_mixed_models(spark, sf_dir, cohort):
    _, people, _, samples = cohort
    calls = V.calls(spark, sf_dir, complete=True)
    y, n = people["y"].to_numpy(float), len(people)
    k = np.where(people["fid"].to_numpy()[:, None] == people["fid"].to_numpy()[None, :], 0.5, 0.0)
    np.fill_diagonal(k, 1.0)
    null = M.DenseNull(k, y)
    delta, sigma2, mean = M.family_null(samples, "y")
    # a flat likelihood leaves delta loose; the variance of the noise and the fit agree
    assert sigma2 * (1 + delta) == pytest.approx(null.sigma2 * (1 + null.delta), rel=1e-3)
    fam = {r.variant_id: r for r in M.family_score(calls, samples, "y").collect()}
    dense = {r.variant_id: r for r in M.dense_tests(calls, null, np.arange(n)).collect()}
    for v in list(fam)[::31]:
        assert fam[v].stat == pytest.approx(dense[v].u_stat ** 2 / dense[v].v_stat, abs=5e-3)
        assert 0 <= dense[v].lrt_p <= 1 and 0 <= dense[v].gamma_p <= 1
    g = np.zeros((n, 200))
    for r in calls.collect():
        g[r.sample_id, r.variant_id] = r.g
    mu = g.mean(0)
    ok = mu > 0
    z = (g[:, ok] - mu[ok]) / np.sqrt(mu[ok] * (1 - mu[ok] / 2))
    want = np.linalg.solve(z @ z.T / 200 + np.eye(n), y - y.mean())
    got = np.array([r.x for r in M.infinitesimal_solve(calls, samples, "y", 200, 1.0).orderBy("sample_id").collect()])
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()


def test_small_p_values_and_real_traits(spark):
    """p far below the smallest rounded value, and sums of traits and dosages that aren't integers."""
    rng = np.random.default_rng(21)
    n = 4000
    g = rng.choice([0.0, 0.4, 1.0, 1.7], n, p=[0.7, 0.1, 0.1, 0.1])
    y = 2 * g + rng.normal(size=n) / 3
    samples = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "sample_id long, y double")
    calls = spark.createDataFrame([(1, i, float(g[i])) for i in range(n) if g[i]], "variant_id long, sample_id long, g double")
    sums = A.group_sums(calls, samples)
    first = sums.first()
    assert first.ac == pytest.approx(g.sum()) and first.sq == pytest.approx((g * g).sum()) and first.gy == pytest.approx((g * y).sum())
    row = A.score(sums, *A.trait_sums(samples)).first()
    c = g - g.mean()
    want = (c @ y) ** 2 / (y.var() * (c @ c))
    assert row.stat == pytest.approx(want) and row.effect == pytest.approx(c @ y / (c @ c))
    # log10 of erfc by its asymptotic series
    x = math.sqrt(want / 2)
    tail = (-x * x - math.log(x * math.sqrt(math.pi)) + math.log1p(-1 / (2 * x * x) + 3 / (4 * x**4))) / math.log(10)
    assert want > 1500 and row.log10p < -300 and row.log10p == pytest.approx(tail, abs=1e-4)
    assert samples.select(F.sum("y")).first()[0] == pytest.approx(A.trait_sums(samples)[1])


def test_adjusted_and_family_kernels(spark):
    """Scores and matrices of a group with covariates, and under the family model, against dense algebra."""
    rng = np.random.default_rng(31)
    n, m = 120, 6
    g = rng.binomial(2, 0.08, (n, m)).astype(float)
    c1, fam = rng.normal(size=n), rng.integers(0, 30, n)
    y = rng.normal(size=n) + 0.5 * c1 + 0.4 * g[:, 0]
    samples = spark.createDataFrame([(i, float(y[i]), float(c1[i]), f"f{fam[i]}") for i in range(n)], "sample_id long, y double, c1 double, fid string")
    calls = spark.createDataFrame([(j, i, int(g[i, j])) for i in range(n) for j in range(m) if g[i, j]], "variant_id long, sample_id long, g int")
    members = spark.createDataFrame([("x", j) for j in range(m)], "group string, variant_id long")
    w = 25 * (1 - np.minimum(g.mean(0) / 2, 1 - g.mean(0) / 2)) ** 24
    z = np.column_stack([np.ones(n), c1])
    proj = np.eye(n) - z @ np.linalg.inv(z.T @ z) @ z.T
    r = proj @ y
    row = T.kernel_tests(calls, samples, members, ["c1"]).first()
    u, k = w * (g.T @ r), (r @ r / n) * w[:, None] * (g.T @ proj @ g) * w
    assert row.skat_log_q == pytest.approx(math.log((u @ u)))
    assert row.skat_p == pytest.approx(mixture_sf(float(u @ u), np.linalg.eigvalsh(k)), abs=1e-6)
    delta = 0.7
    v = np.where(fam[:, None] == fam[None, :], 0.5, 0.0) + np.eye(n) * (0.5 + delta)
    inv, one = np.linalg.inv(v), np.ones(n)
    p = inv - np.outer(inv @ one, inv @ one) / (one @ inv @ one)
    s2 = float(y @ p @ y) / n
    row = T.family_kernel_tests(calls, samples, members, delta=delta).first()
    u, k = w * (g.T @ p @ y) / s2, w[:, None] * (g.T @ p @ g) * w / s2
    assert row.skat_log_q == pytest.approx(math.log((u @ u)))
    assert row.skat_p == pytest.approx(mixture_sf(float(u @ u), np.linalg.eigvalsh(k)), abs=1e-6)
    own = {x.variant_id: x for x in M.family_score(calls, samples, "y", delta=delta).collect()}
    for j in range(m):
        a = float((g[:, j] @ p @ y) ** 2 / s2 / (g[:, j] @ p @ g[:, j]))
        assert own[j].stat == pytest.approx(a) and own[j].lrt == pytest.approx(-n * math.log(1 - a / n))
        assert own[j].af_blue == pytest.approx(float(g[:, j] @ inv @ one / (one @ inv @ one) / 2))


def test_six_sigma_rule(spark):
    """Groups that are sure to miss alpha stop at a check; the others take all replicates; p comes from the replicates drawn."""
    rng = np.random.default_rng(41)
    n = 200
    y = (rng.random(n) < 0.5).astype(int)
    g = {0: y * (rng.random(n) < 0.5), 1: rng.random(n) < 0.2}
    samples = spark.createDataFrame([(i, int(y[i])) for i in range(n)], "sample_id long, case int")
    calls = spark.createDataFrame([(v, i, 1) for v in g for i in range(n) if g[v][i]], "variant_id long, sample_id long, g int")
    members = spark.createDataFrame([("strong", 0), ("null", 1)], "group string, variant_id long")
    got = {r.group: r for r in T.permutation_test(calls, samples, members, "kbac", "case", n_perm=3000, check_every=500).collect()}
    assert got["strong"].actual_perm == 3000 and got["strong"].perm_pvalue < 0.01
    for r in got.values():
        p = (r.n_greater + r.n_equal + 1) / (r.actual_perm + 1)
        assert r.perm_pvalue == pytest.approx(p) and r.actual_perm % 500 == 0
        assert (p - 6 * math.sqrt(p * (1 - p) / r.actual_perm) > 0.05) or r.actual_perm == 3000


def _band(t: float, r: float) -> float:
    """P(max of two |Z| with correlation r >= t) by quadrature over the first one, without cancellation."""
    x, w = np.polynomial.legendre.leggauss(400)
    q = lambda v: math.erfc(v / math.sqrt(2)) / 2
    s = math.sqrt(1 - r * r)
    z = t * x  # the first within the band, the second beyond it
    inner = np.array([(q((t - r * a) / s) + q((t + r * a) / s)) * math.exp(-a * a / 2) / math.sqrt(2 * math.pi) for a in z])
    return 2 * q(t) + float(t * (w * inner).sum())


@pytest.mark.parametrize("t", [0.3, 1.0, 2.5, 4.0, 5.5, 7.2, 12.0])
def test_normal_maximum(t):
    """Tails down to 1e-30 against quadrature for two components and the closed form for independent and equal ones."""
    for r in (-0.9, 0.0, 0.3, 0.8, 0.99):
        p, error = T.max_tail(t, np.array([[1.0, r], [r, 1.0]]))
        assert p == pytest.approx(_band(t, r), rel=0.01) and error < 0.003
    one = math.erfc(t / math.sqrt(2))
    p, _ = T.max_tail(t, np.eye(20))
    assert p == pytest.approx(-math.expm1(20 * math.log1p(-one)), rel=0.01)
    p, _ = T.max_tail(t, np.ones((15, 15)))  # equal components: a singular matrix
    assert p == pytest.approx(one, rel=0.01)
    lag = 0.9 ** np.abs(np.subtract.outer(np.arange(12), np.arange(12)))
    p, _ = T.max_tail(t, lag)
    assert one < p < 12 * one
    if t <= 2.5:
        x = np.random.default_rng(2).standard_normal((400_000, 12)) @ np.linalg.cholesky(lag).T
        assert p == pytest.approx((np.abs(x).max(1) >= t).mean(), rel=0.02)


def test_greedy_unions_by_classes(monkeypatch):
    """Rarecover by classes, with variants of over FEW carriers and a bound that ends rows early, against the greedy union itself; mb against its formula."""

    def plain(y, sets, n):
        best, union = -1.0, set()
        while True:
            found = []
            for s in sets:
                new = union | s
                size, total = len(new), y[sorted(new)].sum()
                found.append((total - size * y.mean()) / math.sqrt(size * (1 - size / n) * y.var() * n) if size < n else -1.0)
            if max(found) <= best + 1e-12:
                return best
            best, union = max(found), union | sets[int(np.argmax(found))]

    rng = np.random.default_rng(71)
    n, m = 150, 18
    g = np.where(rng.random((m, n)) < rng.choice([0.02, 0.1, 0.3], (m, 1)), rng.integers(1, 3, (m, n)), 0)
    g[:, :2] = 0
    g[np.arange(m), 2 + np.arange(m)] = 1
    var, who = np.nonzero(g)
    y = np.stack([rng.permutation(np.arange(n) < 45) for _ in range(40)]).astype(np.uint8)
    sets = [set(np.flatnonzero(r).tolist()) for r in g]
    want = np.array([plain(r.astype(float), sets, n) for r in y])
    for few in (127, 8, 0):
        monkeypatch.setattr(T, "FEW", few)
        stat = T.STATISTICS["rarecover"](var, who, g[var, who].astype(float), m, n)
        assert stat(y) == pytest.approx(want) and stat(y.astype(float)) == pytest.approx(want)
        for limit in (want.min() * 0.9, np.median(want), want.max() * 1.3):
            assert ((stat(y, limit + 1e-9) > limit + 1e-9) == (want > limit + 1e-9)).all()
    control = y == 0
    q = (control @ g.T + 1) / (2 * (n - 45) + 2)
    score = (1 / np.sqrt(n * q * (1 - q))) @ g
    p = y[0].mean()
    v = p * (1 - p) * ((score**2).sum(1) - score.sum(1) ** 2 / n)
    mb = T.STATISTICS["mb"](var, who, g[var, who].astype(float), m, n)
    assert mb(y) == pytest.approx((score * (y - p)).sum(1) ** 2 / v) == mb(y.astype(float))


def test_kernels_take_the_samples_calls(spark):
    """Calls of samples that aren't listed change nothing, a group without pairs has its row, and a carrier of one variant makes no row of pairs."""
    rng = np.random.default_rng(72)
    n, m = 80, 9
    g = np.where(rng.random((n, m)) < 0.12, rng.integers(1, 3, (n, m)), 0)
    g[:, m - 1] = 0
    g[3, m - 1] = 2
    calls = [(v, i, int(g[i, v])) for i in range(n) for v in range(m) if g[i, v]]
    samples = spark.createDataFrame([(i, float(rng.normal()), float(i % 3), i % 7) for i in range(n)], "sample_id long, y double, c1 double, fid long")
    members = spark.createDataFrame([("some" if v < m - 1 else "one", v) for v in range(m)], "group string, variant_id long")
    given = lambda rows: spark.createDataFrame(rows, "variant_id long, sample_id long, g int")
    more = calls + [(v, n + 1, 2) for v in range(m)]
    for test in (lambda c: T.kernel_tests(c, samples, members, ["c1"]), lambda c: T.family_kernel_tests(c, samples, members, delta=0.7)):
        a, b = ({r.group: r for r in test(given(rows)).collect()} for rows in (calls, more))
        assert a.keys() == b.keys() == {"some", "one"} and a["one"].num_var == 1
        for k in a:
            assert tuple(b[k])[1:] == pytest.approx(tuple(a[k])[1:], rel=1e-6)
    cells, names = T.group_cells(given(calls), members)
    assert {r.group for r in names.collect()} == {"some", "one"}
    rows = T.gram(cells, samples).collect()
    x = g.T @ g
    assert len(rows) == 1 and {(p.a, p.b): p.sab for p in rows[0].two} == {(a, b): x[a, b] for a in range(m - 1) for b in range(a + 1, m - 1) if x[a, b]}
