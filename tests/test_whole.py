"""Whole jobs against brute force: every gene, every replicate, every pair."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia import views as V
from allelia.operators import kinship as K
from allelia.operators import linkage as D
from allelia.operators import mixed as M
from allelia.operators import setbased as T
from allelia.plans import kernels  # noqa: F401  registers its queries
from allelia.plans import queries as association


def test_linkage_of_every_gene(spark, sf_dir):
    calls = V.calls(spark, sf_dir, complete=True).collect()
    gene = {r.variant_id: r.gene for r in V.variants(spark, sf_dir).collect()}
    carried: dict = {}
    for r in calls:
        carried.setdefault(r.sample_id, []).append((r.variant_id, r.g))
    want = Counter()
    for own in carried.values():
        for a, x in own:
            for b, y in own:
                if a <= b and gene[a] == gene[b]:
                    want[gene[a], a, b] += x * y
    rows = association.QUERIES["ld_gene_full"](spark, sf_dir).collect()
    assert {(r.group, r.a, r.b): r.sab for r in rows} == want and len(rows) == len(want)
    assert {r.group for r in rows} == {gene[r.variant_id] for r in calls}


def test_linkage_of_overlapping_groups(spark):
    calls = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (1, 2, 2), (2, 2, 2), (3, 3, 1), (1, 3, None)], "variant_id long, sample_id long, g int")
    members = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 1), ("y", 2), ("y", 3)], "group string, variant_id long")
    got = sorted(tuple(r) for r in D.group_products(calls, members).collect())
    pair = [(1, 1, 5, 1, 0, 0, 1), (1, 2, 6, 0, 1, 0, 1), (2, 2, 8, 0, 0, 0, 2)]
    assert got == [("x", *p) for p in pair] + [("y", *p) for p in pair] + [("y", 3, 3, 1, 1, 0, 0, 0)]


@pytest.mark.parametrize("name", sorted(T.STATISTICS))
def test_replicates_are_the_references(spark, sf_dir, name):
    rows = association.QUERIES[f"perm_{name}"](spark, sf_dir).collect()
    assert rows and all(r.actual_perm == 10_000 or r.n_greater + r.n_equal == 1_000 for r in rows)
    assert any(r.actual_perm > 1_000 for r in rows)


def test_statistics_of_blocks():
    rng = np.random.default_rng(8)
    n, m = 60, 5
    cells = sorted({(int(v), int(k)) for v, k in zip(np.append(np.arange(m), rng.integers(0, m, 40)), rng.integers(0, n, 45))})
    var, who = np.array(cells).T
    g = rng.integers(1, 3, len(cells)).astype(float)
    y = np.stack([rng.permutation(np.arange(n) % 3 == 0) for _ in range(20)]).astype(float)
    full = np.zeros((n, m))
    full[who, var] = g

    def corr(mask, yy):
        return -1.0 if mask.all() else np.corrcoef(mask, yy)[0, 1]

    def rarecover(yy):
        mask, best = np.zeros(n, bool), -1.0
        while (top := max(range(m), key=lambda k: (corr(mask | (full[:, k] > 0), yy), -k))) is not None:
            value = corr(mask | (full[:, top] > 0), yy)
            if value <= best + 1e-12:
                return best
            mask, best = mask | (full[:, top] > 0), value

    def mb(yy):
        q = (full[yy == 0].sum(0) + 1) / (2 * (yy == 0).sum() + 2)
        score = (full / np.sqrt(n * q * (1 - q))).sum(1)
        return (score @ (yy - yy.mean())) ** 2 / (yy.mean() * (1 - yy.mean()) * n * score.var())

    def kbac(yy):
        case, out = int(yy.sum()), 0.0
        kinds = {tuple(x) for x in full if x.any()}
        for kind in kinds:
            own = (full == kind).all(1)
            t, k = int(own.sum()), int(yy[own].sum())
            below = sum(math.comb(case, x) * math.comb(n - case, t - x) for x in range(k + 1)) / math.comb(n, t)
            out += below * (k / case - (t - k) / (n - case))
        return out

    for name, one in (("rarecover", rarecover), ("mb", mb), ("kbac", kbac)):
        assert T.STATISTICS[name](var, who, g, m, n)(y) == pytest.approx(np.array([one(yy) for yy in y]), abs=1e-9), name


def test_statistics_of_carriers_alone():
    """The carriers' columns with the whole trait's sums give what all samples' columns give."""
    rng = np.random.default_rng(18)
    n, m = 300, 9
    cells = sorted({(int(v), int(k)) for v, k in zip(np.append(np.arange(m), rng.integers(0, m, 60)), rng.integers(0, 90, 69))})
    var, who = np.array(cells).T
    g = rng.integers(1, 3, len(cells)).astype(float)
    y = np.stack([rng.permutation(np.arange(n) % 3 == 0) for _ in range(20)]).astype(float)
    carriers, at = np.unique(who, return_inverse=True)
    whole = T.Whole(n, float(y[0].sum()), float((y[0] ** 2).sum()))
    for name, make in T.STATISTICS.items():
        assert make(var, at, g, m, n, whole)(y[:, carriers]) == pytest.approx(make(var, who, g, m, n)(y)), name


@pytest.mark.parametrize("name", sorted(T.WEIGHTED))
def test_weighted_sums_are_drawn_like_replicates(name):
    rng = np.random.default_rng(21)
    n, case, m = 200, 50, 6
    cells = sorted({(int(v), int(k)) for v, k in zip(np.append(np.arange(m), rng.integers(0, m, 90)), rng.integers(0, 60, 96))})
    var, at = np.array(cells).T
    at = np.unique(at, return_inverse=True)[1]
    g = rng.integers(1, 3, len(cells)).astype(float)
    whole, weights = T.Whole(n, case, case), T.WEIGHTED[name][0](at, g)
    y = T._replicates(rng, 20_000, len(weights), n, 0.0, 1.0, case, None)
    want = T.STATISTICS[name](var, at, g, m, n, whole)(y)
    assert T.WEIGHTED[name][1](y @ weights, weights.sum(), m, n, whole) == pytest.approx(want)
    got = T.WEIGHTED[name][1](T._weighted(rng, 20_000, weights, n, 0.0, 1.0, case), weights.sum(), m, n, whole)
    for q in (0.2, 0.5, 0.8, 0.95):
        assert (got > np.quantile(want, q)).mean() == pytest.approx((want > np.quantile(want, q)).mean(), abs=0.02)


def test_replicates_cost_the_carriers():
    """A replicate of few carriers among very many samples has the permutation's mean and variance, without a draw of all samples."""
    n, case, k = 900_000_000, 180_000_000, 40
    y = T._replicates(np.random.default_rng(3), 20_000, k, n, 0.0, 1.0, case, None)
    total = y.sum(1)
    assert y.shape == (20_000, k) and total.mean() == pytest.approx(8, abs=0.1) and total.var() == pytest.approx(6.4, rel=0.05)
    assert np.abs(y.mean(0) - 0.2).max() < 0.02


@pytest.mark.parametrize("rows", [1_000, 3])
def test_every_pair_with_missing_calls(spark, monkeypatch, rows):
    monkeypatch.setattr(K, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(6)
    n, m = 17, 12
    full = rng.choice([0, 0, 1, 2, -1], (n, m))
    full[:, 0], full[3], full[4] = 1, -1, 0  # a variant that all carry, a sample without calls, one that is hom-ref
    calls = spark.createDataFrame([(v, 10 * k, None if full[k, v] < 0 else int(full[k, v])) for k in range(n) for v in range(m) if full[k, v]], "variant_id long, sample_id long, g int")
    samples = spark.createDataFrame([(10 * k,) for k in range(n)], "sample_id long")
    counts = {(r.i, r.j): (r.p0, r.p1, r.p2, r.p9) for r in K.pair_counts(calls, samples, m).collect()}
    kinship = {(r.i, r.j): r.kinship for r in K.ibs_all(calls, samples, m).collect()}
    assert len(counts) == len(kinship) == n * (n + 1) // 2
    for a in range(n):
        for b in range(a, n):
            ok = (full[a] >= 0) & (full[b] >= 0)
            apart = np.abs(full[a] - full[b])[ok]
            assert counts[10 * a, 10 * b] == tuple(int((apart == d).sum()) for d in (2, 1, 0)) + (int((~ok).sum()),)
            assert kinship[10 * a, 10 * b] == (pytest.approx((2 - apart).mean(), abs=1e-6) if ok.any() else 0)


def test_pair_queries_take_every_pair(spark, sf_dir):
    n, m = spark.read.parquet(f"{sf_dir}/customer.parquet").count(), spark.read.parquet(f"{sf_dir}/part.parquet").count()
    rows = association.QUERIES["pair_sharing_full"](spark, sf_dir).collect()
    assert len({(r.i, r.j) for r in rows}) == len(rows) == n * (n - 1) // 2
    assert all(r.p0 + r.p1 + r.p2 + r.p9 == m for r in rows) and any(r.p9 for r in rows)
    assert association.QUERIES["ibs_kinship_full"](spark, sf_dir).count() == n * (n + 1) // 2


def test_pivot_of_every_sample(spark, sf_dir):
    ids = sorted(r.sample_id for r in V.samples(spark, sf_dir).collect())
    want = {r.variant_id: [0] * len(ids) for r in V.variants(spark, sf_dir).collect()}
    for r in V.calls(spark, sf_dir).collect():
        want[r.variant_id][ids.index(r.sample_id)] = r.g
    rows = association.QUERIES["wide_genotypes_full"](spark, sf_dir).collect()
    assert {r.variant_id: r.genotypes for r in rows} == want and len(rows) == len(want)
    assert any(None in x for x in want.values())


def test_id_sets_take_every_customer(spark, sf_dir):
    found = {r.id for r in association.QUERIES["id_sets_full"](spark, sf_dir).collect()}
    assert found == {r.c_nationkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}


def test_unconverged_solution_is_an_error(spark, sf_dir):
    calls, samples = V.calls(spark, sf_dir, complete=True), V.samples(spark, sf_dir)
    with pytest.raises(ArithmeticError, match="not converged in 1 rounds"):
        M.infinitesimal_solve(calls, samples, "y", 200, 1.0, rounds=1)


def test_partitions_grow_with_the_line_items(spark, sf_dir, monkeypatch):
    names = ("concordance", "concordance_rates", "multi_trait_score")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    want = {n: sorted(map(str, association.QUERIES[n](spark, sf_dir).collect())) for n in names}
    monkeypatch.setattr(V, "ROWS", rows // 10)
    assert V.calls(spark, sf_dir).rdd.getNumPartitions() >= 10
    assert {n: sorted(map(str, association.QUERIES[n](spark, sf_dir).collect())) for n in names} == want


def shuffled_records(spark) -> int:
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rounds_of_the_solution_shuffle_no_calls(spark):
    """Calls are shuffled to be packed, not once a round; a call of another sample and a missing trait take no part."""
    rng = np.random.default_rng(5)
    n, m = 40, 1500
    g = np.where(rng.random((n, m)) < 0.5, rng.integers(1, 3, (n, m)), 0)
    y = rng.normal(size=n)
    calls = spark.createDataFrame([(v, i, int(g[i, v])) for i in range(n) for v in range(m) if g[i, v]], "variant_id long, sample_id long, g int")
    samples = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "sample_id long, y double")
    before = shuffled_records(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = np.array([r.x for r in M.infinitesimal_solve(calls, samples, "y", m, 1.0).orderBy("sample_id").collect()])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled_records(spark) - before < 3 * (g > 0).sum()
    mu = g.mean(0)
    z = (g - mu) / np.sqrt(mu * (1 - mu / 2))
    want = np.linalg.solve(z @ z.T / m + np.eye(n), y - y.mean())
    assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()
    other = calls.where("sample_id < 30")
    few = samples.withColumn("y", F.when(F.col("sample_id") != 4, F.col("y"))).where("sample_id <> 7")
    rows = {r.sample_id: r.x for r in M.infinitesimal_solve(other, few, "y", m, 1.0).collect()}
    some = [i for i in range(n) if i not in (4, 7)]
    whole = np.where(np.arange(n)[:, None] < 30, g, 0)
    mu = whole.sum(0) / (n - 1)
    z = ((whole - mu) / np.sqrt(mu * (1 - mu / 2)))[some]
    want = np.linalg.solve(z @ z.T / m + np.eye(len(some)), y[some] - y[some].mean())
    assert set(rows) == {*some, 4} and rows[4] is None and np.abs(np.array([rows[i] for i in some]) - want).max() < 1e-5 * np.abs(want).max()
