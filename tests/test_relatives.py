"""Mixed models with a given kinship against dense numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelia import views as V
from allelia.operators import kinship as K
from allelia.operators import mixed, relatives
from allelia.operators.association import collapse
from allelia.plans import related
from allelia.plans.queries import members


def dense(kinship, n):
    k = np.eye(n)
    for r in kinship.collect():
        k[r.i, r.j] = k[r.j, r.i] = r.kinship
    return k


def cut(k, placed):
    """The kinship without pairs of different blocks."""
    block = np.array([r.block for r in placed.orderBy("sample_id").collect()])
    return np.where(block[:, None] == block[None, :], k, 0)


def matrix(calls, key, n):
    rows = calls.where("g > 0").collect()
    names = sorted({r[key] for r in rows})
    g = np.zeros((n, len(names)))
    for r in rows:
        g[r.sample_id, names.index(r[key])] = r.g
    return names, g


def check(found, names, g, null, tolerance=1e-6):
    rows = {r[0]: r for r in found.collect()}
    assert set(rows) == set(names)
    for v, name in enumerate(names):
        u, var, p, lrt_p, gamma_p = null.tests(g[:, v])
        r = rows[name]
        assert r.u_stat == pytest.approx(u, rel=tolerance, abs=1e-9) and r.v_stat == pytest.approx(var, rel=tolerance)
        assert r.pvalue == pytest.approx(p, abs=1e-5) and relatives_p(r.lrt) == pytest.approx(lrt_p, abs=1e-4) and relatives_p(r.gamma) == pytest.approx(gamma_p, abs=1e-4)


def pinned(told, null):
    """The dense model at the fitted delta, so that the tests are held to more digits than the two searches agree on."""
    told.delta, told.w = null.delta, 1 / (told.lam + null.delta)
    told.loglik, told.sigma2, told.beta = told._fit(np.log(null.delta))
    told.resid = told.uy - told.ux @ told.beta
    told.inner = np.linalg.inv(told.ux.T @ (told.w[:, None] * told.ux))
    return told


def relatives_p(x):
    from allelia.functions.special import chi2_1_sf

    return chi2_1_sf(x)


@pytest.mark.parametrize("threshold", [0.0, 0.25])
def test_genotype_kinship_with_covariates(spark, sf_dir, threshold):
    """A kinship from genotypes: one block of all samples, and several blocks."""
    samples, calls = V.samples(spark, sf_dir), V.calls(spark, sf_dir, complete=True)
    n = samples.count()
    kinship = K.balding_nichols(calls, samples, n)
    kinship = kinship.where(F.col("i") != F.col("j")).unionAll(samples.select(F.col("sample_id").alias("i"), F.col("sample_id").alias("j"), (1.0 + F.col("sample_id") % 3 / 10.0).alias("kinship")))
    null = relatives.Null(kinship, samples, "y", ["c1", "c2"], threshold)
    people = samples.orderBy("sample_id").toPandas()
    told = mixed.DenseNull(cut(dense(kinship, n), null.placed), people["y"].to_numpy(float), people[["c1", "c2"]].to_numpy(float))
    blocks = null.placed.select("block").distinct().count()
    assert blocks < 3 if threshold == 0 else blocks > 1
    assert null.loglik == pytest.approx(told.loglik, abs=1e-4)
    check(relatives.score(calls, null), *matrix(calls, "variant_id", n), pinned(told, null))


def test_families_of_1500(spark, monkeypatch):
    """1,500 samples: a block of 300, families, and singles; a task's matrix is cut to few variants; collapsed groups, too."""
    monkeypatch.setattr(relatives, "CELLS", 3_000)
    rng = np.random.default_rng(3)
    n, m = 1500, 40
    z = rng.normal(size=(300, 40))
    k = np.eye(n)
    k[:300, :300] = z @ z.T / 40
    for f in range(300, 900, 4):
        k[f : f + 4, f : f + 4] = 0.5 + 0.5 * np.eye(4)
    g = rng.binomial(2, rng.uniform(0.01, 0.4, m), (n, m))
    y = np.linalg.cholesky(k + 0.5 * np.eye(n)) @ rng.normal(size=n) + 0.3 * g[:, 0]
    i, j = np.nonzero(np.triu(k))
    kinship = spark.createDataFrame([(int(a), int(b), float(k[a, b])) for a, b in zip(i, j)], "i long, j long, kinship double")
    samples = spark.createDataFrame([(s, float(y[s])) for s in range(n)], "sample_id long, y double")
    calls = spark.createDataFrame([(int(v), int(s), int(g[s, v])) for s, v in zip(*np.nonzero(g))], "variant_id long, sample_id long, g int")
    null = relatives.Null(kinship, samples, "y")
    assert {r.m: r["count"] for r in null.placed.groupBy("m").count().collect()} == {300: 300, 4: 600, 1: 600}
    told = mixed.DenseNull(k, y)
    assert null.delta == pytest.approx(told.delta, rel=2e-3) and null.sigma2 == pytest.approx(told.sigma2, rel=2e-3)
    check(relatives.score(calls, null), list(range(m)), g.astype(float), pinned(told, null))
    found = {r.variant_id: r for r in relatives.score(calls, null).collect()}
    one = np.linalg.solve(k + null.delta * np.eye(n), np.ones(n))
    assert found[7].af_blue == pytest.approx(one @ g[:, 7] / one.sum() / 2, rel=1e-9)


def test_collapsed_groups(spark, sf_dir):
    samples, kinship = V.samples(spark, sf_dir), related.relatedness(spark, sf_dir)
    n = samples.count()
    calls = collapse(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir), "zeggini")
    null = relatives.Null(kinship, samples, "y")
    told = mixed.DenseNull(dense(kinship, n), samples.orderBy("sample_id").toPandas()["y"].to_numpy(float))
    check(relatives.score(calls, null, "group"), *matrix(calls, "group", n), pinned(told, null))


def test_blocks(spark, monkeypatch):
    """Chains, a hub, repeated pairs, loops, pairs of strangers; unknown samples have no effect."""
    samples = spark.createDataFrame([(s,) for s in range(200)], "sample_id long")
    pairs = [(s, s + 1, 0.5) for s in range(60)] + [(s + 1, s, 0.5) for s in range(30)] + [(100, s, 0.3) for s in range(101, 150)] + [(160, 161, 0.01), (170, 170, 2.0), (180, 999, 0.9), (999, 181, 0.9), (150, 149, -0.4)]
    kinship = spark.createDataFrame(pairs, "i long, j long, kinship double")
    found = relatives.members(kinship, samples, 0.05).orderBy("sample_id").collect()
    want = [0 if s <= 60 else 100 if 100 <= s <= 150 else s for s in range(200)]
    assert [r.block for r in found] == want
    assert all(r.m == want.count(r.block) for r in found) and [r.k for r in found[:61]] == list(range(61))
    assert relatives.members(kinship.limit(0), samples).where("m > 1").count() == 0
    monkeypatch.setattr(relatives, "MOST_BLOCK", 60)
    with pytest.raises(ValueError, match="raise the threshold"):
        relatives.members(kinship, samples, 0.05)


def test_unrelated_is_the_plain_score(spark, sf_dir):
    """Without relatives the model is an ordinary regression, with the trait's variance shared out between both terms."""
    samples, calls = V.samples(spark, sf_dir), V.calls(spark, sf_dir, complete=True)
    null = relatives.Null(K.identity(samples), samples, "y", delta=1.0)
    names, g = matrix(calls, "variant_id", samples.count())
    y = samples.orderBy("sample_id").toPandas()["y"].to_numpy(float)
    r, x = y - y.mean(), g - g.mean(0)
    rows = {q.variant_id: q for q in relatives.score(calls, null).collect()}
    for v, name in enumerate(names):
        assert rows[name].stat == pytest.approx((x[:, v] @ r) ** 2 / (x[:, v] @ x[:, v]) / (r @ r / len(y)), rel=1e-6)
        assert rows[name].effect == pytest.approx(x[:, v] @ r / (x[:, v] @ x[:, v]), rel=1e-6)


def test_small_blocks_are_decomposed_together():
    """A batch of blocks gives a batch a size, not one a block, and each block its own vectors."""
    rng = np.random.default_rng(5)
    sizes = [2, 4, 3, 4] * 250
    blocks = [{(a, b): float(rng.uniform(-0.2, 0.4)) for a in range(m) for b in range(a)} for m in sizes]
    pairs = [[{"ki": a, "kj": b, "v": v} for (a, b), v in x.items()] for x in blocks]
    kind = pa.list_(pa.struct([("ki", pa.int32()), ("kj", pa.int32()), ("v", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(sizes, pa.int32()), pa.array(pairs, kind)], names=["block", "m", "pairs"])
    found = list(relatives._eigen([batch]))
    assert len(found) == 3
    seen = {}
    for rows in found:
        seen |= {r["block"]: r for r in rows.to_pylist()}
    assert sorted(seen) == list(range(1000))
    for block, m in enumerate(sizes):
        vec = np.reshape(seen[block]["vec"], (m, m))
        want = np.eye(m)
        for (a, b), v in blocks[block].items():
            want[a, b] = want[b, a] = v
        assert vec.T @ want @ vec == pytest.approx(np.diag(np.linalg.eigvalsh(want)), abs=1e-9)
        assert np.abs(np.linalg.eigvalsh(want)) == pytest.approx(seen[block]["lam"])
