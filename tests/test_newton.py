"""Logistic regressions in lockstep against numpy, one variant at a time."""

from __future__ import annotations

import math

import numpy as np
import pytest

from allelia.operators import newton as N
from allelia.operators import logistic as B


def fit(x, y, firth):
    b = np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-x @ b))
        h = np.linalg.inv(x.T @ ((p * (1 - p))[:, None] * x))
        leverage = p * (1 - p) * np.einsum("ij,jk,ik->i", x, h, x)
        b = b + (0.5 if firth else 1.0) * h @ x.T @ (y - p + (leverage * (0.5 - p) if firth else 0))
    return b[1], math.sqrt(h[1, 1])


@pytest.fixture(scope="module")
def cohort(spark):
    """(g with nan for missing, y, covariates, calls, samples): dosages, a separated, a still and a collinear variant."""
    rng = np.random.default_rng(51)
    n = 400
    c1, c2 = rng.normal(50, 9, n), rng.exponential(2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - (c1 - 50) / 9 + 0.2 * c2))).astype(int)
    g = np.zeros((n, 12))
    for v in range(9):
        g[:, v] = rng.binomial(2, 0.05 + 0.04 * v, n) * rng.choice([1.0, 0.6, 0.85], n)
    g[rng.choice(n, 25, False), 3] = np.nan
    g[np.flatnonzero(y == 1)[:6], 9] = 1  # carriers are all cases
    g[:, 10] = 1  # doesn't vary
    g[:, 11] = c2  # a combination of the covariates
    calls = [(v, i, None if np.isnan(g[i, v]) else float(g[i, v])) for i in range(n) for v in range(12) if g[i, v] != 0]
    calls += [(0, n, 1.0), (1, n + 1, 2.0)]  # of samples without a covariate or a trait
    people = [(i, int(y[i]), float(c1[i]), float(c2[i]), 7) for i in range(n)] + [(n, 1, None, 1.0, 7), (n + 1, None, 40.0, 1.0, 7)]
    return g, y, np.column_stack([c1, c2]), spark.createDataFrame(calls, "variant_id long, sample_id long, g double"), spark.createDataFrame(people, "sample_id long, case int, c1 double, c2 double, same int")


@pytest.mark.parametrize("firth,block", [(False, 16_384), (True, 16_384), (False, 60)])
def test_regress(cohort, monkeypatch, firth, block):
    g, y, c, calls, samples = cohort
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "LANE", 5)
    rows = {r.variant_id: r for r in N.regress(calls, samples, "case", ["c1", "c2", "same"], firth=firth).collect()}
    assert len(rows) == 12 and rows[10].beta is None and rows[11].beta is None and rows[10].pvalue is None
    assert (rows[9].beta is None) != firth
    scaled = (c - c.mean(0)) / c.std(0)
    for v in range(10 if firth else 9):
        x = np.where(np.isnan(g[:, v]), np.nanmean(g[:, v]), g[:, v])
        beta, se = fit(np.column_stack([np.ones(len(y)), x, scaled]), y, firth)
        assert rows[v].beta == pytest.approx(beta, rel=1e-5, abs=1e-7) and rows[v].se == pytest.approx(se, rel=1e-5)
        assert rows[v].pvalue == pytest.approx(math.erfc(abs(beta / se) / math.sqrt(2)), rel=1e-3)


def test_regress_edges(cohort, spark):
    _, _, _, calls, samples = cohort
    assert N.regress(calls.where("false"), samples, "case", ["c1"]).count() == 0
    alone = N.regress(calls.where("variant_id < 2"), samples.where("case = 1"), "case", ["c1"]).collect()
    assert len(alone) == 2 and all(r.beta is None and r.se is None for r in alone)
    named = calls.where("variant_id = 4").selectExpr("'x' AS group", "sample_id", "g", "1 AS extra")
    row = N.regress(named, samples, "case", [], group="group").first()
    assert row.group == "x" and row.beta is not None


def test_cells_refuse_dosages(cohort):
    _, _, _, calls, samples = cohort
    with pytest.raises(Exception, match="dosage"):
        B.regress(calls, samples, "case", ["same"]).collect()
    with pytest.raises(ValueError, match="patterns"):
        B.regress(calls.where("g in (1, 2)"), samples, "case", ["c1"], patterns=100)


@pytest.mark.parametrize("firth,most", [(False, 1024), (True, 1024), (True, 0)])
def test_rare_variants_meet_no_patterns(spark, monkeypatch, firth, most):
    """Near the null model a step costs a group its carriers: no block of covariate patterns is made, by rows or by rounds."""
    rng = np.random.default_rng(52)
    n = 3000
    c = rng.normal(0, 1, (n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(0.5 - 0.4 * c[:, 0]))).astype(int)
    g = np.where(rng.random((n, 4)) < 0.004, 0.8, 0.0)
    calls = spark.createDataFrame([(v, i, float(g[i, v])) for i in range(n) for v in range(4) if g[i, v]], "variant_id long, sample_id long, g double")
    samples = spark.createDataFrame([(i, int(y[i]), float(c[i, 0]), float(c[i, 1])) for i in range(n)], "sample_id long, case int, c1 double, c2 double")
    monkeypatch.setattr(N, "MOST_CARRIERS", most)
    monkeypatch.setattr(N, "_blocks", lambda *_: pytest.fail("all patterns met a variant of few carriers"))
    for r in N.regress(calls, samples, "case", ["c1", "c2"], firth=firth).collect():
        if not firth and len(set(y[g[:, r.variant_id] > 0])) == 1:
            assert r.beta is None  # carriers have one value of the trait
            continue
        beta, se = fit(np.column_stack([np.ones(n), g[:, r.variant_id], (c - c.mean(0)) / c.std(0)]), y, firth)
        assert r.beta == pytest.approx(beta, rel=1e-5, abs=1e-7) and r.se == pytest.approx(se, rel=1e-5)


@pytest.mark.parametrize("firth", [False, True])
def test_cells_are_fitted_together(firth):
    """One call fits all variants' cells; each as if alone, and one without variance isn't fitted."""
    rng = np.random.default_rng(53)
    x = np.array([[1.0, g, c] for g in range(3) for c in (1.0, 2.0) for _ in range(2)])
    y, n = np.tile([0.0, 1.0], 6), rng.integers(2, 40, (5, 12)).astype(float)
    n[4, 4:] = 0
    beta, covariance, fitted = B.fit_cells(x, y, n, firth)
    assert fitted.tolist() == [True] * 4 + [False]
    for v in range(4):
        rows = np.repeat(np.arange(12), n[v].astype(int))
        b, se = fit(x[rows], y[rows], firth)
        assert beta[v, 1] == pytest.approx(b, rel=1e-6) and math.sqrt(covariance[v, 1, 1]) == pytest.approx(se, rel=1e-6)
