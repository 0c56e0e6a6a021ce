"""Large groups' kernel tests from blocks and a low-rank part, against the whole matrix."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from allelia.functions.special import mixture_sf
from allelia.operators import setbased as T


def sparse_group(m, block, columns, seed):
    """(s, u, i, j, x, low, n) of m variants that share carriers within blocks of `block`, residualised on some columns."""
    rng = np.random.default_rng(seed)
    n = 40 * m
    at, who, g = [], [], []
    for v in range(m):
        own = np.unique(rng.integers(v // block * 8 * block, (v // block + 1) * 8 * block, 12))
        at, who, g = [*at, *[v] * len(own)], [*who, *own], [*g, *rng.integers(1, 3, len(own))]
    at, who, g = np.array(at), np.array(who), np.array(g, float)
    z = np.column_stack([np.ones(n), *rng.normal(size=(columns - 1, n))])
    full = np.zeros((m, n))
    full[at, who] = g
    gram = full @ full.T
    i, j = np.nonzero(np.triu(gram))
    gz = full @ z
    values, vectors = np.linalg.eigh(np.linalg.inv(z.T @ z))
    y = rng.normal(size=n)
    y -= z @ np.linalg.lstsq(z, y, rcond=None)[0]
    return full.sum(1), full @ y + rng.normal(size=m), i, j, gram[i, j], gz @ (vectors * np.sqrt(values)), float(n)


@pytest.mark.parametrize("m,block,columns,tilt", [(30, 5, 1, 0.0), (60, 60, 3, 0.0), (90, 6, 3, 1.2), (260, 13, 2, 0.4)])
def test_blocks_equal_the_whole_matrix(m, block, columns, tilt):
    s, u, i, j, x, low, n = sparse_group(m, block, columns, m)
    u = u * (1 + tilt)
    c = T._whole(m, i, j, x, low)
    q, p, rho, po = T._large(s, u, i, j, x, low, 1.0, n)
    want = T._skat(s, u, c, 1.0, n)
    assert q == pytest.approx(want[0]) and p == pytest.approx(want[1], abs=1e-8)
    _, rho0, po0 = T._skato(s, u, c, 1.0, n)
    assert rho == rho0 and po == pytest.approx(po0, rel=1e-6)


def test_many_eigenvalues_take_bounded_memory():
    lam = np.random.default_rng(2).uniform(0.01, 1, 2_000)
    tracemalloc.start()
    p = mixture_sf(float(lam.sum() + np.sqrt(2 * (lam**2).sum())), lam)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.14 < p < 0.18 and peak < 200e6


def test_family_sums_by_group(spark, monkeypatch):
    """Families that are few, or so many that their products go to the blocks, as the whole matrix has them."""
    rng = np.random.default_rng(12)
    n, m = 300, 40
    calls = spark.createDataFrame([(v, int(k), int(rng.integers(1, 3))) for v in range(m) for k in np.unique(rng.integers(v // 4 * 30, v // 4 * 30 + 30, 6))], "variant_id long, sample_id long, g int")
    members = spark.createDataFrame([("x", v) for v in range(m)], "group string, variant_id long")
    for families in (5, 100):
        samples = spark.createDataFrame([(k, float(rng.normal()), f"f{k * families // n}") for k in range(n)], "sample_id long, y double, fid string")
        monkeypatch.setattr(T, "WHOLE", 200)
        rows = T.family_kernel_tests(calls, samples, members, delta=0.6).first()
        monkeypatch.setattr(T, "WHOLE", 0)
        got = T.family_kernel_tests(calls, samples, members, delta=0.6).first()
        assert got[0] == rows[0] and tuple(got[1:]) == pytest.approx(tuple(rows[1:]), rel=1e-6)
