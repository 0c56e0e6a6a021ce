"""Special functions as SQL text (valid in Spark SQL) and as numpy; no scipy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The exponential Chebyshev fit of erfc, relative error under 1.2e-7.
_ERFC = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc_sql(x: str) -> str:
    """erfc of a non-negative expression."""
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * ({x})))"
    poly = f"{_ERFC[-1]}e0"
    for c in _ERFC[-2::-1]:
        poly = f"({c}e0 + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) - 1.26551223e0 + {t} * {poly}))"


def chi2_1_sf_sql(x: str) -> str:
    """P(chi-square with one degree of freedom > x)."""
    return erfc_sql(f"sqrt(({x}) / 2.0e0)")


def log10_chi2_1_sf_sql(x: str) -> str:
    """log10 of P(chi-square with one degree of freedom > x): the logarithm of the same fit, so that nothing underflows."""
    z = f"sqrt(({x}) / 2.0e0)"
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * {z}))"
    poly = f"{_ERFC[-1]}e0"
    for c in _ERFC[-2::-1]:
        poly = f"({c}e0 + {t} * {poly})"
    return f"((ln({t}) - ({x}) / 2.0e0 - 1.26551223e0 + {t} * {poly}) / ln(10.0e0))"


def normal_quantile_sql(p: str) -> str:
    """Inverse of the standard normal distribution by Acklam's rational approximation, relative error under 1.2e-9."""
    # The coefficients of that approximation.
    a = "-3.969683028665376e+01 2.209460984245205e+02 -2.759285104469687e+02 1.383577518672690e+02 -3.066479806614716e+01 2.506628277459239e+00".split()
    b = "-5.447609879822406e+01 1.615858368580409e+02 -1.556989798598866e+02 6.680131188771972e+01 -1.328068155288572e+01 1.0e0".split()
    c = "-7.784894002430293e-03 -3.223964580411365e-01 -2.400758277161838e+00 -2.549732539343734e+00 4.374664141464968e+00 2.938163982698783e+00".split()
    d = "7.784695709041462e-03 3.224671290700398e-01 2.445134137142996e+00 3.754408661907416e+00 1.0e0".split()

    def poly(cs, x):
        out = cs[0]
        for k in cs[1:]:
            out = f"({out} * {x} + ({k}))"
        return out

    tail = lambda q: f"{poly(c, q)} / {poly(d, q)}"
    low, high = f"sqrt(-2.0e0 * ln({p}))", f"sqrt(-2.0e0 * ln(1.0e0 - ({p})))"
    mid = f"(({p}) - 0.5e0)"
    return f"CASE WHEN ({p}) < 0.02425e0 THEN {tail(low)} WHEN ({p}) > 0.97575e0 THEN -({tail(high)}) ELSE {mid} * {poly(a, f'({mid} * {mid})')} / {poly(b, f'({mid} * {mid})')} END"


def log_factorials(spark: SparkSession, most: int) -> DataFrame:
    """(k, lf): ln k! for k from 0 to most, which is bounded by twice the number of samples."""
    rows = spark.range(0, most + 1).withColumnRenamed("id", "k")
    return rows.withColumn("lf", F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(Window.orderBy("k")))


_log_factorials = np.zeros(1)


def log_factorial_table(most: int) -> np.ndarray:
    """ln k! for k from 0 to most at least, kept for later calls; 8 bytes an entry, most bounded by twice the samples."""
    global _log_factorials
    if len(_log_factorials) <= most:
        k = np.arange(1, most + 1, dtype=float)
        _log_factorials = np.append(0.0, np.cumsum(np.log(k)))
    return _log_factorials


def chi2_1_sf(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float, noncentral: float = 0.0) -> float:
    """Survival of the chi-square distribution, non-central as a Poisson mixture."""
    if noncentral <= 0:
        return gamma_q(df / 2, x / 2)
    half, total, left, k = noncentral / 2, 0.0, 1.0, 0
    weight = math.exp(-half)
    while left > 1e-14 and k < 5000:
        total += weight * gamma_q(df / 2 + k, x / 2)
        left -= weight
        k += 1
        weight *= half / k
    return total


def liu(q: float, lam: np.ndarray) -> float:
    """P(sum of lam * chi-square_1 > q), matching three moments of a non-central chi-square."""
    return liu_of(q, tuple(float((lam**k).sum()) for k in (1, 2, 3, 4)))


def liu_of(q: float, sums: tuple[float, float, float, float]) -> float:
    """liu() from the sums of lam to lam^4."""
    c1, c2, c3, c4 = sums
    s1, s2 = c3 / c2**1.5, c4 / c2**2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        d = s1 * a**3 - a * a
        df = a * a - 2 * d
    else:
        a, d, df = 1 / s1, 0.0, c2**3 / c3**2
    t = (q - c1) / math.sqrt(2 * c2)
    return chi2_sf(t * math.sqrt(2) * a + df + d, df, d)


def mixture_sf(q: float, lam: np.ndarray, accuracy: float = 1e-9) -> float:
    """P(sum of lam * chi-square_1 > q) by numerical inversion of the characteristic function (Imhof); Liu's
    approximation where that leaves (0, 1). One term is a chi-square itself."""
    lam = lam[lam > 1e-12 * lam.max()] if len(lam) and lam.max() > 0 else lam[:0]
    if not len(lam):
        return 1.0
    if len(lam) == 1:
        return chi2_1_sf(q / lam[0])
    lam, q = lam / lam.max(), q / lam.max()
    # in logarithms: the product of many eigenvalues is below any double
    upper = math.exp(min(20.0, -2 / len(lam) * (math.log(math.pi * len(lam) / 2 * accuracy) + 0.5 * float(np.log(lam).sum()))))
    upper = float(np.clip(upper, 50, 5e4))
    total, left = 0.0, 0.0
    x, w = np.polynomial.legendre.leggauss(16)
    width = max(0.05, min(2.0, math.pi / max(1.0, abs(q), lam.sum())))
    edges = np.arange(left, upper + width, width)
    u = (edges[:-1, None] + edges[1:, None]) / 2 + width / 2 * x[None, :]
    for part in np.array_split(u, max(1, u.size * len(lam) // 2_000_000)):  # bounded for any number of eigenvalues
        lu = lam[:, None, None] * part
        theta = 0.5 * np.arctan(lu).sum(0) - 0.5 * q * part
        rho = np.exp(0.25 * np.log1p(lu**2).sum(0))
        total += float((np.sin(theta) / (part * rho) * (width / 2 * w)).sum())
    p = 0.5 + total / math.pi
    return p if accuracy * 10 < p < 1 else liu(q, lam)
