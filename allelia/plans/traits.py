"""Registered queries of many traits with their own covariates and missing samples, with SQL on its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.special import chi2_1_sf_sql
from ..operators.multitrait import Test, fast_multi_trait_score, multi_trait_score
from .queries import query, rounded

#: Two traits, two covariate sets and none; a tenth of the first trait and a ninth of the second are missing.
TESTS = [Test("t1_c1", "t1", ("c1",)), Test("t1_c1_z2", "t1", ("c1", "z2")), Test("t2_c1_z2", "t2", ("c1", "z2")), Test("t2", "t2")]
DIGITS = {"af": 9, "u_stat": 3, "v_stat": 2, "stat": 5, "pvalue": 5}


def trait_samples(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    id_, y = F.col("sample_id"), F.col("y").cast("double")
    return s.select("sample_id", F.when(id_ % 10 != 3, y / 700.0).alias("t1"), F.when(id_ % 9 != 5, (F.col("y") % 997).cast("double") / 10.0).alias("t2"), F.col("c1").cast("double").alias("c1"), F.when(id_ % 13 != 1, F.col("c2").cast("double")).alias("z2"))


#: The traits, and the calls with missing ones at the mean of all samples.
_MADE = """, ms AS (SELECT sample_id, CASE WHEN sample_id % 10 <> 3 THEN CAST(y AS DOUBLE) / 700e0 END AS t1, CASE WHEN sample_id % 9 <> 5 THEN CAST(y % 997 AS DOUBLE) / 10e0 END AS t2,
 CAST(c1 AS DOUBLE) AS c1, CASE WHEN sample_id % 13 <> 1 THEN CAST(c2 AS DOUBLE) END AS z2 FROM samples),
mu AS (SELECT variant_id, SUM(g) / CAST(n - SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS mean FROM calls, n GROUP BY variant_id, n),
h AS (SELECT variant_id, sample_id, COALESCE(CAST(g AS DOUBLE), mean, 0e0) AS h FROM calls JOIN mu USING (variant_id))"""
_CHI = chi2_1_sf_sql("(u * u / v)")
_OUT = f"SELECT variant_id, test, n, ROUND(af, 9) AS af, ROUND(u, 3) AS u_stat, ROUND(v, 2) AS v_stat, ROUND(u * u / v, 5) AS stat, ROUND({_CHI}, 5) AS pvalue FROM o WHERE v > 1e-3"


def _padded(t: Test) -> tuple[str, ...]:
    return (*t.covariates, *["0e0"] * (2 - len(t.covariates)))


#: Each test's sample with covariates made orthogonal one after the other; then sums of genotypes with them.
EXACT = _MADE + ", p AS (" + " UNION ALL ".join(
    "SELECT '{}' AS test, sample_id, {} AS y, {} AS a, {} AS b FROM ms WHERE {}".format(t.name, t.trait, *_padded(t), " AND ".join(f"{c} IS NOT NULL" for c in t.columns)) for t in TESTS
) + f"""), p0 AS (SELECT test, sample_id, y - AVG(y) OVER w AS y0, a - AVG(a) OVER w AS e1, b - AVG(b) OVER w AS d2 FROM p WINDOW w AS (PARTITION BY test)),
p1 AS (SELECT *, d2 - COALESCE(SUM(d2 * e1) OVER w / NULLIF(SUM(e1 * e1) OVER w, 0), 0) * e1 AS e2 FROM p0 WINDOW w AS (PARTITION BY test)),
p2 AS (SELECT test, sample_id, e1, e2, y0 - COALESCE(SUM(y0 * e1) OVER w / NULLIF(SUM(e1 * e1) OVER w, 0), 0) * e1 - COALESCE(SUM(y0 * e2) OVER w / NULLIF(SUM(e2 * e2) OVER w, 0), 0) * e2 AS e0 FROM p1 WINDOW w AS (PARTITION BY test)),
t AS (SELECT test, COUNT(*) AS n, SUM(e0 * e0) / COUNT(*) AS s2, NULLIF(SUM(e1 * e1), 0) AS q1, NULLIF(SUM(e2 * e2), 0) AS q2 FROM p2 GROUP BY 1),
s AS (SELECT variant_id, test, SUM(h) AS s, SUM(h * h) AS q, SUM(h * e0) AS u, SUM(h * e1) AS z1, SUM(h * e2) AS z2 FROM h JOIN p2 USING (sample_id) GROUP BY 1, 2),
o AS (SELECT variant_id, test, n, s / (2e0 * n) AS af, u, s2 * (q - s * s / n - COALESCE(z1 * z1 / q1, 0) - COALESCE(z2 * z2 / q2, 0)) AS v FROM s JOIN t USING (test))
{_OUT}"""


@query("multi_trait_missing", EXACT)
def multi_trait_missing(spark, sf_dir):
    out = multi_trait_score(V.calls(spark, sf_dir), trait_samples(spark, sf_dir), TESTS).where("v_stat > 1e-3")
    return rounded(out.select("variant_id", "test", "n", *DIGITS), **DIGITS)


_COLUMNS = ("t1", "t2", "c1", "z2")
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i:]]


def _test_sql(t: Test) -> str:
    """A test's row from products over all samples, its covariates' matrix (at most two) inverted by its determinant."""
    pair = lambda a, b: "_".join(sorted((a, b), key=_COLUMNS.index))
    zz = lambda a, b: f"(p_{pair(a, b)} * n_{t.name} / o_{pair(a, b)})"
    xz = lambda a: f"(g_{a} * n_{t.name} / o_{pair(a, a)})"
    y = t.trait
    if not t.covariates:
        fit = gain = explained = "0e0"
    elif len(t.covariates) == 1:
        (a,) = t.covariates
        fit, gain, explained = f"{xz(a)} * {zz(a, y)} / {zz(a, a)}", f"{xz(a)} * {xz(a)} / {zz(a, a)}", f"{zz(a, y)} * {zz(a, y)} / {zz(a, a)}"
    else:
        a, b = t.covariates
        form = lambda p, q, r, s: f"(({zz(b, b)} * {p} * {r} - {zz(a, b)} * ({p} * {s} + {q} * {r}) + {zz(a, a)} * {q} * {s}) / ({zz(a, a)} * {zz(b, b)} - {zz(a, b)} * {zz(a, b)}))"
        fit, gain, explained = form(xz(a), xz(b), zz(a, y), zz(b, y)), form(xz(a), xz(b), xz(a), xz(b)), form(zz(a, y), zz(b, y), zz(a, y), zz(b, y))
    return f"""SELECT variant_id, '{t.name}' AS test, CAST(n_{t.name} AS BIGINT) AS n, a_{t.name} / (2e0 * n_{t.name}) AS af, {xz(y)} - {fit} AS u, ({zz(y, y)} - {explained}) / n_{t.name} AS s2,
 q * n_{t.name} / nn AS x, {gain} AS gain, a_{t.name} AS own, 2e0 * nn AS twice, CAST(n_{t.name} AS DOUBLE) AS m FROM gs, nul"""


def _has(t: Test) -> str:
    return " AND ".join(f"o_{c} = 1" for c in t.columns)


FAST = _MADE + ", cen AS (SELECT sample_id, " + ", ".join(f"COALESCE({c} - AVG({c}) OVER (), 0e0) AS {c}, CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS o_{c}" for c in _COLUMNS) + " FROM ms), nul AS (SELECT CAST(COUNT(*) AS DOUBLE) AS nn, " + ", ".join(
    f"SUM({a} * {b}) AS p_{a}_{b}, CAST(SUM(o_{a} * o_{b}) AS DOUBLE) AS o_{a}_{b}" for a, b in _PAIRS
) + ", " + ", ".join(f"CAST(SUM(CASE WHEN {_has(t)} THEN 1 ELSE 0 END) AS DOUBLE) AS n_{t.name}" for t in TESTS) + " FROM cen), gs AS (SELECT variant_id, SUM(h * h) - SUM(h) * SUM(h) / MAX(n) AS q, " + ", ".join(
    [f"SUM(h * {c}) AS g_{c}" for c in _COLUMNS] + [f"SUM(CASE WHEN {_has(t)} THEN h ELSE 0e0 END) AS a_{t.name}" for t in TESTS]
) + " FROM h JOIN cen USING (sample_id), n GROUP BY 1), r AS (" + " UNION ALL ".join(_test_sql(t) for t in TESTS) + f"""),
o AS (SELECT variant_id, test, n, af, u, s2 * (x - gain) * CASE WHEN own < SQRT(twice) AND 2e0 * af * (1e0 - 2e0 * af) * m > 0 AND x > 0 THEN 2e0 * af * (1e0 - 2e0 * af) * m / x ELSE 1e0 END AS v FROM r)
{_OUT}"""


@query("fast_multi_trait_missing", FAST)
def fast_multi_trait_missing(spark, sf_dir):
    out = fast_multi_trait_score(V.calls(spark, sf_dir), trait_samples(spark, sf_dir), TESTS).where("v_stat > 1e-3")
    return rounded(out.select("variant_id", "test", "n", *DIGITS), **DIGITS)
