"""Registered queries of mixed models with a given kinship, with SQL from the blocks' inverses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import views as V
from ..functions.special import chi2_1_sf_sql
from ..operators import association as A
from ..operators import kinship as K
from ..operators import relatives as R
from .queries import MEMBERS, PEOPLE, members, query, rounded

DELTA = 1.0
#: A nuclear family of the pedigree: two founders and their two children.
_FAMILY = np.array([[1, 0, 0.5, 0.5], [0, 1, 0.5, 0.5], [0.5, 0.5, 1, 0.5], [0.5, 0.5, 0.5, 1]])
_INVERSE = np.linalg.inv(_FAMILY + DELTA * np.eye(4))


def relatedness(spark, sf_dir):
    """Twice the kinship of the customers' pedigree."""
    V.read(spark, sf_dir, "customer").createOrReplaceTempView("customer_for_pedigree")
    pairs = K.pedigree(spark.sql(PEOPLE.replace("FROM customer", "FROM customer_for_pedigree")))
    return pairs.select("i", "j", (2 * F.col("kinship")).alias("kinship"))


RELATED = f""", fm AS (SELECT sample_id, y, sample_id // 4 AS block, sample_id % 4 AS k, COUNT(*) OVER (PARTITION BY sample_id // 4) AS m FROM samples),
inv(a, b, x) AS (VALUES {", ".join(f"({a}, {b}, {float(_INVERSE[a, b])!r}::DOUBLE)" for a in range(4) for b in range(4))}),
vp AS (SELECT s.sample_id AS i, o.sample_id AS j, o.y, CASE WHEN s.m = 4 THEN x WHEN s.k = o.k THEN {1 / (1 + DELTA)}e0 ELSE 0e0 END AS x FROM fm s JOIN fm o ON s.block = o.block JOIN inv ON inv.a = s.k AND inv.b = o.k),
vs AS (SELECT i AS sample_id, SUM(x) AS v1, SUM(x * y) AS vy FROM vp GROUP BY 1),
t0 AS (SELECT COUNT(*) AS n, SUM(v1) AS one, SUM(vy) AS ys, SUM(y * vy) AS yy FROM vs JOIN samples USING (sample_id)),
t AS (SELECT n, one, ys / one AS mean, (yy - ys * ys / one) / n AS s2 FROM t0),
k1 AS (SELECT k, SUM(g) AS ac, SUM(g * (vy - mean * v1)) AS gr, SUM(g * v1) AS g1 FROM x JOIN vs USING (sample_id), t GROUP BY 1),
k2 AS (SELECT a.k, SUM(a.g * b.g * vp.x) AS gg FROM x a JOIN vp ON vp.i = a.sample_id JOIN x b ON b.k = a.k AND b.sample_id = vp.j GROUP BY 1),
v AS (SELECT k, ac, ac / (2e0 * n) AS af, g1 / one / 2 AS blue, gr / s2 AS u, (gg - g1 * g1 / one) / s2 AS v, n FROM k1 JOIN k2 USING (k), t)
"""
TESTS = f"SELECT k AS {{k}}, ROUND(af, 9) AS af, ROUND(u * u / v, 5) AS stat, ROUND({chi2_1_sf_sql('(u * u / v)')}, 5) AS pvalue FROM v WHERE v > 1e-15"


def _tests(spark, sf_dir, calls, key="variant_id"):
    null = R.Null(relatedness(spark, sf_dir), V.samples(spark, sf_dir), "y", delta=DELTA)
    return rounded(R.score(calls, null, key).where("stat IS NOT NULL").select(key, "af", "stat", "pvalue"), af=9, stat=5, pvalue=5)


@query("kin_score_delta", ", x AS (SELECT variant_id AS k, sample_id, g FROM c0)" + RELATED + TESTS.format(k="variant_id"))
def kin_score_delta(spark, sf_dir):
    return _tests(spark, sf_dir, V.calls(spark, sf_dir, complete=True))


@query("kin_cmc_delta", MEMBERS + ", x AS (SELECT grp AS k, sample_id, 1 AS g FROM c0 JOIN members USING (variant_id) GROUP BY 1, 2)" + RELATED + TESTS.format(k='"group"'))
def kin_cmc_delta(spark, sf_dir):
    return _tests(spark, sf_dir, A.collapse(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir), "cmc"), "group")


@query("kin_zeggini_delta", MEMBERS + ", x AS (SELECT grp AS k, sample_id, COUNT(*) AS g FROM c0 JOIN members USING (variant_id) GROUP BY 1, 2)" + RELATED + TESTS.format(k='"group"'))
def kin_zeggini_delta(spark, sf_dir):
    return _tests(spark, sf_dir, A.collapse(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir), "zeggini"), "group")


@query("kin_meta_score", ", x AS (SELECT variant_id AS k, sample_id, g FROM c0)" + RELATED + "SELECT variant_id, chrom, pos, ref, alt, n, ROUND(blue, 9) AS af, ac::DOUBLE AS ac, ROUND(u, 9) AS u, ROUND(SQRT(v), 9) AS sqrt_v, ROUND(u / v, 4) AS effect FROM v JOIN variants ON variant_id = k WHERE v > 1e-15")
def kin_meta_score(spark, sf_dir):
    null = R.Null(relatedness(spark, sf_dir), V.samples(spark, sf_dir), "y", delta=DELTA)
    rows = R.meta_score(V.calls(spark, sf_dir, complete=True), V.variants(spark, sf_dir), null)
    return rounded(rows.where("effect IS NOT NULL").drop("pvalue"), af=9, u=9, sqrt_v=9, effect=4).withColumn("ac", F.round("ac"))


@query("kin_score")
def kin_score(spark, sf_dir):
    """The ratio of noise to kinship variance is fitted, with covariates."""
    null = R.Null(relatedness(spark, sf_dir), V.samples(spark, sf_dir), "y", ["c1", "c2"])
    return R.score(V.calls(spark, sf_dir, complete=True), null)
