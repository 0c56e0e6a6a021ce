"""Registered queries for real-valued traits and dosages, covariates and families, with SQL on its own way to the same figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.special import chi2_1_sf_sql, log10_chi2_1_sf_sql
from ..operators import association as A
from ..operators import linkage as D
from ..operators import mixed as M
from .queries import COUNTS, CMC, FP, MEMBERS, ZEG, burden, fp_weights, members, query, rounded, size

COVARIATES = ["c1", "c2"]


def real_samples(spark, sf_dir):
    """The samples with a trait r that isn't an integer."""
    return V.samples(spark, sf_dir).withColumn("r", F.col("y").cast("double") / 700.0)


def dosages(spark, sf_dir):
    """Calls as dosages between genotypes; missing ones stay missing."""
    return V.calls(spark, sf_dir).withColumn("g", F.col("g") * 0.75 + F.col("gq") / 16.0)


REAL = ", xs AS (SELECT *, CAST(y AS DOUBLE) / 700.0e0 AS r FROM samples)"
DOSE = ", x AS (SELECT variant_id AS k, sample_id, g * 0.75e0 + gq / 16.0e0 AS g FROM calls)"
CALLS = ", x AS (SELECT variant_id AS k, sample_id, CAST(g AS DOUBLE) AS g FROM calls)"
#: Sums of x(k, sample_id, g) with the real trait, missing calls at the mean.
RSUMS = """, s AS (SELECT k, COALESCE(SUM(g), 0) AS ac, COALESCE(SUM(g * g), 0) AS sq, COALESCE(SUM(g * r), 0) AS gy, SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS miss,
 COALESCE(SUM(CASE WHEN g IS NULL THEN r END), 0) AS my FROM x JOIN xs USING (sample_id) GROUP BY 1),
t AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(r) AS m, VAR_POP(r) AS s2 FROM xs), f AS (SELECT s.*, n, m, s2, ac / (n - miss) AS mean FROM s, t),
z AS (SELECT k, n, s2, ac + miss * mean AS a, gy + mean * my - m * (ac + miss * mean) AS u, sq + miss * mean * mean - (ac + miss * mean) * (ac + miss * mean) / n AS w FROM f)
"""
SCORED = f"""SELECT k AS variant_id, ROUND(a / (2 * n), 9) AS af, ROUND(u, 4) AS u_stat, ROUND(u * u / (s2 * w), 6) AS stat, ROUND(u / w, 5) AS effect, ROUND({chi2_1_sf_sql("(u * u / (s2 * w))")}, 6) AS pvalue,
 ROUND({log10_chi2_1_sf_sql("(u * u / (s2 * w))")}, 5) AS log10p FROM z WHERE w > 1e-9"""
SCORE_DIGITS = {"af": 9, "u_stat": 4, "stat": 6, "effect": 5, "pvalue": 6, "log10p": 5}


def _score(calls, samples):
    out = A.score(A.group_sums(calls, samples, y="r"), *A.trait_sums(samples, "r"))
    return rounded(out.where("stat IS NOT NULL").select("variant_id", *SCORE_DIGITS), **SCORE_DIGITS)


@query("score_real", REAL + CALLS + RSUMS + SCORED)
def score_real(spark, sf_dir):
    return _score(V.calls(spark, sf_dir), real_samples(spark, sf_dir))


@query("score_dosage", REAL + DOSE + RSUMS + SCORED)
def score_dosage(spark, sf_dir):
    return _score(dosages(spark, sf_dir), real_samples(spark, sf_dir))


@query("wald_real", REAL + ", x AS (SELECT variant_id AS k, sample_id, CAST(g AS DOUBLE) AS g FROM c0)" + RSUMS + f""", v AS (SELECT k, u / w AS b, SQRT((s2 * n - u * u / w) / n / w) AS se FROM z WHERE w > 1e-9)
SELECT k AS variant_id, ROUND(b, 5) AS beta, ROUND(se, 5) AS se, ROUND({chi2_1_sf_sql("((b / se) * (b / se))")}, 6) AS pvalue FROM v""")
def wald_real(spark, sf_dir):
    samples = real_samples(spark, sf_dir)
    out = A.wald_linear(A.group_sums(V.calls(spark, sf_dir, complete=True), samples, y="r"), *A.trait_sums(samples, "r"))
    return rounded(out.where("beta IS NOT NULL").drop("log10p"), beta=5, se=5, pvalue=6)


@query("skat_real", REAL + CALLS + RSUMS + MEMBERS + """, q AS (SELECT k, 25.0e0 * POW(1.0e0 - LEAST(a / (2 * n), 1.0e0 - a / (2 * n)), 24.0e0) AS b, u FROM z WHERE a > 0)
SELECT grp AS "group", COUNT(*) AS n_variants, ROUND(LN(SUM(b * b * u * u)), 6) AS log_q FROM q JOIN members ON k = variant_id GROUP BY 1""")
def skat_real(spark, sf_dir):
    out = A.skat_q(V.calls(spark, sf_dir), real_samples(spark, sf_dir), members(spark, sf_dir), y="r")
    return out.select("group", "n_variants", F.round(F.ln("q"), 6).alias("log_q"))


# ---- covariates ------------------------------------------------------------------------------------------------------

#: Two covariates made orthogonal to 1 and to each other, the trait's residual e0, and sums of x(k, sample_id, g) with them.
ADJUST = """, b0 AS (SELECT sample_id, CAST(y AS DOUBLE) - AVG(y) OVER () AS y0, c1 - AVG(c1) OVER () AS e1, c2 - AVG(c2) OVER () AS d2 FROM samples),
b1 AS (SELECT *, d2 - SUM(d2 * e1) OVER () / SUM(e1 * e1) OVER () * e1 AS e2 FROM b0),
b2 AS (SELECT sample_id, e1, e2, y0 - SUM(y0 * e1) OVER () / SUM(e1 * e1) OVER () * e1 - SUM(y0 * e2) OVER () / SUM(e2 * e2) OVER () * e2 AS e0 FROM b1),
t AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, SUM(e0 * e0) / COUNT(*) AS s2, SUM(e1 * e1) AS q1, SUM(e2 * e2) AS q2 FROM b2),
s AS (SELECT k, CAST(COALESCE(SUM(g), 0) AS DOUBLE) AS ac, CAST(COALESCE(SUM(g * g), 0) AS DOUBLE) AS sq, SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS miss,
 COALESCE(SUM(g * e0), 0) AS g0, COALESCE(SUM(CASE WHEN g IS NULL THEN e0 END), 0) AS m0, COALESCE(SUM(g * e1), 0) AS g1, COALESCE(SUM(CASE WHEN g IS NULL THEN e1 END), 0) AS m1,
 COALESCE(SUM(g * e2), 0) AS g2, COALESCE(SUM(CASE WHEN g IS NULL THEN e2 END), 0) AS m2 FROM x JOIN b2 USING (sample_id) GROUP BY 1),
f AS (SELECT s.*, t.*, ac / (n - miss) AS mean FROM s, t),
z AS (SELECT k, n, s2, ac + miss * mean AS a, g0 + mean * m0 AS u, g1 + mean * m1 AS z1, g2 + mean * m2 AS z2, q1, q2,
 sq + miss * mean * mean - (ac + miss * mean) * (ac + miss * mean) / n - (g1 + mean * m1) * (g1 + mean * m1) / q1 - (g2 + mean * m2) * (g2 + mean * m2) / q2 AS w FROM f)
"""
ADJUSTED = f"""SELECT k AS {{k}}, ROUND(u * u / (s2 * w), 4) AS stat, ROUND(u / w, 3) AS effect, ROUND({chi2_1_sf_sql("(u * u / (s2 * w))")}, 4) AS pvalue FROM z WHERE w > 1e-9"""


def _adjusted(calls, samples, group="variant_id"):
    out = A.score_with_covariates(calls, samples, COVARIATES, group=group).where("stat IS NOT NULL")
    return rounded(out.select(group, "stat", "effect", "pvalue"), stat=4, effect=3, pvalue=4)


@query("score_qtl_cov", CALLS + ADJUST + ADJUSTED.format(k="variant_id"))
def score_qtl_cov(spark, sf_dir):
    return _adjusted(V.calls(spark, sf_dir), V.samples(spark, sf_dir))


@query("cmc_score_cov", CMC + ADJUST + ADJUSTED.format(k='"group"'))
def cmc_score_cov(spark, sf_dir):
    return _adjusted(A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "cmc"), V.samples(spark, sf_dir), "group")


@query("zeggini_score_cov", ZEG + ADJUST + ADJUSTED.format(k='"group"'))
def zeggini_score_cov(spark, sf_dir):
    return _adjusted(A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "zeggini"), V.samples(spark, sf_dir), "group")


FPX = FP + ", x AS (SELECT grp AS k, sample_id, CAST(SUM(g * CAST(ROUND(w * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 AS g FROM calls JOIN members USING (variant_id) JOIN w USING (variant_id) WHERE g > 0 GROUP BY 1, 2)"


@query("fp_score_cov", FPX + ADJUST + ADJUSTED.format(k='"group"'))
def fp_score_cov(spark, sf_dir):
    return _adjusted(burden(spark, sf_dir, fp_weights(spark, sf_dir)), V.samples(spark, sf_dir), "group")


WALD = f""", v AS (SELECT k, u / w AS b, SQRT((s2 * n - u * u / w) / n / w) AS se FROM z WHERE w > 1e-9)
SELECT k AS {{k}}, ROUND(b, 3) AS beta, ROUND(se, 3) AS se, ROUND({chi2_1_sf_sql("((b / se) * (b / se))")}, 5) AS pvalue FROM v"""


def _wald(calls, samples, group="variant_id"):
    out = A.wald_with_covariates(calls, samples, COVARIATES, group=group).where("beta IS NOT NULL")
    return rounded(out.select(group, "beta", "se", "pvalue"), beta=3, se=3, pvalue=5)


@query("wald_cov", CALLS + ADJUST + WALD.format(k="variant_id"))
def wald_cov(spark, sf_dir):
    return _wald(V.calls(spark, sf_dir), V.samples(spark, sf_dir))


@query("cmc_wald_cov", CMC + ADJUST + WALD.format(k='"group"'))
def cmc_wald_cov(spark, sf_dir):
    return _wald(A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "cmc"), V.samples(spark, sf_dir), "group")


@query("zeggini_wald", ZEG + ADJUST + WALD.format(k='"group"'))
def zeggini_wald(spark, sf_dir):
    return _wald(A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "zeggini"), V.samples(spark, sf_dir), "group")


@query("skat_q_cov", MEMBERS + CALLS + ADJUST + """, q AS (SELECT k, 25.0e0 * POW(1.0e0 - LEAST(a / (2 * n), 1.0e0 - a / (2 * n)), 24.0e0) AS b, u FROM z WHERE a > 0)
SELECT grp AS "group", COUNT(*) AS n_variants, ROUND(LN(SUM(b * b * u * u)), 6) AS log_q FROM q JOIN members ON k = variant_id GROUP BY 1""")
def skat_q_cov(spark, sf_dir):
    out = A.skat_q(V.calls(spark, sf_dir), V.samples(spark, sf_dir), members(spark, sf_dir), COVARIATES)
    return out.select("group", "n_variants", F.round(F.ln("q"), 6).alias("log_q"))


@query("meta_score_cov", CALLS + ADJUST + "SELECT k AS variant_id, ROUND(u / s2, 6) AS u_scaled, ROUND(SQRT(w / s2), 6) AS sqrt_v_scaled, ROUND(u * u / (s2 * w), 5) AS stat FROM z WHERE w > 1e-9")
def meta_score_cov(spark, sf_dir):
    out = A.meta_score_with_covariates(V.calls(spark, sf_dir), V.samples(spark, sf_dir), COVARIATES).where("stat IS NOT NULL")
    return rounded(out.select("variant_id", "u_scaled", "sqrt_v_scaled", "stat"), u_scaled=6, sqrt_v_scaled=6, stat=5)


@query("meta_cov_adjusted", ", x AS (SELECT variant_id AS k, sample_id, CAST(g AS DOUBLE) AS g FROM c0)" + ADJUST + """, site AS (SELECT variant_id, chrom, pos, a, z1, z2, q1, q2 FROM variants JOIN z ON k = variant_id),
pr AS (SELECT p.variant_id AS a, r.variant_id AS b, p.chrom AS a_chrom, p.pos AS a_pos, r.pos AS b_pos, p.a AS sa, r.a AS sb, p.z1 * r.z1 / p.q1 + p.z2 * r.z2 / p.q2 AS gone FROM site p JOIN site r ON p.chrom = r.chrom AND r.pos BETWEEN p.pos AND p.pos + 60000 AND (p.pos < r.pos OR p.variant_id = r.variant_id)),
sh AS (SELECT a, b, SUM(x.g * y.g) AS sab FROM pr JOIN c0 x ON x.variant_id = a JOIN c0 y ON y.variant_id = b AND x.sample_id = y.sample_id GROUP BY 1, 2)
SELECT pr.a, pr.b, a_chrom, a_pos, b_pos, ROUND((COALESCE(sab, 0) - sa * sb / n - gone) / n, 9) AS cov FROM pr LEFT JOIN sh ON pr.a = sh.a AND pr.b = sh.b, n""")
def meta_cov_adjusted(spark, sf_dir):
    null = A.CovariateModel(V.samples(spark, sf_dir), COVARIATES)
    out = D.adjusted_covariances(V.calls(spark, sf_dir, complete=True), V.variants(spark, sf_dir), 60000, null)
    return rounded(out, cov=9)


# ---- families --------------------------------------------------------------------------------------------------------

RHO, DELTA = 0.5, 1.0
FAMILY = f""", p AS (SELECT {1 - RHO + DELTA}e0 AS a), fm AS (SELECT fid, COUNT(*) AS m, CAST(SUM(y) AS DOUBLE) AS s, CAST(SUM(y * y) AS DOUBLE) AS q, {RHO}e0 / ((SELECT a FROM p) + {RHO}e0 * COUNT(*)) AS c FROM samples GROUP BY 1),
t0 AS (SELECT SUM(m) AS n, SUM(m - c * m * m) / a AS one, SUM((1 - c * m) * s) / a AS ys, SUM(q - c * s * s) / a AS yy FROM fm, p GROUP BY a),
t AS (SELECT n, one, ys / one AS mean, (yy - ys * ys / one) / n AS s2 FROM t0),
k1 AS (SELECT k, fid, CAST(SUM(g) AS DOUBLE) AS s, CAST(SUM(g * g) AS DOUBLE) AS q, CAST(SUM(g * y) AS DOUBLE) AS gy FROM x JOIN samples USING (sample_id) WHERE g > 0 GROUP BY 1, 2),
k2 AS (SELECT k, SUM(k1.s) AS ac, SUM(gy - mean * k1.s - c * k1.s * (fm.s - m * mean)) / a AS gr, SUM(k1.q - c * k1.s * k1.s) / a AS gg, SUM(k1.s * (1 - c * m)) / a AS g1 FROM k1 JOIN fm USING (fid), t, p GROUP BY k, a),
v AS (SELECT k, ac / (2 * n) AS af, gr / s2 AS u, (gg - g1 * g1 / one) / s2 AS v FROM k2, t)
SELECT k AS {{k}}, ROUND(af, 9) AS af, ROUND(u * u / v, 5) AS stat, ROUND({chi2_1_sf_sql("(u * u / v)")}, 5) AS pvalue FROM v WHERE v > 1e-15"""


def _family(calls, samples, group="variant_id"):
    out = M.family_score(calls, samples, "y", RHO, group, DELTA).where("stat IS NOT NULL")
    return rounded(out.select(group, "af", "stat", "pvalue"), af=9, stat=5, pvalue=5)


@query("fam_score_delta", ", x AS (SELECT variant_id AS k, sample_id, g FROM c0)" + FAMILY.format(k="variant_id"))
def fam_score_delta(spark, sf_dir):
    return _family(V.calls(spark, sf_dir, complete=True), V.samples(spark, sf_dir))


@query("fam_cmc_delta", MEMBERS + ", x AS (SELECT grp AS k, sample_id, CAST(MAX(1) AS INTEGER) AS g FROM c0 JOIN members USING (variant_id) GROUP BY 1, 2)" + FAMILY.format(k='"group"'))
def fam_cmc_delta(spark, sf_dir):
    return _family(A.collapse(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir), "cmc"), V.samples(spark, sf_dir), "group")


@query("fam_zeggini_delta", MEMBERS + ", x AS (SELECT grp AS k, sample_id, CAST(COUNT(*) AS INTEGER) AS g FROM c0 JOIN members USING (variant_id) GROUP BY 1, 2)" + FAMILY.format(k='"group"'))
def fam_zeggini_delta(spark, sf_dir):
    return _family(A.collapse(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir), "zeggini"), V.samples(spark, sf_dir), "group")


@query("fam_fp_delta", FPX + FAMILY.format(k='"group"'))
def fam_fp_delta(spark, sf_dir):
    return _family(burden(spark, sf_dir, fp_weights(spark, sf_dir)), V.samples(spark, sf_dir), "group")


@query("fam_fp")
def fam_fp(spark, sf_dir):
    return M.family_score(burden(spark, sf_dir, fp_weights(spark, sf_dir)), V.samples(spark, sf_dir), "y", group="group")
