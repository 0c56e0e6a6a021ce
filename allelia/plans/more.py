"""Registered queries of site filters, cells, joins, whole tables of pairs, binary meta scores and family likelihoods, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import association as A
from ..operators import counts as C
from ..operators import filters as L
from ..operators import genotypes as G
from ..operators import kinship as K
from ..operators import linkage as D
from ..operators import mixed as M
from ..operators import phenotype as P
from ..operators import summary as S
from .adjusted import DELTA, FAMILY, RHO
from .queries import COUNTS, HWE, MEMBERS, counter, members, query, rounded, size

# ---- filters and cells -----------------------------------------------------------------------------------------------


def _with_info(spark, sf_dir):
    info = F.expr("concat('DP=', cast(pos div 1000 as string), CASE WHEN variant_id % 5 <> 0 THEN concat(';AF=', cast(variant_id % 100 / 100.0D as string)) ELSE '' END)")
    return V.variants(spark, sf_dir).withColumn("info", info)


@query("info_depth", " SELECT variant_id FROM variants WHERE pos // 1000 BETWEEN 50 AND 900")
def info_depth(spark, sf_dir):
    return _with_info(spark, sf_dir).where(L.info_depth_between(50, 900)).select("variant_id")


@query("info_frequency", " SELECT variant_id FROM variants WHERE variant_id % 5 <> 0 AND LEAST(variant_id % 100 / 100.0e0, 1 - variant_id % 100 / 100.0e0) BETWEEN 0.05 AND 0.305")
def info_frequency(spark, sf_dir):
    return _with_info(spark, sf_dir).where(L.info_frequency_between(0.05, 0.305)).select("variant_id")


#: Chromosome 22 stands for X here, with a pseudo-autosomal region at each end.
PAR, XS = [(1, 90_000), (1_500_000, 9_000_000)], (22,)


@query("x_regions", " SELECT variant_id, CASE WHEN pos BETWEEN 1 AND 90000 OR pos BETWEEN 1500000 AND 9000000 THEN 'par' ELSE 'hemi' END AS region FROM variants WHERE chrom = 22")
def x_regions(spark, sf_dir):
    v = V.variants(spark, sf_dir)
    parts = [v.where(f(PAR, XS)).select("variant_id", F.lit(name).alias("region")) for name, f in (("par", L.x_par), ("hemi", L.x_hemizygous))]
    return parts[0].unionAll(parts[1])


@query("chrom_regions", " SELECT variant_id FROM variants WHERE (chrom = 3 AND pos BETWEEN 5000 AND 900000) OR (chrom = 7 AND pos BETWEEN 1 AND 400000)")
def chrom_regions(spark, sf_dir):
    return V.variants(spark, sf_dir).where(L.in_regions([("3", 5000, 900_000), ("7", 1, 400_000)])).select("variant_id")


CELLS = """, c AS (SELECT variant_id, sample_id, g, gd, sex = 1 AND chrom = 22 AS hemi, CASE WHEN g IS NULL THEN NULL WHEN sample_id % 4 = 0 THEN 2 ELSE 1 END AS a, CASE WHEN g IS NULL THEN NULL WHEN g = 2 OR sample_id % 3 = 0 THEN 1 ELSE 0 END AS b
 FROM calls JOIN samples USING (sample_id) JOIN variants USING (variant_id))"""


@query("male_cells", CELLS + """ SELECT variant_id, sample_id, CASE WHEN a = b THEN 1 END AS binary, CASE WHEN a = b THEN 2 * CAST(a = 1 AS INTEGER) END AS count1, CASE WHEN a = b THEN 0 END AS count2,
 CASE WHEN g IS NULL OR (hemi AND b = 0) THEN NULL ELSE 1 + b END AS collapsed, CASE WHEN hemi THEN 2 * (gd / 64.0e0) ELSE gd / 64.0e0 END AS dosage FROM c""")
def male_cells(spark, sf_dir):
    rows = V.calls(spark, sf_dir).join(V.samples(spark, sf_dir).select("sample_id", "sex"), "sample_id").join(V.variants(spark, sf_dir).select("variant_id", "chrom"), "variant_id")
    a = F.when(F.col("g").isNotNull(), F.when(F.col("sample_id") % 4 == 0, 2).otherwise(1))
    b = F.when(F.col("g").isNotNull(), F.when((F.col("g") == 2) | (F.col("sample_id") % 3 == 0), 1).otherwise(0))
    gt = F.when(F.col("g").isNull(), "./.").otherwise(F.concat(a.cast("string"), F.lit("/"), b.cast("string")))
    hemi = (F.col("sex") == 1) & (F.col("chrom") == 22)
    cell, form = F.concat_ws(":", gt, (F.col("gd") / 64.0).cast("string")), F.lit("GT:DS")
    return rows.select("variant_id", "sample_id", G.male_binary(gt).alias("binary"), G.male_count_of(gt, 1).alias("count1"), G.male_count_of(gt, 2).alias("count2"), G.biallelic_collapse(a, b, hemi).alias("collapsed"), G.dosage_field(cell, form, hemi).alias("dosage"))


@query("same_annotation", " SELECT variant_id, starts_with(split_part(anno, ' ', 1), substr(anno, 1, 3)) OR starts_with(substr(anno, 1, 3), split_part(anno, ' ', 1)) AS same, starts_with(anno, 'SMALL PLATED COPPER AND MORE') OR starts_with('SMALL PLATED COPPER AND MORE', anno) AS named FROM variants")
def same_annotation(spark, sf_dir):
    a = F.col("anno")
    return V.variants(spark, sf_dir).select("variant_id", G.same_annotation(F.split_part(a, F.lit(" "), F.lit(1)), F.substring(a, 1, 3)).alias("same"), G.same_annotation(a, F.lit("SMALL PLATED COPPER AND MORE")).alias("named"))


# ---- joins of samples ------------------------------------------------------------------------------------------------


@query("trait_and_covariates", " SELECT sample_id, y, trait, c1, c2 FROM samples WHERE sample_id % 9 <> 0 AND sample_id % 7 <> 0 AND sample_id % 10 <> 0")
def trait_and_covariates(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    traits = s.where("sample_id % 9 <> 0").select("sample_id", F.when(F.col("sample_id") % 10 != 0, F.col("y")).alias("y"), "trait")
    return P.complete_traits(P.with_covariates(traits, s.where("sample_id % 7 <> 0").select("sample_id", "c1", "c2")), ["y", "trait"])


@query("sex_join", " SELECT sample_id, y, CASE WHEN sample_id % 9 <> 0 AND sample_id % 5 <> 0 THEN sex ELSE 0 END AS sex FROM samples")
def sex_join(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    sex = s.where("sample_id % 9 <> 0").select("sample_id", F.when(F.col("sample_id") % 5 != 0, F.col("sex")).alias("sex"))
    return P.with_sex(s.select("sample_id", "y"), sex)


@query("kinship_subset", ", p AS (SELECT c_custkey AS i, c_nationkey AS j, c_custkey / 7.0e0 AS kinship FROM customer) SELECT i, j, kinship FROM p WHERE i % 3 = 0 AND j % 3 = 0")
def kinship_subset(spark, sf_dir):
    k = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").cast("long").alias("j"), (F.col("c_custkey") / 7.0).alias("kinship"))
    return K.subset(k, V.samples(spark, sf_dir).where("sample_id % 3 = 0"))


# ---- counters and summaries ------------------------------------------------------------------------------------------


@query("single_dummy_full", COUNTS + "SELECT variant_id, n - n_missing AS n_count, CASE WHEN n_ref > 0 THEN 0 WHEN n_het > 0 THEN 1 WHEN n_alt > 0 THEN 2 END AS minimum, CASE WHEN n_alt > 0 THEN 2 WHEN n_het > 0 THEN 1 WHEN n_ref > 0 THEN 0 END AS maximum FROM freq, n")
def single_dummy_full(spark, sf_dir):
    return C.extremes(counter(spark, sf_dir), size(spark, sf_dir))


@query("mb_all_weight", """, q AS (SELECT variant_id, ROUND(CAST(COALESCE(SUM(g), 0) + 1 AS DOUBLE) / CAST(2 * ((SELECT n FROM n) - SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END)) + 2 AS DOUBLE), 9) AS q FROM calls GROUP BY 1)
SELECT variant_id, ROUND(1.0 / SQRT(n * q * (1 - q)), 9) AS w FROM q, n""")
def mb_all_weight(spark, sf_dir):
    n = size(spark, sf_dir)
    return rounded(A.madsen_browning_weights(rounded(C.smoothed_frequency(V.calls(spark, sf_dir), n), q=9), n), w=9)


@query("peek_histograms", COUNTS + HWE + """, v AS (SELECT 'af' AS measure, af AS v FROM freq UNION ALL SELECT 'maf', maf FROM freq UNION ALL SELECT 'call_rate', call_rate FROM freq UNION ALL SELECT 'hwe_p', hwe_p FROM hwe),
b AS (SELECT measure, CAST(LEAST(FLOOR(v * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n FROM v GROUP BY 1, 2) SELECT *, ROW_NUMBER() OVER (PARTITION BY measure ORDER BY n DESC, bin) = 1 AS mode FROM b""")
def peek_histograms(spark, sf_dir):
    counts = counter(spark, sf_dir)
    return S.histograms(counts.join(rounded(C.hwe_exact(counts), hwe_p=6), "variant_id"), ["af", "maf", "call_rate", "hwe_p"], 10)


@query("header_block", """, v AS (SELECT 'y' AS name, CAST(y AS DOUBLE) AS v FROM samples UNION ALL SELECT 'c1', c1 FROM samples UNION ALL SELECT 'c2', c2 FROM samples),
r AS (SELECT name, v, ROW_NUMBER() OVER (PARTITION BY name ORDER BY v) - 1 AS i, COUNT(*) OVER (PARTITION BY name) AS n FROM v)
SELECT name, MIN(v) AS minimum, MAX(CASE WHEN i = FLOOR(n * 0.25) THEN v END) AS q1, MAX(CASE WHEN i = FLOOR(n * 0.5) THEN v END) AS median, MAX(CASE WHEN i = FLOOR(n * 0.75) THEN v END) AS q3, MAX(v) AS maximum,
 ROUND(AVG(v), 4) AS mean, ROUND(VAR_SAMP(v), 2) AS variance FROM r GROUP BY 1""")
def header_block(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    parts = [C.quantity_summary(s.select(F.col(c).cast("double").alias(c)), c).withColumn("name", F.lit(c)) for c in ("y", "c1", "c2")]
    return rounded(parts[0].unionAll(parts[1]).unionAll(parts[2]), mean=4, variance=2)


@query("ld_anchor_full", """, mk AS (SELECT variant_id, COUNT(*) FILTER (g = 1) AS h, COUNT(*) FILTER (g = 2) AS k FROM c0 GROUP BY 1), p AS (SELECT a.variant_id AS a, b.variant_id AS b FROM variants a, variants b WHERE a.variant_id IN (3, 17)),
sh AS (SELECT a, b, SUM(x.g * y.g) AS sab, COUNT(*) FILTER (x.g = 1 AND y.g = 1) AS n11, COUNT(*) FILTER (x.g = 1 AND y.g = 2) AS n12, COUNT(*) FILTER (x.g = 2 AND y.g = 1) AS n21, COUNT(*) FILTER (x.g = 2 AND y.g = 2) AS n22
 FROM p JOIN c0 x ON x.variant_id = a JOIN c0 y ON y.variant_id = b AND x.sample_id = y.sample_id GROUP BY 1, 2),
f AS (SELECT p.a, p.b, n, COALESCE(sab, 0) AS sab, COALESCE(n11, 0) AS n11, COALESCE(n12, 0) AS n12, COALESCE(n21, 0) AS n21, COALESCE(n22, 0) AS n22, COALESCE(ma.h, 0) AS ha, COALESCE(ma.k, 0) AS ka, COALESCE(mb.h, 0) AS hb, COALESCE(mb.k, 0) AS kb
 FROM p LEFT JOIN sh ON p.a = sh.a AND p.b = sh.b LEFT JOIN mk ma ON ma.variant_id = p.a LEFT JOIN mk mb ON mb.variant_id = p.b, n),
g AS (SELECT *, ha - n11 - n12 AS n10, ka - n21 - n22 AS n20, hb - n11 - n21 AS n01, kb - n12 - n22 AS n02, CAST(sab AS DOUBLE) / n - CAST(ha + 2 * ka AS DOUBLE) / n * (CAST(hb + 2 * kb AS DOUBLE) / n) AS cov,
 CAST(ha + 4 * ka AS DOUBLE) / n - (CAST(ha + 2 * ka AS DOUBLE) / n) * (CAST(ha + 2 * ka AS DOUBLE) / n) AS va, CAST(hb + 4 * kb AS DOUBLE) / n - (CAST(hb + 2 * kb AS DOUBLE) / n) * (CAST(hb + 2 * kb AS DOUBLE) / n) AS vb FROM f)
SELECT a, b, n - n01 - n02 - n10 - n11 - n12 - n20 - n21 - n22 AS n00, n01, n02, n10, n11, n12, n20, n21, n22, ROUND(cov, 9) AS cov, ROUND(CASE WHEN va < 1e-20 OR vb < 1e-20 THEN 0.0 ELSE cov / SQRT(va * vb) END, 6) AS r FROM g""")
def ld_anchor_full(spark, sf_dir):
    v = V.variants(spark, sf_dir).select("variant_id")
    anchors = spark.createDataFrame([(3,), (17,)], "a long")  # the listed anchors
    out = D.pair_tables(V.calls(spark, sf_dir, complete=True), v.withColumnRenamed("variant_id", "b").join(F.broadcast(anchors)), size(spark, sf_dir))
    return rounded(out, cov=9, r=6)


# ---- binary meta scores ----------------------------------------------------------------------------------------------

META = """, tn AS (SELECT trait, COUNT(*) AS n FROM samples GROUP BY 1), c1 AS (SELECT variant_id, trait, COUNT(*) FILTER (g = 1) AS h, COUNT(*) FILTER (g = 2) AS k, COUNT(*) FILTER (g IS NULL) AS m, COALESCE(SUM(g), 0) AS ac FROM calls JOIN samples USING (sample_id) GROUP BY 1, 2),
c2 AS (SELECT v.variant_id, tn.trait, tn.n, COALESCE(h, 0) AS h, COALESCE(k, 0) AS k, COALESCE(m, 0) AS m, COALESCE(ac, 0) AS ac FROM (SELECT DISTINCT variant_id FROM calls) v CROSS JOIN tn LEFT JOIN c1 ON c1.variant_id = v.variant_id AND c1.trait = tn.trait),
c3 AS (SELECT variant_id, SUM(n) AS n, SUM(h) AS h, SUM(k) AS k, SUM(m) AS m, SUM(ac) AS ac, SUM(CASE WHEN trait = 2 THEN n END) AS n2, SUM(CASE WHEN trait = 2 THEN h END) AS h2, SUM(CASE WHEN trait = 2 THEN k END) AS k2, SUM(CASE WHEN trait = 2 THEN m END) AS m2, SUM(CASE WHEN trait = 2 THEN ac END) AS ac2,
 SUM(CASE WHEN trait = 1 THEN n END) AS n1, SUM(CASE WHEN trait = 1 THEN h END) AS h1, SUM(CASE WHEN trait = 1 THEN k END) AS k1, SUM(CASE WHEN trait = 1 THEN m END) AS m1, SUM(CASE WHEN trait = 1 THEN ac END) AS ac1 FROM c2 GROUP BY 1),
z AS (SELECT *, CAST(n2 AS DOUBLE) / n AS p, CAST(ac AS DOUBLE) / (n - m) AS mean FROM c3),
u AS (SELECT *, ac2 + mean * m2 - p * (ac + mean * m) AS u, p * (1 - p) * (h + 4 * k + m * mean * mean - (ac + mean * m) * (ac + mean * m) / n) AS v FROM z)
SELECT variant_id, CONCAT_WS(':', CAST(n - h - k - m AS BIGINT), CAST(n2 - h2 - k2 - m2 AS BIGINT), CAST(n1 - h1 - k1 - m1 AS BIGINT)) AS n_ref, CONCAT_WS(':', CAST(h AS BIGINT), CAST(h2 AS BIGINT), CAST(h1 AS BIGINT)) AS n_het, CONCAT_WS(':', CAST(k AS BIGINT), CAST(k2 AS BIGINT), CAST(k1 AS BIGINT)) AS n_alt,
 CONCAT_WS(':', CAST(ac AS BIGINT), CAST(ac2 AS BIGINT), CAST(ac1 AS BIGINT)) AS informative_alt_ac, ROUND(u, 6) AS u_stat, ROUND(SQRT(v), 6) AS sqrt_v, ROUND(u * u / v, 5) AS stat FROM u WHERE v > 1e-9"""


@query("meta_score_binary", META)
def meta_score_binary(spark, sf_dir):
    out = A.meta_score_binary(V.calls(spark, sf_dir), V.samples(spark, sf_dir)).where("stat IS NOT NULL")
    return rounded(out.select("variant_id", "n_ref", "n_het", "n_alt", "informative_alt_ac", "u_stat", "sqrt_v", "stat"), u_stat=6, sqrt_v=6, stat=5)


@query("x_female_counts", """, f AS (SELECT sample_id FROM samples WHERE sex = 2), nf AS (SELECT COUNT(*) AS n FROM f),
c AS (SELECT variant_id, COUNT(*) FILTER (g = 1) AS n_het, COUNT(*) FILTER (g = 2) AS n_alt, COUNT(*) FILTER (g IS NULL) AS n_missing, CAST(COALESCE(SUM(g), 0) AS BIGINT) AS ac FROM calls JOIN f USING (sample_id) JOIN variants USING (variant_id)
 WHERE chrom = 22 AND NOT (pos BETWEEN 1 AND 90000 OR pos BETWEEN 1500000 AND 9000000) GROUP BY 1)
SELECT variant_id, n_het, n_alt, n_missing, ac, n - n_het - n_alt - n_missing AS n_ref, ROUND(CAST(ac AS DOUBLE) / (2 * n), 9) AS af FROM c, nf""")
def x_female_counts(spark, sf_dir):
    sites = V.variants(spark, sf_dir).where(L.x_hemizygous(PAR, XS)).select("variant_id")
    females = V.samples(spark, sf_dir).where("sex = 2").select("sample_id")
    rows = V.calls(spark, sf_dir).join(sites, "variant_id", "left_semi").join(females, "sample_id", "left_semi")
    return rounded(C.genotype_counter(rows, females.count()).select("variant_id", "n_het", "n_alt", "n_missing", "ac", "n_ref", "af"), af=9)


# ---- families --------------------------------------------------------------------------------------------------------


@query("fam_likelihood_delta", ", x AS (SELECT variant_id AS k, sample_id, g FROM c0)" + FAMILY[: FAMILY.index("v AS (SELECT k, ac")] + """tr AS (SELECT SUM(m * (1 - c)) / a AS tr FROM fm, p GROUP BY a), gq AS (SELECT k, SUM(q) AS gq FROM k1 GROUP BY 1),
v AS (SELECT k, g1 / one / 2 AS af_blue, gr / s2 AS u, (gg - g1 * g1 / one) / s2 AS v, gq - ac * ac / n AS gg, tr / n / s2 AS gamma, n FROM k2 JOIN gq USING (k), t, tr)
SELECT k AS variant_id, ROUND(af_blue, 9) AS af_blue, ROUND(-n * LN(1 - u * u / v / n), 5) AS lrt, ROUND(u * u / (gamma * gg), 5) AS gamma FROM v WHERE v > 1e-15""")
def fam_likelihood_delta(spark, sf_dir):
    out = M.family_score(V.calls(spark, sf_dir, complete=True), V.samples(spark, sf_dir), "y", RHO, delta=DELTA).where("stat IS NOT NULL")
    return rounded(out.select("variant_id", "af_blue", "lrt", "gamma"), af_blue=9, lrt=5, gamma=5)
