"""Every registered query with the SQL that checks it. The SQL is for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions.special import chi2_1_sf_sql, normal_quantile_sql
from ..operators import association as A
from ..operators import counts as C
from ..operators import filters as L
from ..operators import genotypes as G
from ..operators import impute as I
from ..operators import intervals as R
from ..operators import kinship as K
from ..operators import linkage as D
from ..operators import phenotype as P
from ..operators import summary as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql continues the CTEs of views.SQL, with its own CTEs first (", x AS (...) SELECT ...") or not."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = V.SQL + sql
        return f

    return add


def size(spark: SparkSession, sf_dir: str) -> int:
    return V.read(spark, sf_dir, "customer").count()


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Operators give full doubles; what two engines are compared in is rounded here."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def counter(spark: SparkSession, sf_dir: str, calls: DataFrame | None = None) -> DataFrame:
    counts = C.genotype_counter(V.calls(spark, sf_dir) if calls is None else calls, size(spark, sf_dir))
    return rounded(counts, af=9, af_called=9, maf=9, call_rate=9)


SCORE_DIGITS = {"af": 9, "u_stat": 2, "sqrt_v": 2, "stat": 6, "effect": 4, "pvalue": 6}


def scored(calls: DataFrame, samples: DataFrame, group: str = "variant_id") -> DataFrame:
    return rounded(A.score(A.group_sums(calls, samples, group), *A.trait_sums(samples)), **SCORE_DIGITS).drop("log10p")


COUNTS = """, cnt AS (SELECT variant_id, CAST(SUM(CASE WHEN g = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_het, CAST(SUM(CASE WHEN g = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_alt,
 CAST(SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(COALESCE(SUM(g), 0) AS BIGINT) AS ac FROM calls GROUP BY 1),
freq AS (SELECT cnt.*, n - n_het - n_alt - n_missing AS n_ref, ROUND(CAST(ac AS DOUBLE) / CAST(2 * n AS DOUBLE), 9) AS af,
 ROUND(CAST(ac AS DOUBLE) / CAST(2 * (n - n_missing) AS DOUBLE), 9) AS af_called,
 ROUND(LEAST(CAST(ac AS DOUBLE) / CAST(2 * n AS DOUBLE), 1 - CAST(ac AS DOUBLE) / CAST(2 * n AS DOUBLE)), 9) AS maf,
 ROUND(CAST(n - n_missing AS DOUBLE) / CAST(n AS DOUBLE), 9) AS call_rate FROM cnt, n)
"""
#: Sums of a group's genotype with the trait; the group is called k, rows come from x(k, sample_id, g).
SUMS = """, s AS (SELECT k, CAST(COALESCE(SUM(g), 0) AS BIGINT) AS ac, CAST(COALESCE(SUM(g * g), 0) AS BIGINT) AS sq, CAST(COALESCE(SUM(g * y), 0) AS BIGINT) AS gy,
 CAST(SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS miss, CAST(COALESCE(SUM(CASE WHEN g IS NULL THEN y END), 0) AS BIGINT) AS miss_y FROM x JOIN samples USING (sample_id) GROUP BY 1),
t AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(CAST(SUM(y) AS BIGINT) AS DOUBLE) AS sy, CAST(CAST(SUM(y * y) AS BIGINT) AS DOUBLE) AS qy FROM samples),
m AS (SELECT s.*, t.n, sy, (qy - sy * sy / n) / n AS s2, CAST(ac AS DOUBLE) / (n - miss) AS mean FROM s, t),
z AS (SELECT *, ac + miss * mean AS ss, gy + mean * miss_y - sy * (ac + miss * mean) / n AS u, sq + miss * mean * mean - (ac + miss * mean) * (ac + miss * mean) / n AS w FROM m),
r AS (SELECT *, CASE WHEN w > 1e-9 THEN u * u / (s2 * w) END AS st FROM z)
"""
SCORE = f"""SELECT k AS {{k}}, ac, sq, gy, miss, miss_y, ROUND(ss / (2 * n), 9) AS af, ROUND(u, 2) AS u_stat, ROUND(SQRT(s2 * w), 2) AS sqrt_v, ROUND(st, 6) AS stat,
 ROUND(CASE WHEN w > 1e-9 THEN u / w END, 4) AS effect, ROUND({chi2_1_sf_sql("st")}, 6) AS pvalue FROM r"""
MEMBERS = """, members AS (SELECT gene AS grp, variant_id FROM variants)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variants(spark, sf_dir).select(F.col("gene").alias("group"), "variant_id")


# ---- counters ------------------------------------------------------------------------------------------------------


@query("geno_counter", COUNTS + "SELECT * FROM freq")
def geno_counter(spark, sf_dir):
    return counter(spark, sf_dir)


@query("counter_by_sex_trait", """, sz AS (SELECT sex, trait, COUNT(*) AS n FROM samples GROUP BY 1, 2),
c AS (SELECT variant_id, sex, trait, CAST(SUM(CASE WHEN g = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_het, CAST(SUM(CASE WHEN g = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_alt,
 CAST(SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(COALESCE(SUM(g), 0) AS BIGINT) AS ac FROM calls JOIN samples USING (sample_id) GROUP BY 1, 2, 3)
SELECT c.*, sz.n, sz.n - n_het - n_alt - n_missing AS n_ref FROM c JOIN sz USING (sex, trait)""")
def counter_by_sex_trait(spark, sf_dir):
    return C.counter_by_stratum(V.calls(spark, sf_dir), V.samples(spark, sf_dir), ["sex", "trait"])


@query("control_frequency", """, own AS (SELECT sample_id FROM samples WHERE trait = 1),
c AS (SELECT variant_id, CAST(COALESCE(SUM(g), 0) AS BIGINT) AS ac, CAST(2 * ((SELECT COUNT(*) FROM own) - SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END)) AS BIGINT) AS an
 FROM calls JOIN own USING (sample_id) GROUP BY 1)
SELECT variant_id, ac, an, ROUND(CAST(ac + 1 AS DOUBLE) / CAST(an + 2 AS DOUBLE), 9) AS q FROM c""")
def control_frequency(spark, sf_dir):
    return rounded(C.control_frequency(V.calls(spark, sf_dir), V.samples(spark, sf_dir)), q=9)


HWE = """, lf AS (SELECT k, SUM(CASE WHEN k > 0 THEN LN(k) ELSE 0 END) OVER (ORDER BY k) AS lf FROM (SELECT UNNEST(range(0, (SELECT 2 * n + 1 FROM n))) AS k)),
h0 AS (SELECT variant_id, n_het, n_ref + n_het + n_alt AS n, n_het + 2 * LEAST(n_ref, n_alt) AS rare FROM freq),
h1 AS (SELECT *, UNNEST(range(rare % 2, rare + 1, 2)) AS h FROM h0),
h2 AS (SELECT h1.*, h * LN(2.0) - a.lf - b.lf - c.lf AS w FROM h1 JOIN lf a ON a.k = (rare - h) // 2 JOIN lf b ON b.k = h JOIN lf c ON c.k = h1.n - h - (rare - h) // 2),
h3 AS (SELECT variant_id, MAX(w) AS top, MAX(CASE WHEN h = n_het THEN w END) AS own FROM h2 GROUP BY 1),
hwe AS (SELECT variant_id, ROUND(LEAST(SUM(CASE WHEN w <= own + 1e-9 THEN EXP(w - top) ELSE 0 END) / SUM(EXP(w - top)), 1.0), 6) AS hwe_p FROM h2 JOIN h3 USING (variant_id) GROUP BY 1)
"""


@query("hwe_exact", COUNTS + HWE + "SELECT * FROM hwe")
def hwe_exact(spark, sf_dir):
    return rounded(C.hwe_exact(counter(spark, sf_dir)), hwe_p=6)


@query("quantity_summary", """, r AS (SELECT y, ROW_NUMBER() OVER (ORDER BY y) - 1 AS i, COUNT(*) OVER () AS n FROM samples)
SELECT MIN(y) AS minimum, MAX(CASE WHEN i = FLOOR(n * 0.25) THEN y END) AS q1, MAX(CASE WHEN i = FLOOR(n * 0.5) THEN y END) AS median,
 MAX(CASE WHEN i = FLOOR(n * 0.75) THEN y END) AS q3, MAX(y) AS maximum, ROUND(AVG(y), 4) AS mean, ROUND(VAR_SAMP(y), 2) AS variance FROM r""")
def quantity_summary(spark, sf_dir):
    return rounded(C.quantity_summary(V.samples(spark, sf_dir), "y"), mean=4, variance=2)


# ---- filters -------------------------------------------------------------------------------------------------------


@query("sample_include", " SELECT calls.* FROM calls WHERE sample_id IN (SELECT sample_id FROM samples WHERE trait = 2)")
def sample_include(spark, sf_dir):
    return L.include_samples(V.calls(spark, sf_dir), V.samples(spark, sf_dir).where("trait = 2").select("sample_id"))


@query("sample_exclude", " SELECT calls.* FROM calls WHERE sample_id NOT IN (SELECT sample_id FROM samples WHERE c1 < 12)")
def sample_exclude(spark, sf_dir):
    return L.exclude_samples(V.calls(spark, sf_dir), V.samples(spark, sf_dir).where("c1 < 12").select("sample_id"))


@query("sample_rename", " SELECT CASE WHEN sample_id % 10 = 0 THEN 'NEW' || sample_id ELSE CAST(sample_id AS VARCHAR) END AS sample_id, y, trait, sex FROM samples")
def sample_rename(spark, sf_dir):
    s = V.samples(spark, sf_dir).select("sample_id", "y", "trait", "sex")
    names = s.where("sample_id % 10 = 0").select(F.col("sample_id").alias("old_id"), F.concat(F.lit("NEW"), "sample_id").alias("new_id"))
    return L.rename_samples(s, names)


@query("site_semi", " SELECT variants.* FROM variants WHERE (chrom, pos) IN (SELECT chrom, pos FROM variants WHERE variant_id % 3 = 0)")
def site_semi(spark, sf_dir):
    v = V.variants(spark, sf_dir)
    return L.sites_in(v, v.where("variant_id % 3 = 0").select("chrom", "pos"))


@query("site_anti", " SELECT variants.* FROM variants WHERE (chrom, pos) NOT IN (SELECT chrom, pos FROM variants WHERE variant_id % 3 = 0)")
def site_anti(spark, sf_dir):
    v = V.variants(spark, sf_dir)
    return L.sites_not_in(v, v.where("variant_id % 3 = 0").select("chrom", "pos"))


@query("site_filters", " SELECT * FROM variants WHERE qual >= 905 AND filter = 'PASS' AND ref IN ('A','C','G','T') AND alt IN ('A','C','G','T') AND regexp_matches(anno, 'ECONOMY|STANDARD|PROMO') AND chrom BETWEEN 1 AND 26")
def site_filters(spark, sf_dir):
    return V.variants(spark, sf_dir).where(L.quality_at_least(905) & L.passing() & L.biallelic_snp() & L.annotated("ECONOMY|STANDARD|PROMO") & L.plink_chromosome())


@query("region_filter", " SELECT * FROM variants WHERE pos BETWEEN 5000 AND 90000 OR pos BETWEEN 150000 AND 160000")
def region_filter(spark, sf_dir):
    return V.variants(spark, sf_dir).where(L.in_regions([(5000, 90000), (150000, 160000)]))


@query("maf_filter", COUNTS + "SELECT variant_id, maf FROM freq WHERE maf BETWEEN 0.005 - 1e-10 AND 0.012 + 1e-10")
def maf_filter(spark, sf_dir):
    return counter(spark, sf_dir).where(L.frequency_between(0.005, 0.012)).select("variant_id", "maf")


@query("mac_filter", COUNTS + "SELECT variant_id, ac FROM freq, n WHERE LEAST(ac, 2 * (n - n_missing) - ac) >= 25")
def mac_filter(spark, sf_dir):
    n = size(spark, sf_dir)
    return counter(spark, sf_dir).where(L.minor_count_at_least(25, 2 * (F.lit(n) - F.col("n_missing")))).select("variant_id", "ac")


@query("gd_gq_mask", " SELECT variant_id, sample_id, CASE WHEN gd >= 10 AND gd <= 45 AND gq >= 2 THEN g END AS g, gd, gq FROM calls")
def gd_gq_mask(spark, sf_dir):
    return L.mask_genotypes(V.calls(spark, sf_dir), 10, 45, 2).select("variant_id", "sample_id", "g", "gd", "gq")


@query("site_depth", " SELECT variant_id, CAST(SUM(gd) AS BIGINT) AS depth FROM calls GROUP BY 1 HAVING SUM(gd) BETWEEN 500 AND 900")
def site_depth(spark, sf_dir):
    return L.site_depth(V.calls(spark, sf_dir), 500, 900)


@query("site_qc", COUNTS + HWE + "SELECT freq.*, hwe_p FROM freq JOIN hwe USING (variant_id) WHERE maf >= 0.0005 AND hwe_p >= 0.01 AND call_rate >= 0.999")
def site_qc(spark, sf_dir):
    counts = counter(spark, sf_dir)
    return L.site_qc(counts, rounded(C.hwe_exact(counts), hwe_p=6), 0.0005, 0.01, 0.999)


# ---- genotype cells ------------------------------------------------------------------------------------------------

CELL = "CASE WHEN g IS NULL THEN './.' WHEN g = 2 THEN '1/1' WHEN sample_id % 3 = 0 THEN '0|1' WHEN sample_id % 3 = 1 THEN '1' ELSE '0/1' END"


@query("gt_decode", f""", c AS (SELECT variant_id, sample_id, gd, {CELL} AS gt FROM calls)
SELECT variant_id, sample_id, gt, CAST(gd AS VARCHAR) AS gd, CASE gt WHEN '1/1' THEN 2 WHEN '0|1' THEN 1 WHEN '0/1' THEN 1 WHEN '1' THEN 1 END AS g,
 CASE gt WHEN '1/1' THEN 2 WHEN '1' THEN 2 END AS hemi, contains(gt, '|') AS phased, length(gt) = 1 AS haploid, contains(gt, '.') AS missing,
 CASE WHEN gt = './.' THEN NULL WHEN gt = '1/1' OR gt = '1' THEN 1 ELSE 0 END AS a1, CASE WHEN gt IN ('./.', '1') THEN NULL ELSE 1 END AS a2 FROM c""")
def gt_decode(spark, sf_dir):
    rows = V.calls(spark, sf_dir).select("variant_id", "sample_id", F.concat_ws(":", F.expr(CELL), F.col("gd").cast("string")).alias("cell"), F.lit("GT:GD").alias("form"))
    rows = rows.select("variant_id", "sample_id", G.field(F.col("cell"), F.col("form"), "GT").alias("gt"), G.field(F.col("cell"), F.col("form"), "GD").alias("gd"))
    gt = F.col("gt")
    return rows.select("variant_id", "sample_id", "gt", "gd", G.alt_count(gt).alias("g"), G.male_hemizygous(gt).alias("hemi"), G.is_phased(gt).alias("phased"), G.is_haploid(gt).alias("haploid"), G.is_missing(gt).alias("missing"), G.allele(gt, 0).alias("a1"), G.allele(gt, 1).alias("a2"))


@query("multi_allelic", """, v AS (SELECT variant_id, chrom, pos, ref, CASE WHEN variant_id % 5 = 0 THEN alt || ',' || ref || alt ELSE alt END AS alts FROM variants)
SELECT variant_id, chrom, pos, ref, CAST(k AS INTEGER) AS k, string_split(alts, ',')[k] AS alt FROM (SELECT *, UNNEST(range(1, len(string_split(alts, ',')) + 1)) AS k FROM v)""")
def multi_allelic(spark, sf_dir):
    v = V.variants(spark, sf_dir).select("variant_id", "chrom", "pos", "ref", F.expr("CASE WHEN variant_id % 5 = 0 THEN concat(alt, ',', ref, alt) ELSE alt END").alias("alt"))
    return G.split_alternatives(v)


@query("dosage_hard_call", """, p AS (SELECT variant_id, sample_id, gd / 100.0e0 AS p1, gq / 20.0e0 AS p2 FROM calls)
SELECT variant_id, sample_id, ROUND(p1 + 2 * p2, 9) AS dosage, CASE WHEN 1 - p1 - p2 >= p1 AND 1 - p1 - p2 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS call FROM p""")
def dosage_hard_call(spark, sf_dir):
    p = V.calls(spark, sf_dir).select("variant_id", "sample_id", (F.col("gd") / 100.0).alias("p1"), (F.col("gq") / 20.0).alias("p2"))
    probs = F.array(1 - F.col("p1") - F.col("p2"), F.col("p1"), F.col("p2"))
    return p.select("variant_id", "sample_id", F.round(G.dosage(F.col("p1"), F.col("p2")), 9).alias("dosage"), G.hard_call(probs).alias("call"))


@query("info_fields", " SELECT variant_id, CAST(pos AS VARCHAR) AS dp, CASE WHEN variant_id % 4 <> 0 THEN split_part(anno, ' ', 1) END AS anno, CAST(chrom AS VARCHAR) AS chrom, ref || alt IN ('AG','GA','CT','TC') AS transition FROM variants")
def info_fields(spark, sf_dir):
    v = V.variants(spark, sf_dir)
    info = F.concat(F.lit("DP="), F.col("pos").cast("string"), F.lit(";HM3"), F.expr("CASE WHEN variant_id % 4 <> 0 THEN concat(';ANNO=', split_part(anno, ' ', 1), ':', gene) ELSE '' END"))
    v = v.withColumns({"info": info, "chrom": F.concat(F.lit("chr"), F.col("chrom").cast("string"))})
    return v.select("variant_id", G.info_value(F.col("info"), "DP").alias("dp"), G.annotation(F.col("info")).alias("anno"), G.chop_chr(F.col("chrom")).alias("chrom"), G.is_transition().alias("transition"))


# ---- imputation and recoding ---------------------------------------------------------------------------------------


@query("impute_mean", COUNTS + "SELECT variant_id, sample_id, ROUND(COALESCE(CAST(g AS DOUBLE), CAST(ac AS DOUBLE) / CAST(n - n_missing AS DOUBLE)), 9) AS g, gd, gq FROM calls JOIN freq USING (variant_id), n")
def impute_mean(spark, sf_dir):
    return rounded(I.impute_mean(V.calls(spark, sf_dir), size(spark, sf_dir)), g=9)


@query("impute_hwe")
def impute_hwe(spark, sf_dir):
    return I.impute_hwe(V.calls(spark, sf_dir), size(spark, sf_dir))


@query("impute_drop", MEMBERS + """, x AS (SELECT variant_id, sample_id, g, grp FROM calls JOIN members USING (variant_id))
SELECT grp AS "group", sample_id, variant_id, g FROM x WHERE (grp, sample_id) NOT IN (SELECT (grp, sample_id) FROM x WHERE g IS NULL)""")
def impute_drop(spark, sf_dir):
    return I.drop_incomplete(V.calls(spark, sf_dir).select("variant_id", "sample_id", "g"), members(spark, sf_dir))


@query("polymorphic", COUNTS + "SELECT variant_id, n_het, n_alt, n_missing, ac FROM freq WHERE CAST(n_ref > 0 AS INT) + CAST(n_het > 0 AS INT) + CAST(n_alt > 0 AS INT) > 1")
def polymorphic(spark, sf_dir):
    return I.polymorphic(V.calls(spark, sf_dir).groupBy("variant_id").agg(*C.tally()), size(spark, sf_dir))


@query("flip_minor", """, x AS (SELECT variant_id, sample_id, 2 - g AS g FROM calls),
c AS (SELECT variant_id, CAST(SUM(g) AS BIGINT) AS s, CAST(SUM(g * g) AS BIGINT) AS q, CAST(COUNT(g) AS BIGINT) AS k FROM x GROUP BY 1 HAVING COUNT(g) > 0)
SELECT variant_id, s > k AS flipped, CASE WHEN s > k THEN 2 * k - s ELSE s END AS minor, CASE WHEN s > k THEN 4 * k - 4 * s + q ELSE q END AS minor_sq FROM c""")
def flip_minor(spark, sf_dir):
    rows = V.calls(spark, sf_dir).where("g IS NOT NULL").withColumn("g", 2 - F.col("g"))
    counts = rows.groupBy("variant_id").agg(*C.tally(), F.count("*").alias("k"))
    # each variant's own callers are its samples here
    s, q, m = F.col("ac"), F.col("n_het") + 4 * F.col("n_alt"), F.col("k")
    flip = s > m
    return counts.select("variant_id", flip.alias("flipped"), F.when(flip, 2 * m - s).otherwise(s).alias("minor"), F.when(flip, 4 * m - 4 * s + q).otherwise(q).alias("minor_sq"))


@query("flip_minor_full", COUNTS + """SELECT variant_id, ac > n - n_missing AS flipped, CASE WHEN ac > n - n_missing THEN 2 * (n - n_missing) - ac ELSE ac END AS minor,
 CASE WHEN ac > n - n_missing THEN 4 * (n - n_missing) - 4 * ac + n_het + 4 * n_alt ELSE n_het + 4 * n_alt END AS minor_sq FROM freq, n""")
def flip_minor_full(spark, sf_dir):
    return I.flip_to_minor(V.calls(spark, sf_dir).groupBy("variant_id").agg(*C.tally()), size(spark, sf_dir))


def _recode_sql(k):
    return f""", x AS (SELECT variant_id, sample_id, g, CASE WHEN g >= {k} THEN 1 WHEN g IS NOT NULL THEN 0 END AS x FROM calls),
m AS (SELECT variant_id, CAST(SUM(x) AS DOUBLE) / CAST((SELECT n FROM n) - SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS mean FROM x GROUP BY 1)
SELECT variant_id, sample_id, ROUND(COALESCE(CAST(x AS DOUBLE), mean), 9) AS x FROM x JOIN m USING (variant_id)"""


@query("dominant_code", _recode_sql(1))
def dominant_code(spark, sf_dir):
    return rounded(I.recode(V.calls(spark, sf_dir), size(spark, sf_dir), 1), x=9)


@query("recessive_code", _recode_sql(2))
def recessive_code(spark, sf_dir):
    return rounded(I.recode(V.calls(spark, sf_dir), size(spark, sf_dir), 2), x=9)


# ---- phenotypes ----------------------------------------------------------------------------------------------------


@query("trait_type", " SELECT 'BINARY' AS trait_type, COUNT(trait) AS n FROM samples UNION ALL SELECT 'QUANTITATIVE', COUNT(y) FROM samples")
def trait_type(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    return P.trait_type(s, "trait").unionAll(P.trait_type(s, "y"))


@query("binary_recode", " SELECT sample_id, trait - 1 AS trait FROM samples WHERE trait IN (1, 2)")
def binary_recode(spark, sf_dir):
    return P.recode_binary(V.samples(spark, sf_dir), "trait").select("sample_id", "trait")


@query("residual_trait", " SELECT sample_id, ROUND(y - regr_intercept(y, c1) OVER () - regr_slope(y, c1) OVER () * c1, 2) AS residual FROM samples")
def residual_trait(spark, sf_dir):
    return P.residualise(V.samples(spark, sf_dir), "y", ["c1"]).select("sample_id", F.round("residual", 2).alias("residual"))


@query("inverse_normal", f""", r AS (SELECT sample_id, (RANK() OVER (ORDER BY y) - 1 + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0e0 + 0.5e0) / COUNT(*) OVER () AS p FROM samples)
SELECT sample_id, ROUND({normal_quantile_sql("p")}, 6) AS z FROM r""")
def inverse_normal(spark, sf_dir):
    return P.inverse_normal(V.samples(spark, sf_dir), "y").select("sample_id", F.round("z", 6).alias("z"))


@query("impute_trait", """, x AS (SELECT sample_id, CASE WHEN sample_id % 11 <> 0 THEN y END AS y FROM samples)
SELECT sample_id, ROUND(COALESCE(CAST(y AS DOUBLE), (SELECT AVG(y) FROM x)), 4) AS y FROM x""")
def impute_trait(spark, sf_dir):
    x = V.samples(spark, sf_dir).select("sample_id", F.when(F.col("sample_id") % 11 != 0, F.col("y")).alias("y"))
    return P.impute_column(x, "y").select("sample_id", F.round("y", 4).alias("y"))


@query("covariate_check", " SELECT 'c1' AS covariate, ROUND(corr(c1, y), 6) AS r, COUNT(DISTINCT c1) <= 1 AS constant FROM samples UNION ALL SELECT 'c2', ROUND(corr(c2, y), 6), COUNT(DISTINCT c2) <= 1 FROM samples")
def covariate_check(spark, sf_dir):
    return rounded(P.covariate_check(V.samples(spark, sf_dir), "y", ["c1", "c2"]), r=6).drop("independent")


@query("unique_samples", " SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING COUNT(*) = 1)")
def unique_samples(spark, sf_dir):
    return P.unique_only(V.read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey")


# ---- single-variant association -------------------------------------------------------------------------------------


@query("score_qtl", ", x AS (SELECT variant_id AS k, sample_id, g FROM calls)" + SUMS + SCORE.format(k="variant_id"))
def score_qtl(spark, sf_dir):
    return scored(V.calls(spark, sf_dir), V.samples(spark, sf_dir))


WALD = f""", w1 AS (SELECT *, sq - CAST(ac AS DOUBLE) * ac / n AS sxx, gy - sy * ac / n AS sxy, s2 * n AS syy FROM m),
w2 AS (SELECT k, CASE WHEN sxx > 1e-9 THEN sxy / sxx END AS b, CASE WHEN sxx > 1e-9 THEN SQRT((syy - sxy * sxy / sxx) / n / sxx) END AS se FROM w1)
SELECT k AS variant_id, ROUND(b, 4) AS beta, ROUND(se, 4) AS se, ROUND({chi2_1_sf_sql("((b / se) * (b / se))")}, 6) AS pvalue FROM w2"""


@query("wald_linear", ", x AS (SELECT variant_id AS k, sample_id, g FROM c0)" + SUMS + WALD)
def wald_linear(spark, sf_dir):
    samples = V.samples(spark, sf_dir)
    return rounded(A.wald_linear(A.group_sums(V.calls(spark, sf_dir, complete=True), samples), *A.trait_sums(samples)), beta=4, se=4, pvalue=6).drop("log10p")


def _two(per, x):
    return f""", sz AS (SELECT COUNT(*) FILTER (trait = 1) AS c, COUNT(*) FILTER (trait = 2) AS a FROM samples),
tt AS (SELECT k, CAST(COALESCE(SUM(CASE WHEN trait = 1 THEN {x} END), 0) AS BIGINT) AS n01, CAST(COALESCE(SUM(CASE WHEN trait = 2 THEN {x} END), 0) AS BIGINT) AS n11,
 {per} * COUNT(*) FILTER (trait = 1 AND g IS NULL) AS m0, {per} * COUNT(*) FILTER (trait = 2 AND g IS NULL) AS m1 FROM x JOIN samples USING (sample_id) GROUP BY 1),
tab AS (SELECT k, {per} * c - n01 - m0 AS n00, n01, {per} * a - n11 - m1 AS n10, n11 FROM tt, sz)"""


FISHER = """, lf AS (SELECT k, SUM(CASE WHEN k > 0 THEN LN(k) ELSE 0 END) OVER (ORDER BY k) AS lf FROM (SELECT UNNEST(range(0, (SELECT 2 * n + 1 FROM n))) AS k)),
g1 AS (SELECT *, n00 + n01 AS r0, n10 + n11 AS r1, n01 + n11 AS kk FROM tab),
g2 AS (SELECT *, UNNEST(range(GREATEST(0, kk - r1), LEAST(kk, r0) + 1)) AS v FROM g1),
g3 AS (SELECT g2.*, -a.lf - b.lf - c.lf - d.lf AS w FROM g2 JOIN lf a ON a.k = v JOIN lf b ON b.k = r0 - v JOIN lf c ON c.k = kk - v JOIN lf d ON d.k = r1 - kk + v),
g4 AS (SELECT k, MAX(w) AS top, MAX(CASE WHEN v = n01 THEN w END) AS own FROM g3 GROUP BY 1)
SELECT k AS {k}, ROUND(LEAST(SUM(CASE WHEN w <= own + 1e-9 THEN EXP(w - top) ELSE 0 END) / SUM(EXP(w - top)), 1.0), 6) AS p_two_side,
 ROUND(LEAST(SUM(CASE WHEN v >= n01 THEN EXP(w - top) ELSE 0 END) / SUM(EXP(w - top)), 1.0), 6) AS p_less,
 ROUND(LEAST(SUM(CASE WHEN v <= n01 THEN EXP(w - top) ELSE 0 END) / SUM(EXP(w - top)), 1.0), 6) AS p_greater FROM g3 JOIN g4 USING (k) GROUP BY 1"""
BY_VARIANT = ", x AS (SELECT variant_id AS k, sample_id, g FROM calls)"


@query("allelic_table", BY_VARIANT + _two(2, "g") + "SELECT k AS variant_id, n00, n01, n10, n11 FROM tab")
def allelic_table(spark, sf_dir):
    return A.two_by_two(V.calls(spark, sf_dir), V.samples(spark, sf_dir))


@query("fisher_allelic", BY_VARIANT + _two(2, "g") + FISHER.replace("{k}", "variant_id"))
def fisher_allelic(spark, sf_dir):
    return rounded(A.fisher(A.two_by_two(V.calls(spark, sf_dir), V.samples(spark, sf_dir))), p_two_side=6, p_less=6, p_greater=6)


@query("fisher_dominant", BY_VARIANT + _two(1, "CASE WHEN g > 0 THEN 1 WHEN g IS NOT NULL THEN 0 END") + FISHER.replace("{k}", "variant_id"))
def fisher_dominant(spark, sf_dir):
    return rounded(A.fisher(A.two_by_two(V.calls(spark, sf_dir), V.samples(spark, sf_dir), carriers=True)), p_two_side=6, p_less=6, p_greater=6)


@query("single_dummy", " SELECT variant_id, COUNT(g) AS n_count, MIN(g) AS minimum, MAX(g) AS maximum FROM calls GROUP BY 1")
def single_dummy(spark, sf_dir):
    return V.calls(spark, sf_dir).groupBy("variant_id").agg(F.count("g").alias("n_count"), F.min("g").alias("minimum"), F.max("g").alias("maximum"))


TRAITS = """, p AS (SELECT sample_id, 'y' AS trait_name, y FROM samples UNION ALL SELECT sample_id, 'c1', c1 FROM samples UNION ALL SELECT sample_id, 'c2', c2 FROM samples),
t AS (SELECT trait_name, CAST(COUNT(*) AS DOUBLE) AS n, CAST(CAST(SUM(y) AS BIGINT) AS DOUBLE) AS sy, CAST(CAST(SUM(y * y) AS BIGINT) AS DOUBLE) AS qy FROM p GROUP BY 1),
s AS (SELECT variant_id, trait_name, CAST(SUM(g) AS BIGINT) AS s, CAST(SUM(g * g) AS BIGINT) AS q, CAST(SUM(g * y) AS BIGINT) AS gy FROM c0 JOIN p USING (sample_id) GROUP BY 1, 2)
SELECT variant_id, trait_name, ROUND(gy - sy * s / n, 2) AS u_stat, ROUND((qy - sy * sy / n) / n * (q - CAST(s AS DOUBLE) * s / n), 2) AS v_stat FROM s JOIN t USING (trait_name)"""


@query("multi_trait_score", TRAITS)
def multi_trait_score(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    long = s.select("sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("trait_name"), F.col(c).cast("long").alias("y")) for c in ("y", "c1", "c2")])).alias("t")).select("sample_id", "t.*")
    totals = long.groupBy("trait_name").agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("sy"), F.sum(F.col("y") * F.col("y")).cast("double").alias("qy"))
    # one row a variant, not one a variant and trait, until its sums are complete
    products = F.array(*[F.struct(F.lit(c).alias("trait_name"), F.sum(F.col("g") * F.col(c)).cast("double").alias("gy")) for c in ("y", "c1", "c2")])
    calls, rows = V.calls(spark, sf_dir, complete=True), V.read(spark, sf_dir, "lineitem").count()
    met = V.dealt(calls.select("variant_id", "sample_id", "g"), rows, "sample_id").join(V.dealt(s, rows, "sample_id"), "sample_id")
    sums = V.dealt(met.select("variant_id", "g", "y", "c1", "c2"), rows, "variant_id").groupBy("variant_id").agg(F.sum("g").cast("double").alias("s"), F.sum(F.col("g") * F.col("g")).cast("double").alias("q"), products.alias("t"))
    sums = sums.select("variant_id", "s", "q", F.explode("t").alias("t")).select("variant_id", "s", "q", "t.*")
    out = sums.join(F.broadcast(totals), "trait_name")  # one row a trait
    v = (F.col("qy") - F.col("sy") * F.col("sy") / F.col("n")) / F.col("n") * (F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    return out.select("variant_id", "trait_name", F.round(F.col("gy") - F.col("sy") * F.col("s") / F.col("n"), 2).alias("u_stat"), F.round(v, 2).alias("v_stat"))


@query("meta_score", COUNTS + HWE + ", x AS (SELECT variant_id AS k, sample_id, g FROM calls)" + SUMS + """SELECT variant_id, af, freq.ac AS informative_alt_ac, call_rate, hwe_p, n_ref, n_het, n_alt, ROUND(u / s2, 6) AS u_scaled,
 ROUND(SQRT(w / s2), 6) AS sqrt_v_scaled, ROUND(st, 6) AS stat FROM freq JOIN hwe USING (variant_id) JOIN r ON r.k = variant_id""")
def meta_score(spark, sf_dir):
    samples = V.samples(spark, sf_dir)
    out = A.meta_score(V.calls(spark, sf_dir), samples, *A.trait_sums(samples))
    out = out.join(C.hwe_exact(out), "variant_id")
    out = rounded(out, af=9, call_rate=9, hwe_p=6, u_scaled=6, sqrt_v_scaled=6, stat=6)
    return out.select("variant_id", "af", F.col("ac").alias("informative_alt_ac"), "call_rate", "hwe_p", "n_ref", "n_het", "n_alt", "u_scaled", "sqrt_v_scaled", "stat")


# ---- ranges and groups ----------------------------------------------------------------------------------------------


@query("range_join_gene", " SELECT genes.gene AS range_gene, variant_id, variants.gene, variants.chrom, pos, beg, fin AS \"end\" FROM variants JOIN genes ON variants.chrom = genes.chrom AND pos BETWEEN beg AND fin")
def range_join_gene(spark, sf_dir):
    out = R.range_join(V.variants(spark, sf_dir).select("variant_id", "gene", "chrom", "pos"), V.genes(spark, sf_dir))
    return out.select("range_gene", "variant_id", "gene", "chrom", "pos", "beg", "end")


@query("merge_ranges", """, i AS (SELECT chrom, beg, fin, MAX(fin) OVER (PARTITION BY chrom ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT chrom, pos - pos % 7000 AS beg, pos + 9000 AS fin FROM variants)),
j AS (SELECT *, SUM(CASE WHEN seen IS NULL OR beg > seen THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY beg, fin ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT chrom, MIN(beg) AS beg, MAX(fin) AS "end" FROM j GROUP BY chrom, island""")
def merge_ranges(spark, sf_dir):
    return R.merge_ranges(V.variants(spark, sf_dir).select("chrom", (F.col("pos") - F.col("pos") % 7000).alias("beg"), (F.col("pos") + 9000).alias("end")))


@query("mark_sites", " SELECT variant_id, chrom, pos, (chrom, pos) IN (SELECT chrom, pos FROM variants WHERE variant_id % 4 = 0) AS known FROM variants")
def mark_sites(spark, sf_dir):
    v = V.variants(spark, sf_dir).select("variant_id", "chrom", "pos")
    return R.mark(v, v.where("variant_id % 4 = 0"), "known")


@query("band_join", " SELECT a.variant_id AS a, b.variant_id AS b, b.pos - a.pos AS distance FROM variants a JOIN variants b ON a.chrom = b.chrom AND b.pos BETWEEN a.pos AND a.pos + 60000")
def band_join(spark, sf_dir):
    v = V.variants(spark, sf_dir).select("variant_id", "chrom", "pos")
    return R.band_join(v, 60000).select(F.col("a_variant_id").alias("a"), F.col("b_variant_id").alias("b"), (F.col("b_pos") - F.col("a_pos")).alias("distance"))


CMC = MEMBERS + ", x AS (SELECT grp AS k, sample_id, CAST(MAX(1) AS INTEGER) AS g FROM calls JOIN members USING (variant_id) WHERE g > 0 GROUP BY 1, 2)"
ZEG = MEMBERS + ", x AS (SELECT grp AS k, sample_id, CAST(COUNT(*) AS INTEGER) AS g FROM calls JOIN members USING (variant_id) WHERE g > 0 GROUP BY 1, 2)"


@query("cmc_collapse", CMC + 'SELECT k AS "group", sample_id, g FROM x')
def cmc_collapse(spark, sf_dir):
    return A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "cmc")


@query("cmc_score", CMC + SUMS + SCORE.format(k='"group"'))
def cmc_score(spark, sf_dir):
    return scored(A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "cmc"), V.samples(spark, sf_dir), "group")


@query("zeggini_score", ZEG + SUMS + SCORE.format(k='"group"'))
def zeggini_score(spark, sf_dir):
    return scored(A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "zeggini"), V.samples(spark, sf_dir), "group")


@query("cmc_wald", CMC + SUMS + WALD.replace("k AS variant_id", 'k AS variant_id'))
def cmc_wald(spark, sf_dir):
    samples = V.samples(spark, sf_dir)
    x = A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "cmc")
    out = A.wald_linear(A.group_sums(x, samples, "group"), *A.trait_sums(samples), group="group")
    return rounded(out, beta=4, se=4, pvalue=6).drop("log10p").withColumnRenamed("group", "variant_id")


@query("exact_cmc", CMC + _two(1, "CASE WHEN g > 0 THEN 1 WHEN g IS NOT NULL THEN 0 END") + FISHER.replace("{k}", '"group"'))
def exact_cmc(spark, sf_dir):
    x = A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "cmc")
    return rounded(A.fisher(A.two_by_two(x, V.samples(spark, sf_dir), carriers=True, group="group"), "group"), p_two_side=6, p_less=6, p_greater=6)


MB = MEMBERS + """, own AS (SELECT sample_id FROM samples WHERE trait = 1),
q AS (SELECT variant_id, ROUND(CAST(COALESCE(SUM(g), 0) + 1 AS DOUBLE) / CAST(2 * ((SELECT COUNT(*) FROM own) - SUM(CASE WHEN g IS NULL THEN 1 ELSE 0 END)) + 2 AS DOUBLE), 9) AS q FROM calls JOIN own USING (sample_id) GROUP BY 1),
w AS (SELECT variant_id, ROUND(1.0 / SQRT(n * q * (1 - q)), 9) AS w FROM q, n)"""
FP = COUNTS + MEMBERS + """, w AS (SELECT variant_id, ROUND(1.0 / SQRT(af * (1 - af)), 9) AS w FROM freq WHERE af > 0 AND af < 1)"""
#: Weights as whole multiples of 1e-9, so that both engines add integers and divide once.
BURDEN = """SELECT grp AS "group", sample_id, CAST(SUM(g * CAST(ROUND(w * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 AS burden FROM calls JOIN members USING (variant_id) JOIN w USING (variant_id) WHERE g > 0 GROUP BY 1, 2"""


def mb_weights(spark, sf_dir):
    q = rounded(C.control_frequency(V.calls(spark, sf_dir), V.samples(spark, sf_dir)), q=9)
    return rounded(A.madsen_browning_weights(q, size(spark, sf_dir)), w=9)


def fp_weights(spark, sf_dir):
    return rounded(A.fp_weights(counter(spark, sf_dir)), w=9)


def burden(spark, sf_dir, w):
    w = w.select("variant_id", F.round(F.col("w") * 1e9).cast("long").alias("w"))
    return A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "weighted", w).select("group", "sample_id", (F.col("g").cast("double") / 1e9).alias("g"))


@query("mb_weight", MB + "SELECT * FROM w")
def mb_weight(spark, sf_dir):
    return mb_weights(spark, sf_dir)


@query("mb_burden", MB + BURDEN)
def mb_burden(spark, sf_dir):
    return burden(spark, sf_dir, mb_weights(spark, sf_dir)).withColumnRenamed("g", "burden")


@query("fp_burden", FP + BURDEN)
def fp_burden(spark, sf_dir):
    return burden(spark, sf_dir, fp_weights(spark, sf_dir)).withColumnRenamed("g", "burden")


@query("skat_q", MEMBERS + ", x AS (SELECT variant_id AS k, sample_id, g FROM calls)" + SUMS + """, q AS (SELECT k, 25.0e0 * POW(1.0e0 - LEAST(ss / (2 * n), 1.0e0 - ss / (2 * n)), 24.0e0) AS b, u FROM z WHERE ac > 0)
SELECT grp AS "group", COUNT(*) AS n_variants, ROUND(LN(SUM(b * b * u * u)), 6) AS log_q FROM q JOIN members ON k = variant_id GROUP BY 1""")
def skat_q(spark, sf_dir):
    out = A.skat_q(V.calls(spark, sf_dir), V.samples(spark, sf_dir), members(spark, sf_dir))
    return out.select("group", "n_variants", F.round(F.ln("q"), 6).alias("log_q"))


@query("cmat_stat", MEMBERS + BY_VARIANT + _two(2, "g") + """, gsum AS (SELECT grp, CAST(COUNT(*) AS DOUBLE) AS l, CAST(SUM(n11) AS DOUBLE) AS ma, CAST(SUM(n10) AS DOUBLE) AS ra, CAST(SUM(n01) AS DOUBLE) AS mu, CAST(SUM(n00) AS DOUBLE) AS ru FROM tab JOIN members ON k = variant_id GROUP BY 1)
SELECT grp AS "group", ROUND(CAST(a + c AS DOUBLE) / (2.0e0 * a * c * l) * (ma * ru - mu * ra) * (ma * ru - mu * ra) / ((ma + mu) * (ra + ru)), 6) AS stat FROM gsum, sz""")
def cmat_stat(spark, sf_dir):
    return rounded(A.cmat(V.calls(spark, sf_dir), V.samples(spark, sf_dir), members(spark, sf_dir)), stat=6)


VT = COUNTS + MEMBERS + """, f AS (SELECT grp, variant_id, CEIL(maf * 1000000) / 1000000 AS f FROM freq JOIN members USING (variant_id) WHERE maf > 0), st AS (SELECT DISTINCT grp, f AS threshold FROM f)"""


@query("vt_threshold", VT + """, c AS (SELECT grp, sample_id, MIN(f) AS f FROM calls JOIN f USING (variant_id) WHERE g > 0 GROUP BY 1, 2)
SELECT grp AS "group", threshold, COUNT(*) AS carriers, CAST(SUM(y) AS BIGINT) AS sum_y FROM c JOIN st USING (grp) JOIN samples USING (sample_id) WHERE f <= threshold GROUP BY 1, 2""")
def vt_threshold(spark, sf_dir):
    calls = V.calls(spark, sf_dir)
    return A.thresholds(calls, members(spark, sf_dir), counter(spark, sf_dir, calls), V.samples(spark, sf_dir))


@query("vt_price", VT + """, c AS (SELECT grp, threshold, sample_id, CAST(SUM(g) AS BIGINT) AS g FROM calls JOIN f USING (variant_id) JOIN st USING (grp) WHERE g > 0 AND f <= threshold GROUP BY 1, 2, 3),
u AS (SELECT grp, threshold, CAST(SUM(g) AS DOUBLE) AS s, CAST(SUM(g * g) AS DOUBLE) AS q, CAST(SUM(g * y) AS DOUBLE) AS gy FROM c JOIN samples USING (sample_id) GROUP BY 1, 2),
t AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(y) AS DOUBLE) AS sy FROM samples),
zz AS (SELECT grp, threshold, ROUND(ABS(gy - sy * s / n) / SQRT(q / n - (s / n) * (s / n)), 4) AS z FROM u, t)
SELECT grp AS "group", FIRST(threshold ORDER BY z DESC, threshold) AS opt_freq, MAX(z) AS zmax FROM zz GROUP BY 1""")
def vt_price(spark, sf_dir):
    calls, samples = V.calls(spark, sf_dir), V.samples(spark, sf_dir)
    n, sy, _ = A.trait_sums(samples)
    return A.price(calls, samples, members(spark, sf_dir), counter(spark, sf_dir, calls), n, sy, digits=4)


@query("kbac_patterns", MEMBERS + """, p AS (SELECT grp, sample_id, trait, string_agg(variant_id || ':' || g, ',' ORDER BY variant_id || ':' || g) AS pattern FROM calls JOIN members USING (variant_id) JOIN samples USING (sample_id) WHERE g > 0 GROUP BY 1, 2, 3)
SELECT grp AS "group", pattern, COUNT(*) FILTER (trait = 1) AS n_control, COUNT(*) FILTER (trait = 2) AS n_case FROM p GROUP BY 1, 2""")
def kbac_patterns(spark, sf_dir):
    return A.patterns(V.calls(spark, sf_dir), V.samples(spark, sf_dir), members(spark, sf_dir))


# ---- linkage and windows ---------------------------------------------------------------------------------------------

LD = """, sm AS (SELECT variant_id, CAST(SUM(g) AS BIGINT) AS s, CAST(SUM(g * g) AS BIGINT) AS q FROM c0 GROUP BY 1),
site AS (SELECT variant_id, chrom, pos, s, q FROM variants JOIN sm USING (variant_id)),
pr AS (SELECT a.variant_id AS a, b.variant_id AS b, a.chrom, a.pos AS a_pos, b.pos AS b_pos, a.s AS sa, b.s AS sb, a.q AS qa, b.q AS qb FROM site a JOIN site b ON a.chrom = b.chrom AND b.pos BETWEEN a.pos AND a.pos + {w} AND (a.pos < b.pos OR a.variant_id = b.variant_id)),
sh AS (SELECT a, b, CAST(SUM(x.g * y.g) AS BIGINT) AS sab FROM pr JOIN c0 x ON x.variant_id = a JOIN c0 y ON y.variant_id = b AND x.sample_id = y.sample_id GROUP BY 1, 2),
cv AS (SELECT pr.* EXCLUDE (sab), COALESCE(sab, 0) AS sab, CAST(COALESCE(sab, 0) AS DOUBLE) / n - CAST(sa AS DOUBLE) / n * (CAST(sb AS DOUBLE) / n) AS cov, CAST(qa AS DOUBLE) / n - CAST(sa AS DOUBLE) / n * (CAST(sa AS DOUBLE) / n) AS va,
 CAST(qb AS DOUBLE) / n - CAST(sb AS DOUBLE) / n * (CAST(sb AS DOUBLE) / n) AS vb FROM (SELECT pr.*, sab FROM pr LEFT JOIN sh USING (a, b)) pr, n)
"""


@query("ld_window", LD.replace("{w}", "60000") + "SELECT a, b, chrom AS a_chrom, a_pos, b_pos, sab, ROUND(cov, 9) AS cov, ROUND(CASE WHEN va < 1e-20 OR vb < 1e-20 THEN 0.0 ELSE cov / SQRT(va * vb) END, 6) AS r FROM cv")
def ld_window(spark, sf_dir):
    return rounded(D.covariances(V.calls(spark, sf_dir, complete=True), V.variants(spark, sf_dir), 60000, size(spark, sf_dir)), cov=9, r=6)


@query("meta_cov_window", LD.replace("{w}", "60000") + """SELECT a, chrom, a_pos AS start_pos, MAX(b_pos) AS end_pos, COUNT(*) AS num_marker, string_agg(CAST(b_pos AS VARCHAR), ',' ORDER BY b_pos, b) AS marker_pos,
 string_agg(CAST(CAST(ROUND(ROUND(cov, 9) * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY b_pos, b) AS cov_e9 FROM cv GROUP BY 1, 2, 3""")
def meta_cov_window(spark, sf_dir):
    return D.window_rows(D.covariances(V.calls(spark, sf_dir, complete=True), V.variants(spark, sf_dir), 60000, size(spark, sf_dir)))


@query("ld_anchor", """, p AS (SELECT a.variant_id AS a, b.variant_id AS b FROM variants a, variants b WHERE a.variant_id IN (3, 17))
SELECT a, b, CAST(SUM(x.g * y.g) AS BIGINT) AS sab, COUNT(*) FILTER (x.g = 1 AND y.g = 1) AS n11, COUNT(*) FILTER (x.g = 1 AND y.g = 2) AS n12, COUNT(*) FILTER (x.g = 2 AND y.g = 1) AS n21, COUNT(*) FILTER (x.g = 2 AND y.g = 2) AS n22
FROM p JOIN c0 x ON x.variant_id = a JOIN c0 y ON y.variant_id = b AND x.sample_id = y.sample_id GROUP BY 1, 2""")
def ld_anchor(spark, sf_dir):
    v = V.variants(spark, sf_dir).select("variant_id")
    anchors = spark.createDataFrame([(3,), (17,)], "a long")  # the listed anchors
    return D.pair_products(V.calls(spark, sf_dir, complete=True), v.withColumnRenamed("variant_id", "b").join(F.broadcast(anchors)))


@query("ld_gene", MEMBERS + """, p AS (SELECT x.variant_id AS a, y.variant_id AS b FROM members x JOIN members y ON x.grp = y.grp AND x.variant_id <= y.variant_id)
SELECT a, b, CAST(SUM(x.g * y.g) AS BIGINT) AS sab, COUNT(*) FILTER (x.g = 1 AND y.g = 1) AS n11, COUNT(*) FILTER (x.g = 1 AND y.g = 2) AS n12, COUNT(*) FILTER (x.g = 2 AND y.g = 1) AS n21, COUNT(*) FILTER (x.g = 2 AND y.g = 2) AS n22
FROM p JOIN c0 x ON x.variant_id = a JOIN c0 y ON y.variant_id = b AND x.sample_id = y.sample_id GROUP BY 1, 2""")
def ld_gene(spark, sf_dir):
    return D.group_products(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir)).drop("group")


@query("ld_gene_full", MEMBERS + """, p AS (SELECT x.grp, x.variant_id AS a, y.variant_id AS b FROM members x JOIN members y ON x.grp = y.grp AND x.variant_id <= y.variant_id)
SELECT grp AS "group", a, b, CAST(SUM(x.g * y.g) AS BIGINT) AS sab, COUNT(*) FILTER (x.g = 1 AND y.g = 1) AS n11, COUNT(*) FILTER (x.g = 1 AND y.g = 2) AS n12, COUNT(*) FILTER (x.g = 2 AND y.g = 1) AS n21, COUNT(*) FILTER (x.g = 2 AND y.g = 2) AS n22
FROM p JOIN c0 x ON x.variant_id = a JOIN c0 y ON y.variant_id = b AND x.sample_id = y.sample_id GROUP BY 1, 2, 3""")
def ld_gene_full(spark, sf_dir):
    return D.group_products(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir))


@query("ld_neighbor", """, car AS (SELECT variant_id, COUNT(*) AS c FROM c0 GROUP BY 1),
l AS (SELECT variant_id AS b, c, LAG(variant_id) OVER w AS a, LAG(c) OVER w AS ca FROM variants JOIN car USING (variant_id) WINDOW w AS (PARTITION BY chrom ORDER BY pos, variant_id)),
sh AS (SELECT a, b, COUNT(*) AS n11 FROM l JOIN c0 x ON x.variant_id = a JOIN c0 y ON y.variant_id = b AND x.sample_id = y.sample_id GROUP BY 1, 2),
k AS (SELECT l.a, l.b, COALESCE(n11, 0) AS n11, CAST(COALESCE(n11, 0) AS DOUBLE) / n AS p11, CAST(ca AS DOUBLE) / n AS pa, CAST(c AS DOUBLE) / n AS pb FROM l LEFT JOIN sh ON l.a = sh.a AND l.b = sh.b, n WHERE l.a IS NOT NULL),
d AS (SELECT *, p11 - pa * pb AS d, CASE WHEN p11 - pa * pb > 0 THEN LEAST(pa * (1 - pb), (1 - pa) * pb) ELSE LEAST(pa * pb, (1 - pa) * (1 - pb)) END AS top, SQRT(pa * (1 - pa) * pb * (1 - pb)) AS sc FROM k)
SELECT a, b, n11, ROUND(d, 9) AS d, ROUND(CASE WHEN top > 0 THEN d / top END, 6) AS d_prime, ROUND(CASE WHEN sc > 0 THEN d / sc END, 6) AS r FROM d""")
def ld_neighbor(spark, sf_dir):
    return rounded(D.neighbours(V.calls(spark, sf_dir, complete=True), V.variants(spark, sf_dir), size(spark, sf_dir)), d=9, d_prime=6, r=6)


# ---- kinship ---------------------------------------------------------------------------------------------------------

SHARED = ", o AS (SELECT variant_id, sample_id, g FROM c0), nv AS (SELECT COUNT(*) AS nv FROM variants)"


@query("ibs_kinship", SHARED + """, mg AS (SELECT sample_id, SUM(g) AS s FROM o GROUP BY 1),
sh AS (SELECT x.sample_id AS i, y.sample_id AS j, SUM(LEAST(x.g, y.g)) AS m FROM o x JOIN o y ON x.variant_id = y.variant_id AND x.sample_id <= y.sample_id GROUP BY 1, 2)
SELECT i, j, ROUND(CAST(2 * nv - (a.s + b.s - 2 * m) AS DOUBLE) / nv, 6) AS kinship FROM sh JOIN mg a ON a.sample_id = i JOIN mg b ON b.sample_id = j, nv""")
def ibs_kinship(spark, sf_dir):
    return rounded(K.ibs(V.calls(spark, sf_dir, complete=True, by=("sample_id",)), V.samples(spark, sf_dir), V.read(spark, sf_dir, "part").count()), kinship=6)


@query("bn_kinship", SHARED + """, fr AS (SELECT variant_id, CAST(SUM(g) AS DOUBLE) / (SELECT n FROM n) AS mu FROM o GROUP BY 1), fw AS (SELECT *, 1.0 / (mu * (1 - mu / 2)) AS w FROM fr WHERE mu > 0 AND mu < 2),
tot AS (SELECT COUNT(*) AS m, SUM(w * mu * mu) AS c FROM fw), x AS (SELECT variant_id, sample_id, CAST(g AS DOUBLE) AS g, w, mu FROM o JOIN fw USING (variant_id)), pt AS (SELECT sample_id, SUM(g * w * mu) AS p FROM x GROUP BY 1),
sh AS (SELECT a.sample_id AS i, b.sample_id AS j, SUM(a.g * b.g * a.w) AS v FROM x a JOIN x b ON a.variant_id = b.variant_id AND a.sample_id <= b.sample_id GROUP BY 1, 2)
SELECT i, j, ROUND((v - a.p - b.p + c) / m, 6) AS kinship FROM sh JOIN pt a ON a.sample_id = i JOIN pt b ON b.sample_id = j, tot""")
def bn_kinship(spark, sf_dir):
    return rounded(K.balding_nichols(V.calls(spark, sf_dir, complete=True, by=("variant_id",)), V.samples(spark, sf_dir), size(spark, sf_dir)), kinship=6)


@query("combine_kinship", """, p AS (SELECT c_custkey AS i, c_nationkey AS j, c_custkey % 7 / 7.0e0 AS kinship, CAST(10 AS DOUBLE) AS m FROM customer UNION ALL SELECT c_custkey, c_nationkey, c_custkey % 5 / 5.0e0, 30 FROM customer)
SELECT i, j, ROUND(SUM(kinship * m) / SUM(m), 6) AS kinship FROM p GROUP BY 1, 2""")
def combine_kinship(spark, sf_dir):
    c = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").alias("j"))
    parts = c.withColumns({"kinship": (F.col("i") % 7) / 7.0, "m": F.lit(10.0)}).unionAll(c.withColumns({"kinship": (F.col("i") % 5) / 5.0, "m": F.lit(30.0)}))
    return rounded(K.combine(parts), kinship=6)


PEOPLE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 >= 2 THEN c_custkey - c_custkey % 4 END AS father, CASE WHEN c_custkey % 4 >= 2 THEN c_custkey - c_custkey % 4 + 1 END AS mother, CAST(c_custkey % 2 + 1 AS INTEGER) AS sex FROM customer"


@query("pedigree_kinship", f""", p AS ({PEOPLE}) SELECT id AS i, id AS j, 0.5e0 AS kinship FROM p
UNION ALL SELECT father, id, 0.25e0 FROM p WHERE father IS NOT NULL UNION ALL SELECT mother, id, 0.25e0 FROM p WHERE mother IS NOT NULL
UNION ALL SELECT a.id, b.id, 0.25e0 FROM p a JOIN p b ON a.father = b.father AND a.id < b.id""")
def pedigree_kinship(spark, sf_dir):
    V.read(spark, sf_dir, "customer").createOrReplaceTempView("customer_for_pedigree")
    return rounded(K.pedigree(spark.sql(PEOPLE.replace("FROM customer", "FROM customer_for_pedigree"))), kinship=9)


# ---- summaries -------------------------------------------------------------------------------------------------------


@query("summary_filter_sets", """, v AS (SELECT filter, ref || alt IN ('AG','GA','CT','TC') AS ts, variant_id % 4 = 0 AS known FROM variants),
u AS (SELECT 'combined' AS s, filter AS value, ts, known FROM v UNION ALL SELECT 'status', CASE WHEN filter = 'PASS' THEN 'PASS' ELSE 'FAIL' END, ts, known FROM v
 UNION ALL SELECT 'total', 'TOTAL', ts, known FROM v UNION ALL SELECT 'single', UNNEST(string_split(filter, ';')), ts, known FROM v)
SELECT s AS "set", value, COUNT(*) AS total, COUNT(*) FILTER (ts) AS ts, COUNT(*) FILTER (NOT ts) AS tv, COUNT(*) FILTER (known) AS known, COUNT(*) FILTER (known AND ts) AS known_ts FROM u GROUP BY 1, 2""")
def summary_filter_sets(spark, sf_dir):
    return S.by_filter_sets(V.variants(spark, sf_dir).withColumn("known", F.col("variant_id") % 4 == 0))


@query("indv_summary", """, x AS (SELECT sample_id, g, ref || alt IN ('AG','GA','CT','TC') AS ts FROM calls JOIN variants USING (variant_id) WHERE g > 0)
SELECT sample_id, COUNT(*) FILTER (g = 1) AS n_het, COUNT(*) FILTER (g = 2) AS n_hom, COUNT(*) FILTER (ts) AS ts, COUNT(*) FILTER (NOT ts) AS tv FROM x GROUP BY ROLLUP (sample_id)""")
def indv_summary(spark, sf_dir):
    return S.by_individual(V.calls(spark, sf_dir), V.variants(spark, sf_dir))


@query("anno_summary", COUNTS + "SELECT anno, ac, COUNT(*) AS n FROM variants JOIN freq USING (variant_id) GROUP BY 1, 2")
def anno_summary(spark, sf_dir):
    return S.by_annotation(V.calls(spark, sf_dir).groupBy("variant_id").agg(*C.tally()), V.variants(spark, sf_dir))


@query("maf_histogram", COUNTS + "SELECT CAST(LEAST(FLOOR(maf / 0.001), 19) AS INTEGER) AS bin, COUNT(*) AS n FROM freq GROUP BY 1")
def maf_histogram(spark, sf_dir):
    return S.histogram(counter(spark, sf_dir), "maf", 20, 0.0, 0.02)


OTHER = """, other AS (SELECT l_partkey AS variant_id, o_custkey AS sample_id, CAST(LEAST(COUNT(*), 2) AS INTEGER) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1, 2),
cell AS (SELECT COALESCE(a.g, CASE WHEN a.variant_id IS NULL THEN -9 ELSE -1 END) AS standard, COALESCE(b.g, CASE WHEN b.variant_id IS NULL THEN -9 ELSE -1 END) AS other, COUNT(*) AS n
 FROM calls a FULL JOIN other b ON a.variant_id = b.variant_id AND a.sample_id = b.sample_id GROUP BY 1, 2)
"""


def _other(spark, sf_dir):
    return V.carried(spark, sf_dir, where="l_returnflag <> 'R'").groupBy("variant_id", "sample_id").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("g"))


@query("concordance", OTHER + "SELECT * FROM cell")
def concordance(spark, sf_dir):
    return S.concordance(V.calls(spark, sf_dir), _other(spark, sf_dir))


@query("concordance_rates", OTHER + """, k AS (SELECT SUM(CASE WHEN standard <> -9 AND other <> -9 THEN n ELSE 0 END) AS a, SUM(CASE WHEN standard <> -9 AND other = -9 THEN n ELSE 0 END) AS b, SUM(CASE WHEN standard = -9 AND other <> -9 THEN n ELSE 0 END) AS c,
 SUM(CASE WHEN standard > 0 AND standard = other THEN n ELSE 0 END) AS same, SUM(CASE WHEN standard > 0 AND other > 0 THEN n ELSE 0 END) AS bo, SUM(CASE WHEN standard > 0 THEN n ELSE 0 END) AS po FROM cell)
SELECT CAST(a AS BIGINT) AS overlap, CAST(b AS BIGINT) AS standard_only, CAST(c AS BIGINT) AS other_only, ROUND(CAST(same AS DOUBLE) / CAST(bo AS DOUBLE), 6) AS concordance, ROUND(CAST(bo AS DOUBLE) / CAST(po AS DOUBLE), 6) AS discovery FROM k""")
def concordance_rates(spark, sf_dir):
    return rounded(S.concordance_rates(S.concordance(V.calls(spark, sf_dir), _other(spark, sf_dir))), concordance=6, discovery=6)


@query("pair_sharing", """, o AS (SELECT variant_id, sample_id, g FROM c0) SELECT x.sample_id AS i, y.sample_id AS j, COUNT(*) FILTER (LEAST(x.g, y.g) = 1) AS p1, COUNT(*) FILTER (LEAST(x.g, y.g) = 2) AS p2
FROM o x JOIN o y ON x.variant_id = y.variant_id AND x.sample_id < y.sample_id GROUP BY 1, 2""")
def pair_sharing(spark, sf_dir):
    return S.sharing(V.calls(spark, sf_dir, complete=True), V.read(spark, sf_dir, "part").count())


@query("wide_genotypes", """, w AS (SELECT variant_id, MAX(CASE WHEN sample_id = 1 THEN COALESCE(g, -9) END) AS a, MAX(CASE WHEN sample_id = 5 THEN COALESCE(g, -9) END) AS b, MAX(CASE WHEN sample_id = 8 THEN COALESCE(g, -9) END) AS c FROM calls GROUP BY 1)
SELECT variant_id, chrom, pos, NULLIF(COALESCE(a, 0), -9) AS s1, NULLIF(COALESCE(b, 0), -9) AS s5, NULLIF(COALESCE(c, 0), -9) AS s8 FROM variants LEFT JOIN w USING (variant_id)""")
def wide_genotypes(spark, sf_dir):
    return S.wide(V.calls(spark, sf_dir), V.variants(spark, sf_dir), [1, 5, 8])


@query("id_sets", " SELECT c_nationkey AS id, 'both' AS side FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'left' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def id_sets(spark, sf_dir):
    a = V.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"))
    b = V.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionAll(a.exceptAll(b).distinct().join(b, "id", "left_anti").withColumn("side", F.lit("left")))


@query("id_sets_full", " SELECT DISTINCT c_nationkey AS id, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'both' ELSE 'left' END AS side FROM customer")
def id_sets_full(spark, sf_dir):
    a = V.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"))
    b = V.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionAll(a.distinct().join(b, "id", "left_anti").withColumn("side", F.lit("left")))


@query("windowed_events", " SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    from ..streaming.counters import windowed_events as windows

    out = windows(V.read(spark, sf_dir, "events"), "6 hours")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


# ---- joins of samples and sites, recoded scores -----------------------------------------------------------------------


@query("match_samples", " SELECT DISTINCT sample_id, y, trait, sex FROM samples JOIN (SELECT DISTINCT sample_id FROM calls) c USING (sample_id) WHERE sample_id % 9 <> 0")
def match_samples(spark, sf_dir):
    return P.match(V.calls(spark, sf_dir), V.samples(spark, sf_dir).where("sample_id % 9 <> 0")).select("sample_id", "y", "trait", "sex")


@query("match_and_impute", """, x AS (SELECT c.sample_id, s.y FROM (SELECT DISTINCT sample_id FROM calls) c LEFT JOIN (SELECT * FROM samples WHERE sample_id % 9 <> 0) s USING (sample_id))
SELECT sample_id, ROUND(COALESCE(CAST(y AS DOUBLE), (SELECT AVG(y) FROM x)), 4) AS y FROM x""")
def match_and_impute(spark, sf_dir):
    return P.match(V.calls(spark, sf_dir), V.samples(spark, sf_dir).where("sample_id % 9 <> 0"), "y").select("sample_id", F.round("y", 4).alias("y"))


@query("marker_covariates", """, a AS (SELECT sample_id, MAX(CASE WHEN variant_id = 4 THEN COALESCE(g, -9) END) AS a, MAX(CASE WHEN variant_id = 9 THEN COALESCE(g, -9) END) AS b FROM calls GROUP BY 1)
SELECT sample_id, y, NULLIF(COALESCE(a, 0), -9) AS m4, NULLIF(COALESCE(b, 0), -9) AS m9 FROM samples LEFT JOIN a USING (sample_id)""")
def marker_covariates(spark, sf_dir):
    return P.markers_as_covariates(V.samples(spark, sf_dir).select("sample_id", "y"), V.calls(spark, sf_dir), [4, 9])


@query("align_reference", """, r AS (SELECT chrom, pos, substr('ACGT', variant_id % 3 + 1, 1) AS base FROM variants WHERE variant_id % 11 <> 0)
SELECT variant_id, CASE WHEN ref = base THEN 'same' WHEN alt = base THEN 'switch' WHEN translate(ref, 'ACGT', 'TGCA') = base THEN 'flip' WHEN translate(alt, 'ACGT', 'TGCA') = base THEN 'flip_switch' ELSE 'unmatched' END AS alignment
FROM variants LEFT JOIN r USING (chrom, pos)""")
def align_reference(spark, sf_dir):
    v = V.variants(spark, sf_dir)
    base = v.where("variant_id % 11 <> 0").select("chrom", "pos", F.expr("substr('ACGT', int(variant_id % 3 + 1), 1)").alias("base"))
    return G.align_to_reference(v.select("variant_id", "chrom", "pos", F.col("ref").alias("a1"), F.col("alt").alias("a2")), base).select("variant_id", "alignment")


def _coded(k):
    return f", x AS (SELECT variant_id AS k, sample_id, CASE WHEN g >= {k} THEN 1 WHEN g IS NOT NULL THEN 0 END AS g FROM calls)"


def _coded_score(least):
    def run(spark, sf_dir):
        samples = V.samples(spark, sf_dir)
        coded = V.calls(spark, sf_dir).withColumn("g", G.dominant(F.col("g")) if least == 1 else G.recessive(F.col("g")))
        return scored(coded, samples)

    return run


query("dominant_score", _coded(1) + SUMS + SCORE.format(k="variant_id"))(_coded_score(1))
query("recessive_score", _coded(2) + SUMS + SCORE.format(k="variant_id"))(_coded_score(2))
