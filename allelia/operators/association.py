"""Score, exact and burden tests from sufficient statistics: every group is a row of sums, the algebra is a projection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_1_sf_sql, log10_chi2_1_sf_sql, log_factorial_table
from .counts import frequencies, tally
from .phenotype import moments


def trait_sums(samples: DataFrame, y: str = "y") -> tuple[float, float, float]:
    """n, sum and sum of squares of a trait; exact for integers, else in double."""
    row = samples.agg(F.count(y).alias("n"), F.sum(F.col(y)).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q")).first()
    return row.n, row.s or 0, row.q or 0


def group_sums(calls: DataFrame, samples: DataFrame, group: str = "variant_id", y: str = "y", g: str = "g") -> DataFrame:
    """Per group: ac = sum g, sq = sum g * g, gy = sum g * y over called carriers, miss and miss_y over missing calls.

    Sums have the type of their terms: exact for integer calls and traits, double for dosages and real traits."""
    rows = calls.join(samples.select("sample_id", y), "sample_id")
    x = F.col(g)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(group).agg(
        total(x).alias("ac"), total(x * x).alias("sq"), total(x * F.col(y)).alias("gy"), F.sum(F.when(x.isNull(), 1).otherwise(0)).alias("miss"), total(F.when(x.isNull(), F.col(y))).alias("miss_y")
    )


def _tails(out: DataFrame, stat: str) -> DataFrame:
    """Add pvalue and its log10, which doesn't underflow, of a chi-square with one degree of freedom."""
    return out.withColumns({"pvalue": F.expr(chi2_1_sf_sql(stat)), "log10p": F.expr(log10_chi2_1_sf_sql(stat))})


def score(sums: DataFrame, n: int, sy: float, qy: float) -> DataFrame:
    """Add af, u_stat, sqrt_v, stat, effect, pvalue and log10p of the linear score test with an intercept; missing calls
    at the mean.

    U = g'r, V = s2 (g'g - (sum g)^2 / n) with the maximum-likelihood variance s2; STAT = U^2 / V against one degree of
    freedom. Nulls where the genotype doesn't vary."""
    d = lambda c: c.cast("double")
    mean = d(F.col("ac")) / d(F.lit(n) - F.col("miss"))
    s = d(F.col("ac")) + d(F.col("miss")) * mean
    q = d(F.col("sq")) + d(F.col("miss")) * mean * mean
    gy = d(F.col("gy")) + mean * d(F.col("miss_y"))
    sigma2 = (float(qy) - float(sy) * float(sy) / float(n)) / float(n)
    out = sums.withColumns({"u_": gy - float(sy) * s / float(n), "ss_": q - s * s / float(n)})
    out = out.withColumn("v_", sigma2 * F.col("ss_")).withColumn("t_", F.when(F.col("ss_") > 1e-9, F.col("u_") * F.col("u_") / F.col("v_")))
    out = out.withColumns({"af": s / float(2 * n), "u_stat": F.col("u_"), "sqrt_v": F.sqrt("v_"), "stat": F.col("t_"), "effect": F.when(F.col("ss_") > 1e-9, F.col("u_") / F.col("ss_"))})
    return _tails(out, "t_").drop("u_", "v_", "ss_", "t_")


class CovariateModel:
    """The null model y ~ 1 + covariates of a quantitative trait: one aggregation of k * k sums over the samples. n, beta,
    the inverse of Z'Z and the maximum-likelihood variance enter projections as literals."""

    def __init__(self, samples: DataFrame, covariates: list[str], y: str = "y"):
        self.names, self.y = ["1", *covariates], y
        self.n, m = moments(samples, [*covariates, y])
        self.inner = np.linalg.pinv(m[:-1, :-1])
        self.beta = self.inner @ m[:-1, -1]
        self.s2 = float(m[-1, -1] - m[:-1, -1] @ self.beta) / self.n
        self.people = samples.select("sample_id", F.col(y).cast("double").alias("y_"), *[F.col(c).cast("double").alias(f"c{i + 1}_") for i, c in enumerate(covariates)])

    def sums(self, calls: DataFrame, group: str = "variant_id") -> DataFrame:
        """(group, s, q, k, u, ss, z): of each genotype or burden, missing calls at the mean, the sum, the number of missing
        calls, U = g'(y - fitted), g'g less what 1 and the covariates explain of it, and g'Z as an array."""
        x, missing = F.col("g").cast("double"), F.col("g").isNull()
        value = lambda i: F.lit(1.0) if i == 0 else F.col(f"c{i}_")
        total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
        some = range(len(self.names))
        sums = calls.join(self.people, "sample_id").groupBy(group).agg(
            total(x).alias("s"), total(x * x).alias("q"), F.sum(F.when(missing, 1.0).otherwise(0.0)).alias("k"), total(x * F.col("y_")).alias("gy"), total(F.when(missing, F.col("y_"))).alias("my"),
            *[total(x * value(i)).alias(f"z{i}") for i in some], *[total(F.when(missing, value(i))).alias(f"m{i}") for i in some],
        )
        mean = F.col("s") / (F.lit(float(self.n)) - F.col("k"))
        z = [F.col(f"z{i}") + mean * F.col(f"m{i}") for i in some]
        u, fitted = F.col("gy") + mean * F.col("my"), F.lit(0.0)
        for i in some:
            u = u - float(self.beta[i]) * z[i]
            for j in some:
                fitted = fitted + float(self.inner[i, j]) * z[i] * z[j]
        return sums.select(group, (F.col("s") + mean * F.col("k")).alias("s"), "q", "k", u.alias("u"), (F.col("q") + F.col("k") * mean * mean - fitted).alias("ss"), F.array(*z).alias("z"))


def score_with_covariates(calls: DataFrame, samples: DataFrame, covariates: list[str], y: str = "y", group: str = "variant_id") -> DataFrame:
    """(group, u_stat, v_stat, stat, effect, pvalue, log10p): linear score test of genotypes or burdens with an intercept
    and covariates; missing calls at the mean, nulls where nothing of g is left beside the covariates."""
    null = CovariateModel(samples, covariates, y)
    some = F.col("ss") > 1e-9
    out = null.sums(calls, group).withColumn("stat", F.when(some, F.col("u") * F.col("u") / (null.s2 * F.col("ss"))))
    return _tails(out.select(group, F.col("u").alias("u_stat"), (null.s2 * F.col("ss")).alias("v_stat"), "stat", F.when(some, F.col("u") / F.col("ss")).alias("effect")), "stat")


def wald_with_covariates(calls: DataFrame, samples: DataFrame, covariates: list[str], y: str = "y", group: str = "variant_id") -> DataFrame:
    """(group, beta, se, stat, pvalue, log10p) of the genotype or burden in a regression of y on it, 1 and the covariates, with
    the full model's maximum-likelihood variance; missing calls at the mean."""
    null = CovariateModel(samples, covariates, y)
    out = null.sums(calls, group).withColumn("beta", F.when(F.col("ss") > 1e-9, F.col("u") / F.col("ss")))
    out = out.withColumn("se", F.sqrt((null.s2 * null.n - F.col("beta") * F.col("u")) / float(null.n) / F.col("ss")))
    return _tails(out.select(group, "beta", "se", ((F.col("beta") / F.col("se")) ** 2).alias("stat")), "stat")


def meta_score(calls: DataFrame, samples: DataFrame, n: int, sy: float, qy: float, y: str = "y") -> DataFrame:
    """Genotype counts and frequencies with u_scaled, sqrt_v_scaled (U and the root of V over the trait's variance), stat,
    effect, pvalue and log10p: counts and sums are one aggregation."""
    s2 = (float(qy) - float(sy) * float(sy) / float(n)) / float(n)
    x = F.col("g")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = calls.join(samples.select("sample_id", F.col(y).alias("y_")), "sample_id").groupBy("variant_id").agg(*tally(), total(x * x).alias("sq"), total(x * F.col("y_")).alias("gy"), total(F.when(x.isNull(), F.col("y_"))).alias("miss_y"))
    d = lambda c: F.col(c).cast("double")
    mean = d("ac") / (float(n) - F.col("n_missing"))
    s = d("ac") + d("n_missing") * mean
    out = frequencies(sums, n).withColumns({"u": d("gy") + mean * d("miss_y") - float(sy) * s / float(n), "w": d("sq") + d("n_missing") * mean * mean - s * s / float(n)})
    some = F.col("w") > 1e-9
    out = out.withColumns({"u_scaled": F.col("u") / s2, "sqrt_v_scaled": F.sqrt(F.col("w") / s2), "stat": F.when(some, F.col("u") * F.col("u") / (s2 * F.col("w"))), "effect": F.when(some, F.col("u") / F.col("w"))})
    return _tails(out, "stat").drop("u", "w", "sq", "gy", "miss_y")


def meta_score_binary(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(variant_id, n_ref, n_het, n_alt, informative_alt_ac, u_stat, sqrt_v, stat, pvalue, log10p) of a trait with controls 1 and
    cases 2: counts as all:case:control, U and V of the logistic score test with an intercept, from one aggregation."""
    sizes = {r.trait: r.n for r in samples.groupBy("trait").agg(F.count("*").alias("n")).collect()}  # one row a trait value
    n2, n1 = sizes.get(2, 0), sizes.get(1, 0)
    n = n1 + n2
    rows = calls.join(samples.where("trait IN (1, 2)").select("sample_id", "trait"), "sample_id")
    own = lambda c, t: F.sum(F.when(c & (F.col("trait") == t), 1).otherwise(0))
    g = F.col("g")
    sums = rows.groupBy("variant_id").agg(*[own(c, t).alias(f"{k}{t}") for k, c in (("h", g == 1), ("k", g == 2), ("m", g.isNull())) for t in (1, 2)])
    c = F.col
    for k in "hkm":
        sums = sums.withColumn(k, c(f"{k}1") + c(f"{k}2"))
    for t in ("", "1", "2"):
        sums = sums.withColumns({f"ac{t}": c(f"h{t}") + 2 * c(f"k{t}"), f"r{t}": F.lit({"": n, "1": n1, "2": n2}[t]) - c(f"h{t}") - c(f"k{t}") - c(f"m{t}")})
    p = n2 / n if n else 0.0
    mean = c("ac").cast("double") / (float(n) - c("m"))
    s = c("ac") + mean * c("m")
    u = c("ac2") + mean * c("m2") - p * s
    v = p * (1 - p) * (c("h") + 4 * c("k") + c("m") * mean * mean - s * s / float(n))
    text = lambda k: F.concat_ws(":", *[c(f"{k}{t}").cast("string") for t in ("", "2", "1")])
    out = sums.select("variant_id", text("r").alias("n_ref"), text("h").alias("n_het"), text("k").alias("n_alt"), text("ac").alias("informative_alt_ac"), u.alias("u_stat"), v.alias("v_"))
    out = out.withColumns({"sqrt_v": F.sqrt(F.greatest("v_", F.lit(0.0))), "stat": F.when(c("v_") > 1e-9, c("u_stat") * c("u_stat") / c("v_"))})
    return _tails(out.drop("v_"), "stat")


def meta_score_with_covariates(calls: DataFrame, samples: DataFrame, covariates: list[str], y: str = "y") -> DataFrame:
    """(variant_id, u_scaled, sqrt_v_scaled, stat, effect, pvalue, log10p): U and the root of V over the trait's variance, as
    meta-analysis takes them."""
    null = CovariateModel(samples, covariates, y)
    some = F.col("ss") > 1e-9
    out = null.sums(calls).withColumn("stat", F.when(some, F.col("u") * F.col("u") / (null.s2 * F.col("ss"))))
    return _tails(out.select("variant_id", (F.col("u") / null.s2).alias("u_scaled"), F.sqrt(F.greatest("ss", F.lit(0.0)) / null.s2).alias("sqrt_v_scaled"), "stat", F.when(some, F.col("u") / F.col("ss")).alias("effect")), "stat")


def wald_linear(sums: DataFrame, n: int, sy: float, qy: float, group: str = "variant_id") -> DataFrame:
    """(group, beta, se, pvalue, log10p): slope, standard error and p of y on an intercept and the genotype (chi-square of z^2,
    variance by maximum likelihood)."""
    d = lambda c: c.cast("double")
    sxx = d(F.col("sq")) - d(F.col("ac")) * d(F.col("ac")) / float(n)
    sxy = d(F.col("gy")) - float(sy) * d(F.col("ac")) / float(n)
    syy = float(qy) - float(sy) * float(sy) / float(n)
    out = sums.withColumns({"beta": F.when(sxx > 1e-9, sxy / sxx), "se": F.when(sxx > 1e-9, F.sqrt((syy - sxy * sxy / sxx) / float(n) / sxx))})
    return _tails(out.select(group, "beta", "se", ((F.col("beta") / F.col("se")) * (F.col("beta") / F.col("se"))).alias("t")), "t").drop("t")


def two_by_two(calls: DataFrame, samples: DataFrame, carriers: bool = False, group: str = "variant_id", g: str = "g") -> DataFrame:
    """Allele counts (or carriers) by control (0) and case (1): n00 control reference, n01 control alternative, n10, n11."""
    sizes = samples.agg(F.sum(F.when(F.col("trait") == 1, 1).otherwise(0)).alias("c"), F.sum(F.when(F.col("trait") == 2, 1).otherwise(0)).alias("a")).first()
    rows = calls.join(samples.select("sample_id", "trait"), "sample_id")
    x = F.when(F.col(g) > 0, 1).when(F.col(g).isNotNull(), 0) if carriers else F.col(g)
    per = 1 if carriers else 2
    own = lambda t: F.coalesce(F.sum(F.when(F.col("trait") == t, x)), F.lit(0)).cast("long")
    gone = lambda t: F.sum(F.when((F.col("trait") == t) & F.col(g).isNull(), per).otherwise(0))
    out = rows.groupBy(group).agg(own(1).alias("n01"), own(2).alias("n11"), gone(1).alias("m0"), gone(2).alias("m1"))
    return out.select(group, (F.lit(per * sizes.c) - F.col("n01") - F.col("m0")).alias("n00"), "n01", (F.lit(per * sizes.a) - F.col("n11") - F.col("m1")).alias("n10"), "n11")


def _fisher(r0: np.ndarray, r1: np.ndarray, k: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two-sided, less, greater) of tables with row totals r0 and r1, alternative total k and seen alternatives in row 0."""
    lf = log_factorial_table(int((r0 + r1).max(initial=0)))
    out = np.zeros((3, len(k)))
    for i, (a, b, t, x) in enumerate(zip(r0.tolist(), r1.tolist(), k.tolist(), seen.tolist())):
        v = np.arange(max(0, t - b), min(t, a) + 1)
        w = -(lf[v] + lf[a - v] + lf[t - v] + lf[b - t + v])
        e = np.exp(w - w.max())
        out[:, i] = e[w <= w[x - v[0]] + 1e-9].sum(), e[v >= x].sum(), e[v <= x].sum()
        out[:, i] = np.minimum(out[:, i] / e.sum(), 1.0)
    return out[0], out[1], out[2]


def fisher(tables: DataFrame, group: str = "variant_id") -> DataFrame:
    """(group, p_two_side, p_less, p_greater): exact p of 2x2 tables (n00, n01, n10, n11).

    Support is the possible values of the smaller alternative total; two-sided sums all tables at most as likely. Tables
    are equal for many groups, so each distinct one is computed once, in a numpy kernel."""
    t = tables.select(group, (F.col("n00") + F.col("n01")).cast("long").alias("r0"), (F.col("n10") + F.col("n11")).cast("long").alias("r1"), (F.col("n01") + F.col("n11")).cast("long").alias("k"), F.col("n01").cast("long").alias("x"))

    def run(batches):
        for batch in batches:
            p = _fisher(*(batch.column(c).to_numpy() for c in ("r0", "r1", "k", "x")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in p]], names=[*batch.schema.names, "p_two_side", "p_less", "p_greater"])

    key = ["r0", "r1", "k", "x"]
    p = t.select(*key).distinct().mapInArrow(run, "r0 long, r1 long, k long, x long, p_two_side double, p_less double, p_greater double")
    return t.join(p, key).select(group, "p_two_side", "p_less", "p_greater")


# ---- groups of variants -------------------------------------------------------------------------------------------


def collapse(calls: DataFrame, members: DataFrame, kind: str, weights: DataFrame | None = None) -> DataFrame:
    """(group, sample_id, g): per-sample score of each group of members(group, variant_id); samples without are 0.

    cmc: 1 if any variant is carried; zeggini: number of variants carried; sum: alleles; weighted: sum of g times
    weights(variant_id, w). Missing calls count as not carried."""
    rows = calls.join(members, "variant_id").where("g > 0")
    if kind == "weighted":
        rows = rows.join(weights, "variant_id")
    value = {"cmc": F.lit(1), "zeggini": F.count("*").cast("int"), "sum": F.sum("g").cast("int"), "weighted": F.sum(F.col("g") * F.col("w")) if weights is not None else None}[kind]
    return rows.groupBy("group", "sample_id").agg(value.alias("g"))


def madsen_browning_weights(control_freq: DataFrame, n: int) -> DataFrame:
    """1 / sqrt(n q (1 - q)), q smoothed among controls."""
    return control_freq.select("variant_id", (1.0 / F.sqrt(float(n) * F.col("q") * (1 - F.col("q")))).alias("w"))


def fp_weights(counter: DataFrame) -> DataFrame:
    """1 / sqrt(q (1 - q)), q the overall frequency; monomorphic variants have none."""
    return counter.where("af > 0 AND af < 1").select("variant_id", (1.0 / F.sqrt(F.col("af") * (1 - F.col("af")))).alias("w"))


def skat_q(calls: DataFrame, samples: DataFrame, members: DataFrame, covariates: list[str] | None = None, y: str = "y", beta2: float = 25.0) -> DataFrame:
    """(group, n_variants, q): sum over the group's variants of Beta(maf; 1, beta2)^2 times (g'r)^2, r the trait's residuals
    from an intercept and the covariates."""
    null = CovariateModel(samples, covariates or [], y)
    af = F.col("s") / float(2 * null.n)
    w = float(beta2) * F.pow(1.0 - F.least(af, 1.0 - af), F.lit(beta2 - 1.0))
    rows = null.sums(calls).where("s > 0").select("variant_id", (w * w * F.col("u") * F.col("u")).alias("t"))
    return rows.join(members, "variant_id").groupBy("group").agg(F.count("*").alias("n_variants"), F.sum("t").alias("q"))


def cmat(calls: DataFrame, samples: DataFrame, members: DataFrame) -> DataFrame:
    """(group, stat) of the cumulative minor-allele test over allele counts of controls and cases."""
    sizes = samples.agg(F.sum(F.when(F.col("trait") == 1, 1).otherwise(0)).alias("c"), F.sum(F.when(F.col("trait") == 2, 1).otherwise(0)).alias("a")).first()
    t = two_by_two(calls, samples).join(members, "variant_id").groupBy("group").agg(
        F.count("*").cast("double").alias("l"), F.sum("n11").cast("double").alias("ma"), F.sum("n10").cast("double").alias("ra"), F.sum("n01").cast("double").alias("mu"), F.sum("n00").cast("double").alias("ru")
    )
    na, nu = float(sizes.a), float(sizes.c)
    d = F.col("ma") * F.col("ru") - F.col("mu") * F.col("ra")
    stat = (na + nu) / (2.0 * na * nu * F.col("l")) * d * d / ((F.col("ma") + F.col("mu")) * (F.col("ra") + F.col("ru")))
    return t.select("group", stat.alias("stat"))


def _frequency_steps(members: DataFrame, counter: DataFrame) -> DataFrame:
    """(group, variant_id, f): each variant's frequency rounded up to steps of 1e-6."""
    return counter.where("maf > 0").select("variant_id", (F.ceil(F.round(F.col("maf"), 9) * 1_000_000) / 1_000_000).alias("f")).join(members, "variant_id")


def thresholds(calls: DataFrame, members: DataFrame, counter: DataFrame, samples: DataFrame, y: str = "y") -> DataFrame:
    """(group, threshold, carriers, sum_y): CMC carriers of variants up to each distinct frequency (steps of 1e-6).

    A carrier counts from its first frequency on, so carriers are summed by frequency and cumulated over a group's steps."""
    freq = _frequency_steps(members, counter)
    rows = calls.where("g > 0").select("variant_id", "sample_id").join(freq, "variant_id")
    first = rows.groupBy("group", "sample_id").agg(F.min("f").alias("f")).join(samples.select("sample_id", y), "sample_id")
    sums = first.groupBy("group", "f").agg(F.count("*").alias("c"), F.sum(y).alias("s"))
    steps = freq.select("group", "f").distinct().join(sums, ["group", "f"], "left")
    up_to = Window.partitionBy("group").orderBy("f")
    return steps.select("group", F.col("f").alias("threshold"), F.sum("c").over(up_to).alias("carriers"), F.sum("s").over(up_to).alias("sum_y")).where("carriers > 0")


def price(calls: DataFrame, samples: DataFrame, members: DataFrame, counter: DataFrame, n: int, sy: float, y: str = "y", digits: int | None = None) -> DataFrame:
    """(group, opt_freq, zmax): the frequency threshold whose allele sum has the largest |z| = |sum x (y - mean)| / sd(x);
    ties, with digits of z rounded to them, go to the smaller threshold.

    A sample's sum over a group grows at its own few frequencies only; the changes of sum x, sum x^2 and sum x y there are
    summed by frequency and cumulated over the group's steps, so no carrier is repeated for every threshold."""
    freq = _frequency_steps(members, counter)
    rows = calls.where("g > 0").join(freq, "variant_id").groupBy("group", "sample_id", "f").agg(F.sum("g").alias("g"))
    rows = rows.join(samples.select("sample_id", F.col(y).alias("y_")), "sample_id")
    x = F.sum("g").over(Window.partitionBy("group", "sample_id").orderBy("f"))
    rows = rows.withColumn("x", x)
    sums = rows.groupBy("group", "f").agg(F.sum("g").alias("s"), F.sum(F.col("g") * (2 * F.col("x") - F.col("g"))).alias("q"), F.sum(F.col("g") * F.col("y_")).alias("gy"))
    up_to = Window.partitionBy("group").orderBy("f")
    sums = sums.select("group", F.col("f").alias("threshold"), *[F.sum(c).over(up_to).cast("double").alias(c) for c in ("s", "q", "gy")])
    var = F.col("q") / float(n) - (F.col("s") / float(n)) * (F.col("s") / float(n))
    z = F.abs(F.col("gy") - float(sy) * F.col("s") / float(n)) / F.sqrt(var)
    sums = sums.withColumn("z", z if digits is None else F.round(z, digits))
    return sums.groupBy("group").agg(F.max_by("threshold", F.struct("z", -F.col("threshold"))).alias("opt_freq"), F.max("z").alias("zmax"))


def patterns(calls: DataFrame, samples: DataFrame, members: DataFrame) -> DataFrame:
    """(group, pattern, n_control, n_case): samples by their multi-site genotype in each group, the wild type left out."""
    rows = calls.where("g > 0").join(members, "variant_id").join(samples.select("sample_id", "trait"), "sample_id")
    cell = F.concat(F.col("variant_id").cast("string"), F.lit(":"), F.col("g").cast("string"))
    own = rows.groupBy("group", "sample_id", "trait").agg(F.array_join(F.array_sort(F.collect_list(cell)), ",").alias("pattern"))
    return own.groupBy("group", "pattern").agg(F.sum(F.when(F.col("trait") == 1, 1).otherwise(0)).alias("n_control"), F.sum(F.when(F.col("trait") == 2, 1).otherwise(0)).alias("n_case"))
