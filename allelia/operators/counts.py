"""Genotype counters and frequencies, by variant and by stratum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import log_factorial_table
from .ranks import value_ranks


def tally(g: str = "g") -> list[Column]:
    """Partial counts of a sparse group: n_het, n_alt, n_missing, ac. Zeros come by complement."""
    x = F.col(g)
    return [
        F.sum(F.when(x == 1, 1).otherwise(0)).alias("n_het"), F.sum(F.when(x == 2, 1).otherwise(0)).alias("n_alt"),
        F.sum(F.when(x.isNull(), 1).otherwise(0)).alias("n_missing"), F.coalesce(F.sum(x), F.lit(0)).cast("long").alias("ac"),
    ]


def frequencies(counts: DataFrame, n: Column | int) -> DataFrame:
    """Add n_ref, af (missing calls stay in the denominator), af_called, maf and call_rate to counts over n samples."""
    n = n if isinstance(n, Column) else F.lit(n)
    d = lambda c: c.cast("double")
    called = n - F.col("n_missing")
    af = d(F.col("ac")) / d(2 * n)
    return counts.withColumns({
        "n_ref": n - F.col("n_het") - F.col("n_alt") - F.col("n_missing"), "af": af,
        "af_called": F.when(called > 0, d(F.col("ac")) / d(2 * called)), "maf": F.least(af, 1 - af), "call_rate": d(called) / d(n),
    })


def genotype_counter(calls: DataFrame, n: int) -> DataFrame:
    """Counts and frequencies of every variant with a call: one partial aggregation, one shuffle by variant."""
    return frequencies(calls.groupBy("variant_id").agg(*tally()), n)


def counter_by_stratum(calls: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by variant and stratum of samples, with n_ref by complement from the stratum's size."""
    sizes = samples.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = calls.join(samples.select("sample_id", *keys), "sample_id").groupBy("variant_id", *keys).agg(*tally())
    # one row a stratum
    out = counts.join(F.broadcast(sizes), keys)
    return out.withColumn("n_ref", F.col("n") - F.col("n_het") - F.col("n_alt") - F.col("n_missing"))


def control_frequency(calls: DataFrame, samples: DataFrame, control: int = 1) -> DataFrame:
    """Frequency among controls, smoothed by one allele of each kind: (ac + 1) / (an + 2)."""
    own = samples.where(F.col("trait") == control)
    n = own.count()
    counts = calls.join(own.select("sample_id"), "sample_id").groupBy("variant_id").agg(*tally())
    an = 2 * (F.lit(n) - F.col("n_missing"))
    return counts.select("variant_id", "ac", an.alias("an"), ((F.col("ac") + 1).cast("double") / (an + 2).cast("double")).alias("q"))


def smoothed_frequency(calls: DataFrame, n: int) -> DataFrame:
    """(variant_id, q): (ac + 1) / (an + 2) among all called samples, for weights without a phenotype."""
    counts = calls.groupBy("variant_id").agg(*tally())
    return counts.select("variant_id", ((F.col("ac") + 1).cast("double") / (2 * (F.lit(n) - F.col("n_missing")) + 2).cast("double")).alias("q"))


def extremes(counts: DataFrame, n: int) -> DataFrame:
    """(variant_id, n_count, minimum, maximum) of the called genotypes of counts over n samples, hom-ref ones included."""
    has = [F.col(c) > 0 for c in ("n_ref", "n_het", "n_alt")]
    return counts.select(
        "variant_id", (F.lit(n) - F.col("n_missing")).alias("n_count"),
        F.when(has[0], 0).when(has[1], 1).when(has[2], 2).alias("minimum"), F.when(has[2], 2).when(has[1], 1).when(has[0], 0).alias("maximum"),
    )


def hwe_p(n_ref: np.ndarray, n_het: np.ndarray, n_alt: np.ndarray) -> np.ndarray:
    """Exact Hardy-Weinberg p of genotype counts: the share of the heterozygote counts that are at most as likely as the one
    seen. Terms are ratios of factorials relative to the largest, so none over- or underflows."""
    lf = log_factorial_table(int((n_ref + n_het + n_alt).max(initial=0)))
    out = np.zeros(len(n_het))
    for i, (a, h, b) in enumerate(zip(n_ref.tolist(), n_het.tolist(), n_alt.tolist())):
        n, rare = a + h + b, h + 2 * min(a, b)
        k = np.arange(rare % 2, rare + 1, 2)
        few = (rare - k) // 2
        w = k * np.log(2.0) - lf[few] - lf[k] - lf[n - k - few]
        e = np.exp(w - w.max())
        out[i] = min(1.0, e[w <= w[(h - k[0]) // 2] + 1e-9].sum() / e.sum())
    return out


def hwe_exact(counts: DataFrame) -> DataFrame:
    """(variant_id, hwe_p): exact Hardy-Weinberg p of counts(variant_id, n_ref, n_het, n_alt). Many variants have equal
    counts, so each distinct triple is computed once, in a numpy kernel."""
    key = ["n_ref", "n_het", "n_alt"]
    rows = counts.select("variant_id", *[F.col(c).cast("long").alias(c) for c in key])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hwe_p(*(c.to_numpy() for c in batch.columns)))], names=[*key, "hwe_p"])

    p = rows.select(*key).distinct().mapInArrow(run, "n_ref long, n_het long, n_alt long, hwe_p double")
    return rows.join(p, key).select("variant_id", "hwe_p")


def quantity_summary(rows: DataFrame, value: str) -> DataFrame:
    """Five numbers by index (element int(n * q) of the sorted values), mean and sample variance, of one column.

    Values are dealt to ranges; the numbers of smaller ranges say in which one each element lies and at which place there."""
    ranked = value_ranks(rows.select(F.col(value).alias("v")), "v")

    def at(q):
        place = F.least(F.floor(F.col("n") * q), F.col("n") - 1)
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("same")), F.col("v")))

    out = ranked.agg(at(0.0).alias("minimum"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("v").alias("maximum"))
    spread = rows.agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return out.join(F.broadcast(spread))  # one row each
