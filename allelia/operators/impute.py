"""Imputation, recoding and pruning of a sparse genotype matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import tally


def impute_mean(calls: DataFrame, n: int) -> DataFrame:
    """Missing calls become twice the frequency among called samples (zeros included); others stay."""
    means = calls.groupBy("variant_id").agg(*tally()).select("variant_id", (F.col("ac").cast("double") / (F.lit(n) - F.col("n_missing")).cast("double")).alias("mean"))
    return calls.join(means, "variant_id").withColumn("g", F.coalesce(F.col("g").cast("double"), F.col("mean"))).drop("mean")


def impute_hwe(calls: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Missing calls are drawn from Hardy-Weinberg proportions, by a hash of variant, sample and seed: the same draw always."""
    means = calls.groupBy("variant_id").agg(*tally()).select("variant_id", (F.col("ac").cast("double") / (2 * (F.lit(n) - F.col("n_missing"))).cast("double")).alias("p"))
    u = F.pmod(F.xxhash64("variant_id", "sample_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    drawn = F.when(u < (1 - F.col("p")) ** 2, 0).when(u < 1 - F.col("p") ** 2, 1).otherwise(2)
    return calls.join(means, "variant_id").withColumn("g", F.coalesce("g", drawn)).drop("p")


def drop_incomplete(calls: DataFrame, members: DataFrame) -> DataFrame:
    """calls by group (members(group, variant_id)), without the samples that miss any of the group's variants."""
    rows = calls.join(members, "variant_id")
    gone = rows.where(F.col("g").isNull()).select("group", "sample_id").distinct()
    return rows.join(gone, ["group", "sample_id"], "left_anti")


def polymorphic(counts: DataFrame, n: int) -> DataFrame:
    """Variants with two different called genotypes, of counts over n samples."""
    ref = F.lit(n) - F.col("n_het") - F.col("n_alt") - F.col("n_missing")
    kinds = F.when(ref > 0, 1).otherwise(0) + F.when(F.col("n_het") > 0, 1).otherwise(0) + F.when(F.col("n_alt") > 0, 1).otherwise(0)
    return counts.where(kinds > 1)


def flip_to_minor(counts: DataFrame, n: int) -> DataFrame:
    """Whether the alternative allele is the major one (its sum exceeds the samples), and the minor allele's count and
    square sum: 2 - g over n samples sums to 2n - s, its squares to 4n - 4s + q."""
    s, q = F.col("ac"), F.col("n_het") + 4 * F.col("n_alt")
    m = F.lit(n) - F.col("n_missing")
    flip = s > m
    return counts.select("variant_id", flip.alias("flipped"), F.when(flip, 2 * m - s).otherwise(s).alias("minor"), F.when(flip, 4 * m - 4 * s + q).otherwise(q).alias("minor_sq"))


def recode(calls: DataFrame, n: int, least: int) -> DataFrame:
    """Carriers of least copies or more as 1 (dominant: 1, recessive: 2), missing as the mean of the coded values."""
    coded = calls.withColumn("x", F.when(F.col("g") >= least, 1).when(F.col("g").isNotNull(), 0))
    means = coded.groupBy("variant_id").agg((F.sum("x").cast("double") / (F.lit(n) - F.sum(F.when(F.col("g").isNull(), 1).otherwise(0))).cast("double")).alias("mean"))
    return coded.join(means, "variant_id").select("variant_id", "sample_id", F.coalesce(F.col("x").cast("double"), F.col("mean")).alias("x"))
