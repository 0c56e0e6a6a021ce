"""Phenotype and covariate transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_quantile_sql
from .ranks import value_ranks


def trait_type(rows: DataFrame, column: str) -> DataFrame:
    """BINARY if every value is -9, 0, 1 or 2, else QUANTITATIVE; one row."""
    return rows.agg(F.when(F.bool_and(F.col(column).isin(-9, 0, 1, 2)), "BINARY").otherwise("QUANTITATIVE").alias("trait_type"), F.count(column).alias("n"))


def recode_binary(rows: DataFrame, column: str) -> DataFrame:
    """1 to 0 (control), 2 to 1 (case); others are missing and go."""
    return rows.withColumn(column, F.when(F.col(column) == 1, 0).when(F.col(column) == 2, 1)).where(F.col(column).isNotNull())


def moments(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Number of rows and the matrix of cross-products of 1 and the columns: k * k sums in one aggregation."""
    names = ["1", *columns]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    col = lambda k: F.lit(1.0) if k == "1" else F.col(k).cast("double")
    row = rows.agg(*[F.sum(col(names[i]) * col(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return int(out[0, 0]), out


def residualise(rows: DataFrame, y: str, covariates: list[str], out: str = "residual") -> DataFrame:
    """Add the residuals of y on an intercept and the covariates: normal equations from one aggregation."""
    _, m = moments(rows, [*covariates, y])
    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    fitted = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], covariates):
        fitted = fitted + float(b) * F.col(c)
    return rows.withColumn(out, F.col(y) - fitted)


def inverse_normal(rows: DataFrame, y: str, out: str = "z", small_sample: bool = False) -> DataFrame:
    """Normal quantiles of (rank - a) / (n + 1 - 2a) with ranks from 1, ties averaged; null traits have no row.

    a is 1/2, which gives (0-based rank + 1/2) / n; with small_sample it is 3/8 up to 10 values, as R's ppoints has it. Ranks
    come from value ranges and their counts, so no task holds all values."""
    ranks = value_ranks(rows, y)
    a = F.when(F.col("n") <= 10, 0.375).otherwise(0.5) if small_sample else F.lit(0.5)
    ranks = ranks.withColumn("p", (F.col("below") + (F.col("same") + 1) / 2 - a) / (F.col("n") + 1 - 2 * a))
    return rows.join(ranks.select(y, F.expr(normal_quantile_sql("p")).alias(out)), y)


def impute_column(rows: DataFrame, column: str) -> DataFrame:
    """Nulls become the mean of the others."""
    mean = rows.agg(F.avg(column).alias("mean_of_column"))
    # one row
    return rows.join(F.broadcast(mean)).withColumn(column, F.coalesce(F.col(column).cast("double"), "mean_of_column")).drop("mean_of_column")


def covariate_check(rows: DataFrame, y: str, covariates: list[str]) -> DataFrame:
    """(covariate, r, constant, independent): correlation with y, whether the covariate doesn't vary, and whether it adds to
    the rank of 1 and the covariates before it."""
    _, m = moments(rows.where(F.concat(*[F.col(c).cast("string") for c in covariates]).isNotNull()), covariates)
    # what is left of each one's square sum beside those before it, by elimination in the scaled cross-products
    scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
    left, free = m / scale[:, None] / scale[None, :], []
    for k in range(len(m)):
        free.append(bool(left[k, k] > 1e-10))
        if free[-1]:
            left = left - np.outer(left[:, k], left[k]) / left[k, k]
    out = None
    for c, ok in zip(covariates, free[1:]):
        row = rows.agg(F.lit(c).alias("covariate"), F.corr(F.col(c).cast("double"), F.col(y).cast("double")).alias("r"), (F.count_distinct(c) <= 1).alias("constant"), F.lit(ok).alias("independent"))
        out = row if out is None else out.unionAll(row)
    return out


def with_covariates(phenotypes: DataFrame, covariates: DataFrame, key: str = "sample_id") -> DataFrame:
    """phenotypes with the covariates' columns, inner by sample: samples that lack either are left out."""
    return phenotypes.join(covariates, key)


def with_sex(samples: DataFrame, sex: DataFrame) -> DataFrame:
    """samples with sex by sample_id; 0 where it is unknown or null."""
    return samples.join(sex.select("sample_id", "sex"), "sample_id", "left").withColumn("sex", F.when(F.col("sex").isin(1, 2), F.col("sex")).otherwise(0))


def sex_covariate(samples: DataFrame) -> DataFrame:
    """Samples of known sex, which can be a covariate then."""
    return samples.where(F.col("sex").isin(1, 2))


def complete_traits(samples: DataFrame, traits: list[str]) -> DataFrame:
    """Samples that have all of several traits."""
    return samples.where(F.concat(*[F.col(t).cast("string") for t in traits]).isNotNull())


def unique_only(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once: all copies of a repeated sample go."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("times")).where("times = 1").select(key), key, "left_semi")


def match(genotyped: DataFrame, samples: DataFrame, impute: str | None = None) -> DataFrame:
    """Genotyped ids joined with their sample rows: an inner join, or with impute a left join whose null trait becomes
    the mean of the others."""
    ids = genotyped.select("sample_id").distinct()
    if impute is None:
        return ids.join(samples, "sample_id")
    return impute_column(ids.join(samples, "sample_id", "left"), impute)


def markers_as_covariates(samples: DataFrame, calls: DataFrame, markers: list[int]) -> DataFrame:
    """samples with one column m<id> per listed variant: its genotype, absent pairs 0, missing null."""
    rows = calls.where(F.col("variant_id").isin(markers)).withColumn("g", F.coalesce("g", F.lit(-9)))
    table = rows.groupBy("sample_id").pivot("variant_id", markers).agg(F.first("g"))
    out = samples.join(table, "sample_id", "left")
    return out.select(*samples.columns, *[F.nullif(F.coalesce(F.col(str(m)), F.lit(0)), F.lit(-9)).alias(f"m{m}") for m in markers])
