"""Binary traits: distributed logistic null models, score tests, and regressions from genotype cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.special import chi2_1_sf, chi2_1_sf_sql, log10_chi2_1_sf_sql


def _probability(beta, covariates: list[str]) -> Column:
    z = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], covariates):
        z = z + float(b) * F.col(c)
    return 1.0 / (1.0 + F.exp(-z))


def logistic_null(samples: DataFrame, y: str, covariates: list[str], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(beta, (Z'WZ)^-1) of y in {0, 1} on an intercept and covariates, by Newton steps.

    Each step is one aggregation of k * k sums over the samples; nothing but these reaches the driver."""
    names = ["1", *covariates]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    beta = np.zeros(len(names))
    rows = samples.select(F.col(y).cast("double").alias("y_"), *covariates).cache()
    try:
        for _ in range(rounds):
            p = _probability(beta, covariates)
            w = p * (1 - p)
            row = rows.agg(
                *[F.sum((F.col("y_") - p) * value(c)).alias(f"g{i}") for i, c in enumerate(names)],
                *[F.sum(w * value(a) * value(b)).alias(f"h{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j],
            ).first()
            g = np.array([row[f"g{i}"] for i in range(len(names))])
            h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
            inverse = np.linalg.pinv(h)
            step = inverse @ g
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
    finally:
        rows.unpersist()
    return beta, inverse


def logistic_score(calls: DataFrame, samples: DataFrame, y: str, covariates: list[str], group: str = "variant_id") -> DataFrame:
    """U = g'(y - p), V = g'Wg - g'WZ (Z'WZ)^-1 Z'Wg per variant or group, stat U^2 / V; missing calls at the mean.

    p depends on the sample only, so the sparse sums of g, wg^2 and wgz over carriers are enough."""
    n = samples.count()
    beta, inverse = logistic_null(samples, y, covariates)
    names = ["1", *covariates]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    people = samples.select("sample_id", (F.col(y) - _probability(beta, covariates)).alias("r"), _probability(beta, covariates).alias("p"), *covariates)
    people = people.withColumn("w", F.col("p") * (1 - F.col("p")))
    rows = calls.join(people, "sample_id")
    x, missing = F.col("g").cast("double"), F.col("g").isNull()
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    sums = rows.groupBy(group).agg(
        total(x).alias("s"), total(x * F.col("r")).alias("gr"), total(F.when(missing, F.col("r"))).alias("mr"), F.sum(F.when(missing, 1.0).otherwise(0.0)).alias("k"), total(x * x * F.col("w")).alias("gg"), total(F.when(missing, F.col("w"))).alias("mw"),
        *[total(x * F.col("w") * value(c)).alias(f"z{i}") for i, c in enumerate(names)], *[total(F.when(missing, F.col("w") * value(c))).alias(f"m{i}") for i, c in enumerate(names)],
    )
    mean = F.col("s") / (float(n) - F.col("k"))
    z = [F.col(f"z{i}") + mean * F.col(f"m{i}") for i in range(len(names))]
    v = F.col("gg") + mean * mean * F.col("mw")
    for i in range(len(names)):
        for j in range(len(names)):
            v = v - float(inverse[i, j]) * z[i] * z[j]
    out = sums.select(group, (F.col("gr") + mean * F.col("mr")).alias("u"), v.alias("v")).withColumn("t", F.when(F.col("v") > 1e-9, F.col("u") * F.col("u") / F.col("v")))
    out = out.select(group, F.col("u").alias("u_stat"), F.col("v").alias("v_stat"), F.col("t").alias("stat"), F.when(F.col("v") > 1e-9, F.col("u") / F.col("v")).alias("effect"))
    return out.withColumns({"pvalue": F.expr(chi2_1_sf_sql("stat")), "log10p": F.expr(log10_chi2_1_sf_sql("stat"))})


#: Cells that a task holds at once.
CELLS = 500_000


def cells(calls: DataFrame, samples: DataFrame, y: str, covariates: list[str], group: str = "variant_id", patterns: int = 1000) -> tuple[DataFrame, np.ndarray]:
    """(group, cells) and the patterns of trait, number of samples and covariates, a row each: cells(k, n1, n2, gone) are a group's
    samples of pattern k with one allele, with two and with a missing call; hom-ref follows by complement. A handful of cells holds
    all that a regression needs, whatever the number of samples.

    Samples without trait or covariate take no part. More patterns of covariates and trait than `patterns`, or genotypes other
    than 0, 1 and 2, are an error: newton.regress takes those."""
    samples = samples.dropna(subset=[y, *covariates])
    totals = samples.groupBy(*covariates, y).agg(F.count("*").alias("n"))
    found = totals.limit(patterns + 1).collect()
    if len(found) > patterns:
        raise ValueError(f"over {patterns} patterns of covariates and trait; newton.regress takes continuous covariates")
    numbered = samples.sparkSession.createDataFrame([(*r[:-1], k) for k, r in enumerate(found)], totals.drop("n").schema.add("k_", IntegerType()))
    hard = F.col("g").isNull() | F.col("g").isin(0, 1, 2)
    calls = calls.withColumn("g", F.when(hard, F.col("g")).otherwise(F.raise_error(F.lit("a dosage among genotypes; newton.regress takes dosages"))))
    people = samples.select("sample_id", y, *covariates).join(F.broadcast(numbered), [*covariates, y]).select("sample_id", "k_")
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    own = calls.select(group, "sample_id", "g").join(people, "sample_id").groupBy(group, "k_").agg(count(F.col("g") == 1).alias("n1"), count(F.col("g") == 2).alias("n2"), count(F.col("g").isNull()).alias("gone"))
    table = own.groupBy(group).agg(F.collect_list(F.struct(F.col("k_").alias("k"), "n1", "n2", "gone")).alias("cells"))
    return table, np.array([[r[y], r["n"], *[r[c] for c in covariates]] for r in found], float).reshape(len(found), 2 + len(covariates))


def fit_cells(x: np.ndarray, y: np.ndarray, n: np.ndarray, firth: bool, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta, covariance, fitted) of logistic regressions over the same cells x(cell, k), y(cell) with weights n(regression, cell), all at
    once; with firth, the penalised likelihood's."""
    k = x.shape[1]
    beta, covariance, fitted = np.zeros((len(n), k)), np.zeros((len(n), k, k)), np.zeros(len(n), bool)
    squares, rows = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1), np.arange(len(n))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(beta[rows] @ x.T, -30, 30)))
        h = ((n * p * (1 - p)) @ squares).reshape(-1, k, k)
        good = np.isfinite(h).all((1, 2))
        good[good] = ~(np.linalg.cond(h[good]) > 1e13)
        rows, n, p, h = rows[good], n[good], p[good], h[good]
        if not len(rows):
            break
        inverse = np.linalg.inv(h)
        score = (n * (y - p)) @ x
        if firth:
            leverage = p * (1 - p) * (inverse.reshape(-1, k * k) @ squares.T)
            score = score + (n * leverage * (0.5 - p)) @ x
        step = np.einsum("nij,nj->ni", inverse, score)
        step *= np.minimum(1.0, 5 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
        beta[rows] += step
        done = np.abs(step).max(1) < 1e-9
        fitted[rows[done]], covariance[rows[done]] = True, inverse[done]
        rows, n = rows[~done], n[~done]
    return beta, covariance, fitted


def regress(calls: DataFrame, samples: DataFrame, y: str, covariates: list[str], firth: bool = False, group: str = "variant_id", patterns: int = 1000) -> DataFrame:
    """(group, beta, se, pvalue): Wald test of the genotype in a logistic regression with discrete covariates; nulls
    where the fit doesn't converge, as under separation without firth."""
    table, known = cells(calls, samples, y, covariates, group, patterns)
    size = len(known)
    # cells by genotype, then pattern
    x = np.column_stack([np.ones(3 * size), np.repeat([0.0, 1.0, 2.0], size), np.tile(known[:, 2:], (3, 1))])
    trait = np.tile(known[:, 0], 3)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, CELLS // max(1, 3 * size))):
                batch = whole.slice(at, max(1, CELLS // max(1, 3 * size)))
                lists = batch.column("cells")
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                k, n1, n2, gone = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
                n = np.zeros((batch.num_rows, 3, size))
                n[:, 0] = known[:, 1]
                n[row, 0, k] -= n1 + n2 + gone
                n[row, 1, k], n[row, 2, k] = n1, n2
                varies = (n > 0).any(2).sum(1) > 1
                beta, covariance, good = fit_cells(x, trait, np.where(varies[:, None], n.reshape(len(n), -1), 0.0), firth)
                good &= varies & (covariance[:, 1, 1] > 0)
                se = np.sqrt(np.where(good, covariance[:, 1, 1], 1.0))
                tail = [chi2_1_sf(t) for t in (beta[:, 1] / se) ** 2]
                yield pa.RecordBatch.from_arrays([batch.column(group), *[pa.array(c, mask=~good) for c in (beta[:, 1], se, np.array(tail, float))]], names=[group, "beta", "se", "pvalue"])

    return table.mapInArrow(run, f"`{group}` {dict(table.dtypes)[group]}, beta double, se double, pvalue double")
