"""Mixed models with a given kinship: blocks of connected samples, each decomposed by itself; tests are sums by block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_1_sf_sql, log10_chi2_1_sf_sql
from . import shared

#: Samples of a block at most: its matrix (8 m^2 bytes) is one task's work.
MOST_BLOCK = 8_192
#: Cells of genotypes that a task turns at once: so many variants of a block, times its samples.
CELLS = 4_000_000
EIGEN = "block long, lam array<double>, vec array<double>"


def _doubles(column, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def members(kinship: DataFrame, samples: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(sample_id, block, k, m) of samples: the connected components of kinship(i, j, kinship) over pairs with a kinship over
    the threshold, known by their smallest sample, with each sample's place in and the size of its block.

    Labels fall to the least of the neighbours' and then to their label's own label, until none changes: the rounds grow
    with the logarithm of a block's diameter. Pairs of samples that aren't listed are left out, repeated ones count once."""
    spark = samples.sparkSession
    ids = samples.select(F.col("sample_id").cast("long").alias("sample_id")).distinct()
    near = kinship.where((F.abs("kinship") > threshold) & (F.col("i") != F.col("j"))).select(F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"))
    with shared.passing(spark) as table:
        for side in "ab":
            near = near.join(ids.withColumnRenamed("sample_id", side), side, "left_semi")
        edges = table(near.select("a", "b").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        now = table(ids.select("sample_id", F.col("sample_id").alias("label")), "labels")
        while True:
            least = edges.join(now.withColumnRenamed("sample_id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
            step = table(now.join(least.withColumnRenamed("a", "sample_id"), "sample_id", "left").select("sample_id", "label", F.least("label", "near").alias("new")), "labels")
            jump = step.select(F.col("sample_id").alias("new"), F.col("new").alias("next"))
            step = table(step.join(jump, "new", "left").select("sample_id", F.coalesce("next", "new").alias("label"), (F.coalesce("next", "new") != F.col("label")).alias("moved")), "labels")
            now = step.select("sample_id", "label")
            if not step.where("moved").limit(1).count():
                break
        sizes = now.groupBy("label").agg(F.count("*").cast("int").alias("m"))
        most = sizes.agg(F.max("m")).first()[0] or 0
        if most > MOST_BLOCK:
            raise ValueError(f"a block of {most} connected samples: raise the threshold, blocks have {MOST_BLOCK} at most")
        # a block's samples are at most MOST_BLOCK, so none of these lists is long
        lists = now.groupBy("label").agg(F.array_sort(F.collect_list("sample_id")).alias("s"))
        out = lists.select(F.col("label").alias("block"), F.size("s").alias("m"), F.posexplode("s").alias("k", "sample_id"))
        return shared.table(out.select("sample_id", "block", "k", "m"), "members")


def _by_size(sizes: np.ndarray, cells: np.ndarray):
    """The places of blocks of equal size, at most CELLS of cells (a block's numbers) together or one block."""
    for m in np.unique(sizes):
        places = np.flatnonzero(sizes == m)
        ends = np.cumsum(cells[places])
        at = 0
        while at < len(places):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            yield int(m), places[at:to]
            at = to


def _lists(column: pa.ListArray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists at places, and their values one list after another."""
    some = column.take(pa.array(places))
    return some.value_lengths().to_numpy(zero_copy_only=False), some.flatten()


def _rows(values: np.ndarray) -> pa.ListArray:
    """A list a row of values (rows, numbers)."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _eigen(batches):
    for batch in batches:
        sizes = batch.column("m").to_numpy(zero_copy_only=False).astype(np.int64)
        for m, places in _by_size(sizes, sizes**2):
            count, pairs = _lists(batch.column("pairs"), places)
            i, j, v = (f.to_numpy(zero_copy_only=False) for f in pairs.flatten())
            at = np.repeat(np.arange(len(places)), count)
            x = np.tile(np.eye(m), (len(places), 1, 1))
            x[at, i, j] = v
            x[at, j, i] = v
            lam, vec = np.linalg.eigh(x)
            yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(places)), _rows(np.abs(lam)), _rows(vec.reshape(len(places), -1))], names=["block", "lam", "vec"])


def decompose(kinship: DataFrame, placed: DataFrame) -> DataFrame:
    """(block, lam, vec): eigenvalues and vectors (row by row) of each block of several samples, a table of its own that can be
    kept beside the kinship. A missing pair has 0, a missing sample with itself 1."""
    many = placed.where("m > 1")
    side = lambda s, k: many.select(F.col("sample_id").alias(s), F.col("block").alias(f"block_{s}"), F.col("k").alias(k), "m")
    pairs = kinship.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("kinship").cast("double").alias("v"))
    pairs = pairs.join(side("i", "ki"), "i").join(side("j", "kj").drop("m"), "j").where("block_i = block_j")
    rows = pairs.groupBy(F.col("block_i").alias("block"), "m").agg(F.collect_list(F.struct("ki", "kj", "v")).alias("pairs"))
    return shared.table(rows.mapInArrow(_eigen, EIGEN), "eigen")


def _rotate(batches):
    for batch in batches:
        sizes = batch.column("values").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for m, places in _by_size(sizes, sizes**2):
            values = _lists(batch.column("values"), places)[1].flatten()
            x = np.column_stack([values[1].to_numpy(zero_copy_only=False), values[2].flatten().to_numpy(zero_copy_only=False).reshape(len(values[1]), -1)]).reshape(len(places), m, -1)
            vec = _lists(batch.column("vec"), places)[1].to_numpy(zero_copy_only=False).reshape(-1, m, m)
            turned = vec.transpose(0, 2, 1) @ x
            same = [batch.column(c).take(pa.array(places)) for c in ("block", "lam", "vec")]
            yield pa.RecordBatch.from_arrays([*same, _rows(turned[:, :, 0]), _rows(turned[:, :, 1:].reshape(len(places), -1))], names=["block", "lam", "vec", "uy", "ux"])


class Null:
    """y ~ 1 + covariates with covariance sigma2 (K + delta I): delta, sigma2, beta, inner (the inverse of X'V^-1 X, V = K + delta I)
    and trace (of V^-1), fitted by maximum likelihood, or for a given delta.

    All sums are over the blocks' coordinates (eigenvalue, turned trait, turned covariates): one aggregation gives the
    likelihood at every delta of a grid, and three finer grids follow. The driver gets a few numbers for each delta."""

    def __init__(self, kinship: DataFrame, samples: DataFrame, y: str, covariates: list[str] | None = None, threshold: float = 0.0, delta: float | None = None):
        self.p = 1 + len(covariates or [])
        kinship = shared.table(kinship.select("i", "j", "kinship"), "kinship")  # read several times
        self.placed = members(kinship, samples, threshold)
        x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in covariates or []])
        rows = samples.select(F.col("sample_id").cast("long").alias("sample_id"), F.col(y).cast("double").alias("y"), x.alias("x")).join(self.placed, "sample_id")
        grouped = rows.where("m > 1").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "y", "x"))).alias("values"))
        turned = grouped.join(decompose(kinship, self.placed), "block").mapInArrow(_rotate, f"{EIGEN}, uy array<double>, ux array<double>")
        self.blocks = shared.table(turned, "turned")
        own = kinship.where("i = j").groupBy(F.col("i").cast("long").alias("sample_id")).agg(F.max("kinship").alias("own"))
        self.alone = shared.table(rows.where("m = 1").join(own, "sample_id", "left").select("sample_id", F.abs(F.coalesce("own", F.lit(1.0))).alias("lam"), "y", "x"), "alone")
        self.coordinates = self.blocks.select("lam", "uy", "ux").unionAll(self.alone.select(F.array("lam"), F.array("y"), "x"))
        self.n = self.placed.count()
        if delta is None:
            centre, step = 0.0, 0.2
            for k in (50, 10, 10, 10):
                grid = [centre + step * i for i in range(-k, k + 1)]
                centre = max(zip(self._fits(grid), grid), key=lambda x: x[0][0])[1]
                step /= 10
            delta = math.exp(centre)
        self.delta = delta
        (self.loglik, self.sigma2, self.beta, inner, self.trace), = self._fits([math.log(delta)])
        self.information, self.inner = inner, np.linalg.inv(inner)

    def _fits(self, grid: list[float]) -> list[tuple]:
        """(log-likelihood, sigma2, beta, X'V^-1 X, trace of V^-1) at each log delta."""
        p, deltas = self.p, np.exp(np.array(grid))

        def sums(batches):
            total = np.zeros((len(deltas), 2 + (p + 1) ** 2))
            for batch in batches:
                lam, uy, ux = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(3))
                for k in range(0, len(lam), 1 << 14):
                    part = slice(k, k + (1 << 14))
                    x = np.column_stack([ux.reshape(-1, p)[part], uy[part]])
                    d = lam[part] + deltas[:, None]
                    total[:, 0] += np.log(d).sum(1)
                    total[:, 1] += (1 / d).sum(1)
                    total[:, 2:] += (1 / d) @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

        found = self.coordinates.mapInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(len(grid) * (2 + (p + 1) ** 2))
        for r in found:
            total[r.place] = r.value
        out = []
        for row in total.reshape(len(grid), -1):
            a = row[2:].reshape(p + 1, p + 1)
            beta = np.linalg.solve(a[:p, :p], a[:p, p])
            sigma2 = float(a[p, p] - a[:p, p] @ beta) / self.n
            out.append((-0.5 * (self.n * math.log(2 * math.pi) + row[0] + self.n + self.n * math.log(sigma2)), sigma2, beta, a[:p, :p], float(row[1])))
        return out


def sums(calls: DataFrame, null: Null, key: str = "variant_id") -> DataFrame:
    """(key, ac, gq, gvr, gvg, gvx): of each variant or group the sum of g and of g^2, and g' V^-1 times the residual, g and the
    covariates, of sparse complete calls(key, sample_id, g).

    Samples without relatives add terms of their own. A task gets the calls of many small blocks, or of a large one those of some of
    the variants, CELLS at most on average; it turns blocks of equal size together and sums what a batch of blocks gives of a key."""
    p, delta, beta = null.p, null.delta, null.beta
    rows = calls.where("g > 0").select(key, F.col("sample_id").cast("long").alias("sample_id"), F.col("g").cast("double").alias("g"))
    rows = shared.table(rows.join(null.placed, "sample_id"), "placed_calls")
    fitted = sum((F.col("x")[a] * float(b) for a, b in enumerate(beta)), F.lit(0.0))
    w = 1 / (F.col("lam") + float(delta))
    alone = rows.where("m = 1").join(null.alone.select("sample_id", w.alias("w"), (w * (F.col("y") - fitted)).alias("wr"), "x"), "sample_id")
    g = F.col("g")
    alone = alone.groupBy(key).agg(F.sum("g").alias("ac"), F.sum(g * g).alias("gq"), F.sum(g * F.col("wr")).alias("gvr"), F.sum(g * g * F.col("w")).alias("gvg"), F.array(*[F.sum(g * F.col("w") * F.col("x")[a]) for a in range(p)]).alias("gvx"))
    # of a sample's calls the most, so that a block's cells are known to be no more than that times its samples
    most = rows.where("m > 1").groupBy("sample_id").count().agg(F.max("count")).first()[0]
    if not most:
        return alone
    buckets = F.greatest(F.lit(1), F.ceil(F.col("m") * float(most) / CELLS)).cast("long")
    related = rows.where("m > 1").withColumn("bucket", F.pmod(F.xxhash64(key), buckets))
    related = related.groupBy("block", "bucket").agg(F.collect_list(F.struct(F.col(key).alias("key"), "k", "g")).alias("cells"))

    def turn(batches):
        for batch in batches:
            sizes = batch.column("lam").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            count = batch.column("cells").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for m, places in _by_size(sizes, np.maximum(count, sizes**2)):
                n, (names, k, g) = (f := _lists(batch.column("cells"), places))[0], f[1].flatten()
                lam, vec, uy, ux = (_lists(batch.column(c), places)[1].to_numpy(zero_copy_only=False) for c in ("lam", "vec", "uy", "ux"))
                vec, ux = vec.reshape(-1, m, m), ux.reshape(-1, m, p)
                w = 1 / (lam.reshape(-1, m) + delta)
                # what a turned genotype is multiplied by: the residual and the covariates
                by = np.concatenate([(uy.reshape(-1, m) - ux @ beta)[:, :, None], ux], 2) * w[:, :, None]
                names = names.dictionary_encode()
                wide = len(names.dictionary)
                column, at = np.unique(np.repeat(np.arange(len(places)), n) * wide + names.indices.to_numpy(), return_inverse=True)
                k, g = k.to_numpy(), g.to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(len(column)), "right")
                total = np.zeros((wide, 4 + p))
                step = max(1, CELLS // m // (m if len(places) > 1 else 1))
                for low in range(0, len(column), step):
                    part = column[low : low + step]
                    some = order[ends[low - 1] if low else 0 : ends[low + len(part) - 1]]
                    x = np.zeros((len(part), m))
                    x[at[some] - low, k[some]] = g[some]
                    block = part // wide
                    if len(places) > 1:
                        t = (x[:, None, :] @ vec[block])[:, 0]
                        sums = np.einsum("cm,cmq->cq", t, by[block])
                    else:
                        t = x @ vec[0]
                        sums = t @ by[0]
                    found = [x.sum(1), (x * x).sum(1), sums[:, 0], (t * t * w[block]).sum(1), *sums[:, 1:].T]
                    for c, values in enumerate(found):
                        total[:, c] += np.bincount(part % wide, values, wide)
                yield pa.RecordBatch.from_arrays([names.dictionary, *[pa.array(total[:, c]) for c in range(4)], _rows(total[:, 4:])], names=[key, "ac", "gq", "gvr", "gvg", "gvx"])

    kind = f"{key} {dict(calls.dtypes)[key]}, ac double, gq double, gvr double, gvg double, gvx array<double>"
    both = related.join(null.blocks, "block").mapInArrow(turn, kind)
    if null.alone.limit(1).count():
        both = alone.unionAll(both)
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("ac", "gq", "gvr", "gvg")], F.array(*[F.sum(F.col("gvx")[a]) for a in range(p)]).alias("gvx"))


def score(calls: DataFrame, null: Null, key: str = "variant_id") -> DataFrame:
    """(key, af, af_blue, u_stat, v_stat, effect, se, stat, lrt, gamma, pvalue, log10p) of complete calls under a null model with relatives.

    u_stat is g' V^-1 (y - X beta) / sigma2, v_stat its variance with the covariates projected out, effect and se those of one
    more allele; lrt the likelihood ratio at the null's delta; gamma the test with one mean ratio of v_stat to the genotype's
    square sum; af_blue (without covariates) the best linear unbiased frequency. Variants that don't vary have null tests."""
    n, s2 = float(null.n), null.sigma2
    rows = sums(calls, null, key)
    x = F.col("gvx")
    explained = sum((x[a] * x[b] * float(null.inner[a, b]) for a in range(null.p) for b in range(null.p)), F.lit(0.0))
    rows = rows.withColumns({"u": F.col("gvr") / s2, "v": (F.col("gvg") - explained) / s2, "gg": F.col("gq") - F.col("ac") * F.col("ac") / n})
    varies = lambda c: F.when(F.col("v") > 1e-15, c)
    t: Column = F.col("u") * F.col("u") / F.col("v")
    out = rows.select(key, (F.col("ac") / (2 * n)).alias("af"), (x[0] / float(null.information[0, 0]) / 2).alias("af_blue"), F.col("u").alias("u_stat"), F.col("v").alias("v_stat"), varies(F.col("u") / F.col("v")).alias("effect"), varies(1 / F.sqrt("v")).alias("se"),
        varies(t).alias("stat"), varies(-n * F.ln(1 - t / n)).alias("lrt"), varies(F.col("u") * F.col("u") / (null.trace / n / s2 * F.col("gg"))).alias("gamma"))
    return out.withColumns({"pvalue": F.expr(chi2_1_sf_sql("stat")), "log10p": F.expr(log10_chi2_1_sf_sql("stat"))})


def meta_score(calls: DataFrame, variants: DataFrame, null: Null) -> DataFrame:
    """(variant_id, chrom, pos, ref, alt, n, af, ac, u, v, effect, pvalue): summaries of a cohort with relatives for meta-analysis;
    u and sqrt_v are those of score(), of variants that carriers have."""
    rows = score(calls, null).join(variants.select("variant_id", "chrom", "pos", "ref", "alt"), "variant_id")
    return rows.select("variant_id", "chrom", "pos", "ref", "alt", F.lit(null.n).cast("long").alias("n"), F.col("af_blue").alias("af"), (F.col("af") * (2 * null.n)).alias("ac"), F.col("u_stat").alias("u"), F.sqrt(F.greatest("v_stat", F.lit(0.0))).alias("sqrt_v"), "effect", "pvalue")
